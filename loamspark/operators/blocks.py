"""Text to located blocks: sequential rules that no frame expresses, one document at a time.

The functions work on one document's lines; ``line_blocks`` and ``paragraph_blocks`` apply
them to tables in Arrow batches. A document is one row, so nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

from pyspark.sql import DataFrame

from loamspark.functions.quality import CODE_MARKS, CODE_SIGNS, LONGEST_TITLE, NUMBERED, REFUSED_LOWER, REFUSED_TITLES
from loamspark.operators.ordered import per_row
from loamspark.schemas import BLOCKS

FENCE = re.compile(r"\s*(`{3,}|~{3,})")
HEADING = re.compile(r"(#{1,6})\s+(.+)$")
#: The first of these that fits a line names its symbol, by its last group.
SYMBOLS = (
    r"^\s*(class|struct|enum|interface)\s+([A-Za-z_][\w]*)",
    r"^\s*def\s+([A-Za-z_][\w]*)\s*\(",
    r"^\s*function\s+([A-Za-z_][\w]*)\s*\(",
    r"^\s*func\s+([A-Za-z_][\w]*)\s*\(",
    r"^\s*fn\s+([A-Za-z_][\w]*)\s*\(",
    r"^\s*(?:[A-Za-z_][\w\s\*]+)\s+([A-Za-z_][\w]*)\s*\([^;]*\)\s*\{?$",
)
#: What begins a line that defines nothing.
COMMENTS = ("//", "#", "*", "/*")
_SYMBOLS = tuple(map(re.compile, SYMBOLS))


@dataclass
class Block:
    text: str
    role: str = "text"
    section_path: list[str] = field(default_factory=list)
    symbol_name: str | None = None
    page_number: int | None = None
    page_label: str | None = None
    line_start: int | None = None
    line_end: int | None = None
    paragraph_start: int | None = None
    paragraph_end: int | None = None
    source_uri: str | None = None
    location_label: str | None = None

    def scope(self) -> tuple:
        return self.page_number, tuple(self.section_path), self.source_uri


def tidy(text: str) -> str:
    """Compatibility forms folded, line ends one kind, at most one blank line, ends stripped."""
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def heading_text(text: str) -> str:
    return " ".join(text.replace("\uf0c1", "").split())


_REFUSED = {low: re.compile("|".join(f"(?:{p})" for p in patterns)) for low, patterns in ((True, REFUSED_LOWER), (False, REFUSED_TITLES))}


def is_title(title: str) -> bool:
    """``quality.is_section_title`` of one text, by the same table of patterns."""
    t = " ".join(unicodedata.normalize("NFKC", re.sub(r"[*`#]+", "", title)).split())
    low = t.lower()
    if not 0 < len(t) <= LONGEST_TITLE or any(mark in low for mark in CODE_MARKS) or _REFUSED[True].search(low) or _REFUSED[False].search(t):
        return False
    return not re.search(CODE_SIGNS, t) or bool(re.match(NUMBERED, t))


def symbol_of(line: str) -> str | None:
    """The symbol that a line of code defines."""
    bare = line.strip()
    fits = () if bare.startswith(COMMENTS) else filter(None, (p.match(bare) for p in _SYMBOLS))
    return next((m.group(m.lastindex) for m in fits), None)


@dataclass
class Region:
    """Neighbouring lines of one kind under one heading and symbol; ``last`` is where a fence ends them."""

    code: bool
    path: list[str]
    symbol: str | None = None
    first: int | None = None
    rows: list[tuple[int, str]] = field(default_factory=list)
    last: int | None = None


def regions(lines: Iterable[str], with_symbols: bool = False) -> Iterator[Region]:
    """Lines dealt to regions: fences switch the kind, titles and symbols begin a new one.

    The section stack is positional: a heading of level n keeps the first n - 1 titles. A
    fence is closed by any fence of the same kind; one left open ends with the text.
    """
    here = Region(False, [])
    fence, number = "", 0
    for number, raw in enumerate(lines, start=1):
        line = raw.rstrip("\n")
        mark = FENCE.match(line)
        level, title = (0, "") if fence or mark else heading_of(line)
        symbol = symbol_of(line) if with_symbols and not (fence or mark or title) else None
        if mark and (not fence or mark.group(1).startswith(fence[:3])):
            here.last = number if fence else None
            yield here
            fence = "" if fence else mark.group(1)
            here = Region(bool(fence), here.path, here.symbol, number + 1 if fence else None)
        elif title:
            yield here
            here = Region(False, [*here.path[: level - 1], title])
        else:
            if symbol:
                yield here
                here = Region(False, here.path, symbol)
            here.rows.append((number, line))
    here.last = number if fence else None
    yield here


def heading_of(line: str) -> tuple[int, str]:
    """Level and title of a Markdown heading; (0, "") of any other line."""
    m = HEADING.match(line.strip())
    title = heading_text(m.group(2)) if m else ""
    return (len(m.group(1)), title) if m and is_title(title) else (0, "")


def _parts(region: Region, max_chars: int, max_lines: int) -> Iterator[tuple[int, int, str]]:
    """First line, last line and text of a region's parts; a part ends with the line that fills it."""
    start = size = 0
    first = region.first
    rows = region.rows
    for i, (number, line) in enumerate(rows, start=1):
        size += len(line) + 1
        full = size >= max_chars or (not region.code and i - start >= max_lines)
        if full or i == len(rows):
            last = number if full or region.last is None else region.last
            yield first or rows[start][0], last, "\n".join(x for _, x in rows[start:i])
            first, start, size = (number + 1 if region.code else None), i, 0


def blocks_of_lines(lines: Iterable[str], filename: str, source_uri: str | None = None, role: str = "text", max_chars: int = 1400, max_lines: int = 80) -> Iterator[Block]:
    """Blocks of regions, cut by size. Size is tested after a line, so a block may exceed it by one."""
    for region in regions(lines, role == "code"):
        named = None if region.code else region.symbol
        path = [*region.path, *([named] if named and region.path[-1:] != [named] else [])]
        for first, last, body in _parts(region, max_chars, max_lines):
            body = body.strip("\n") if region.code else body.strip()
            if body.strip():
                yield Block(body, "code" if region.code else role, path, named, line_start=first, line_end=last, source_uri=source_uri, location_label=f"{filename}:{first}-{last}")


def _place(word: str, first: int | None, last: int | None) -> str | None:
    if first is None or last is None:
        return None
    return f"{word} {first}" if first == last else f"{word} {first}-{last}"


def _packed(items: list[Block]) -> Block:
    """One block of paragraphs: begin of the first, end of the last that has one."""
    latest = lambda name: next((v for x in reversed(items) if (v := getattr(x, name)) is not None), None)
    head = items[0]
    line_end, paragraph_end = latest("line_end"), latest("paragraph_end")
    label = _place("段落", head.paragraph_start, paragraph_end) or _place("行", head.line_start, line_end)
    label = label or next((x.location_label for x in reversed(items) if x.location_label), head.location_label)
    return replace(head, text="\n\n".join(x.text for x in items), line_end=line_end, paragraph_end=paragraph_end, location_label=label)


def blocks_of_paragraphs(paragraphs: Iterable[Block], max_chars: int = 1200, max_items: int = 12) -> Iterator[Block]:
    """Paragraphs of one scope packed greedily."""
    filled = (replace(p, text=t) for p in paragraphs if (t := tidy(p.text)))
    for _, scoped in groupby(filled, key=Block.scope):
        pack: list[Block] = []
        for item in scoped:
            if pack and (len(pack) >= max_items or sum(len(x.text) + 2 for x in pack) + len(item.text) > max_chars):
                yield _packed(pack)
                pack = []
            pack.append(item)
        yield _packed(pack)


def block_rows(document_id, blocks: Iterable[Block]) -> list[dict]:
    return [{"document_id": document_id, "seq": seq, **vars(b)} for seq, b in enumerate(blocks)]


def line_blocks(texts: DataFrame, max_chars: int = 1400, max_lines: int = 80) -> DataFrame:
    """Block table of rows (document_id, filename, source_uri, role, text)."""

    def made(r: dict) -> list[dict]:
        return block_rows(r["document_id"], blocks_of_lines((r["text"] or "").splitlines(), r["filename"], r["source_uri"], r["role"], max_chars, max_lines))

    return per_row(texts.select("document_id", "filename", "source_uri", "role", "text"), made, BLOCKS)
