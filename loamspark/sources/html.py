"""Main content of HTML pages as Markdown-like text, and pages as blocks.

A page becomes a list of events, the events a list of balanced steps, the steps text. The
two modes differ in how ends are matched to starts and how text is spaced. ``clean`` follows
the element tree: void elements hold nothing, an end tag closes up to its own start, inline
text keeps its blanks. ``compat`` keeps the defects that users of the older behaviour may
depend on: every start tag is pushed and every end tag pops whatever is on top, and pieces
of text are stripped and joined without a blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

from pyspark.sql import DataFrame

from loamspark.functions.text import CUT_MARKS, GUARD_MARKS
from loamspark.operators.blocks import block_rows, blocks_of_lines, tidy
from loamspark.operators.ordered import per_row
from loamspark.schemas import BLOCKS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "noscript"))
#: What an element writes where it begins and where it ends, and what marks the main part.
BREAKING = frozenset(("p", "div", "section", "article", "li", "tr"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
MAIN_TAGS, MAIN_IDS = frozenset(("main", "article")), frozenset(("main-content", "content"))
MAIN_CLASSES = frozenset(("document", "main", "content", "app-content"))
FENCE = "\n```\n"
BEGINS = {"pre": FENCE, "br": "\n"} | dict.fromkeys(BREAKING, "\n") | {h: f"\n{'#' * n} " for n, h in enumerate(HEADINGS, 1)}
ENDS = dict.fromkeys((*BREAKING, *HEADINGS), "\n")
#: Elements that an opening tag of the same group ends implicitly.
IMPLIED = {"p": BREAKING | {*HEADINGS, "ul", "ol", "table", "pre", "p"}, "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

#: (kind, element or text, whether the element is the main part); kinds: start, end, void, text, hide, show, untitle.
Step = tuple[str, str, bool]


class _Events(HTMLParser):
    """A page's tags and texts in order."""

    def __init__(self, html: str):
        super().__init__()
        self.found: list[Step] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        classes = set((given.get("class") or "").lower().split())
        main = tag in MAIN_TAGS or given.get("role") == "main" or given.get("id") in MAIN_IDS or bool(classes & MAIN_CLASSES)
        self.found.append(("hide" if tag in HIDDEN else "start", tag, main))

    def handle_endtag(self, tag):
        self.found.append(("show" if tag in HIDDEN else "end", tag, False))

    def handle_data(self, data):
        self.found.append(("text", data, False))


def _by_tree(events: Iterable[Step]) -> Iterator[Step]:
    """Steps in which each end belongs to its own start; implied ends put in, stray ends left out."""
    open_: list[Step] = []

    def closed_down_to(keep: int) -> Iterator[Step]:
        while len(open_) > keep:
            _, name, main = open_.pop()
            yield "end", name, main

    for kind, name, main in events:
        if kind == "start" and name in VOID:
            yield "void", name, False
        elif kind == "start":
            while open_ and name in IMPLIED.get(open_[-1][1], ()):
                yield from closed_down_to(len(open_) - 1)
            open_.append((kind, name, main))
            yield kind, name, main
        elif kind == "end":
            own = max((i for i, x in enumerate(open_) if x[1] == name), default=len(open_))
            if name == "title":
                yield "untitle", name, False
            yield from closed_down_to(own)
        else:
            yield kind, name, main


def _by_count(events: Iterable[Step]) -> Iterator[Step]:
    """Steps in which any end takes the mark of the last start, whatever its name."""
    mains: list[bool] = []
    hidden = 0
    for kind, name, main in events:
        if kind == "start":
            mains.append(main)
        elif kind == "end" or (kind == "show" and not hidden):
            kind, main = "end", bool(mains) and mains.pop()
            if name == "title":
                yield "untitle", name, False
        hidden += (kind == "hide") - (kind == "show")
        yield kind, name, main


def _spaced(text: str, out: list[str]) -> str:
    """Inline text with white space made one blank, none at the begin of a line."""
    flat = re.sub(r"\s+", " ", text)
    return flat.lstrip() if not out or out[-1].endswith((" ", "\n")) else flat


MODES = {"clean": (_by_tree, _spaced), "compat": (_by_count, lambda text, out: " ".join(text.split()))}


def main_content(html: str | None, mode: str = "clean") -> tuple[str, str]:
    """Title and main text of a page."""
    balanced, inline = MODES[mode]
    title: list[str] = []
    out: list[str] = []
    depth = dict.fromkeys(("hidden", "main", "pre", "title"), 0)
    for kind, name, main in balanced(_Events(html or "").found):
        if kind in ("hide", "show"):
            depth["hidden"] = max(0, depth["hidden"] + (1 if kind == "hide" else -1))
        elif kind == "text":
            if depth["title"]:
                title.append(name)
            if depth["main"] and not depth["hidden"]:
                piece = name if depth["pre"] else inline(name, out)
                if piece or mode == "compat":
                    out.append(piece)
        elif kind in ("start", "void"):
            depth["main"] += main
            depth["title"] = depth["title"] or name == "title"
            if depth["main"] and name in BEGINS:
                depth["pre"] += name == "pre"
                out.append(BEGINS[name])
        elif kind == "untitle":
            depth["title"] = 0
        else:
            if name == "pre" and depth["pre"]:
                depth["pre"] -= 1
                out.append(FENCE)
            depth["main"] -= main and depth["main"] > 0
            if depth["main"] and name in ENDS:
                out.append(ENDS[name])
    text = tidy("".join(out))
    if mode == "clean":
        text = tidy("\n".join(line if line.startswith("```") else line.rstrip() for line in text.split("\n")))
    return " ".join(" ".join(title).split()), text


def cut_page_end(text: str) -> str:
    """Text up to the first page-end mark, if a mark that proves a generated page occurs."""
    text = tidy(text)
    if not any(mark in text for mark in GUARD_MARKS):
        return text
    places = [p for p in map(text.find, (*GUARD_MARKS, *CUT_MARKS)) if p >= 0]
    return tidy(text[: min(places)])


def slug(text: str) -> str:
    return re.sub(r"-{2,}", "-", re.sub(r"[^\w一-鿿-]+", "-", text.strip().lower())).strip("-") or "section"


def page_title(title: str, url: str) -> str:
    return title or urlparse(url).path.rsplit("/", 1)[-1] or url


def extracted_pages(pages: DataFrame, mode: str = "clean", id_col: str = "page_id") -> DataFrame:
    """id, url, title, text of pages (id, url, html)."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def made(r: dict) -> list[dict]:
        title, text = main_content(r["html"], mode)
        return [{"id": r[id_col], "url": r["url"], "title": page_title(title, r["url"] or ""), "text": cut_page_end(text)}]

    return per_row(pages.select(id_col, "url", "html"), made, f"id {id_type}, url string, title string, text string")


def page_blocks(extracted: DataFrame, max_chars: int = 1200, max_lines: int = 60) -> DataFrame:
    """Block table of extracted pages; a block's address and label are those of its last heading."""

    def placed(r: dict) -> list[dict]:
        blocks = list(blocks_of_lines(r["text"].splitlines(), r["title"], r["url"], "text", max_chars, max_lines))
        for b in blocks:
            if b.section_path:
                b.source_uri, b.location_label = f"{r['url']}#{slug(b.section_path[-1])}", b.section_path[-1]
            elif not b.location_label:
                b.location_label = r["url"]
        return block_rows(str(r["id"]), blocks)

    return per_row(extracted.select("id", "url", "title", "text"), placed, BLOCKS)
