"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words: A-Z in lower case, runs of ASCII digits, a-z and all
non-ASCII characters. A benchmark item's windows are its runs of ``window`` words (the
whole item if it has fewer words, but some). All windows go into one automaton; the
normalised text is scanned once, hits are taken back to word numbers and, for span
output, to character offsets in the original text.

Defined cases: a null text or item has no words. An item without words has no window. An
item with a null id still marks words, but is not listed or counted. Repeated items count
once, repeated documents give repeated rows. An empty benchmark hits nothing.

The automaton is built in every Python worker, at some 500 bytes for a character of items
(each word lies in up to ten windows), so its items are bounded: ``block_chars`` characters,
which is about 250 MB a worker. A larger benchmark is dealt into blocks of items that are
scanned one after another over a checkpointed table, which stays exact. An empty table gives
an empty result; very long texts are taken whole; columns other than id and text do not
matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import checkpointed, filter_texts, keyed_text, text_runs

#: Byte to byte: upper case folded, everything that is no word character made a blank.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Characters of items in one automaton.
BLOCK_CHARS = 500_000

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("char_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(items: Iterable[tuple[object, str | None]], window: int) -> dict[bytes, set[str]]:
    """Window, as words joined by a blank, to the ids of the items that have it."""
    found: dict[bytes, set[str]] = {}
    for item_id, text in items:
        words = normalised_words(text)
        for i in range(max(len(words) - window + 1, min(len(words), 1))):
            ids = found.setdefault(b" ".join(words[i : i + window]), set())
            if item_id is not None:
                ids.add(str(item_id))
    return found


class WindowScanner:
    """The automaton over all windows, with hits in words and characters."""

    def __init__(self, windows: dict[bytes, set[str]]):
        self.automaton = ahocorasick.Automaton()
        for key, ids in windows.items():
            self.automaton.add_word(f" {key.decode('latin-1')} ", (key.count(b" ") + 1, sorted(ids)))
        self.empty = not windows
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], list[list[int]], list[str]]:
        """Number of words, runs of hit words [first, last], their character spans [start, end), items."""
        words = normalised_words(text)
        if self.empty or not words:
            return len(words), [], [], []
        flat = f" {b' '.join(words).decode('latin-1')} "
        ends: np.ndarray | None = None
        runs: list[list[int]] = []
        items: set[str] = set()
        for at, (length, ids) in self.automaton.iter(flat):
            if ends is None:  # where each word's closing blank is
                ends = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), dtype=np.uint8) == 0x20)[1:]
            last = int(np.searchsorted(ends, at))
            runs.append([last - length + 1, last])
            items.update(ids)
        if not runs:
            return len(words), [], [], []
        merged = merge_runs(runs)
        spans, k = [], 0
        for i, m in enumerate(_WORD.finditer(text)):
            if k < len(merged) and i == merged[k][0]:
                spans.append([m.start(), m.end()])
            if k < len(merged) and i == merged[k][1]:
                spans[-1][1] = m.end()
                k += 1
        return len(words), merged, spans, sorted(items)


def merge_runs(runs: list[list[int]], gap: int = 1) -> list[list[int]]:
    """Runs that overlap, or begin within ``gap`` after another's end, made one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple], bool]]:
    """The items in blocks of bounded size, each fetched when its turn comes; whether it is the last."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield [tuple(r) for r in block.collect()], k + 1 == n


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: doc_id, n_words, hit_runs, char_spans, items. No shuffle."""
    state = keyed_text(df, id_col, text_col)
    for block, last in _blocks(benchmark, item_col, item_text_col, block_chars):
        state = _scan(state, windows_of(block, window))
        if not last:
            state = checkpointed(state)
    return state.drop("text")


def _scan(state: DataFrame, windows: dict[bytes, set[str]]) -> DataFrame:
    """doc_id, text and SCAN; what an earlier block has found stays."""
    earlier = len(state.columns) > 2
    schema = T.StructType([*state.select("doc_id", "text").schema.fields, *SCAN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WindowScanner(windows)
        types = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
        for batch in batches:
            rows = [scanner.scan(t) for _, texts in text_runs(batch.column(1)) for t in texts]
            if earlier:
                old = [c.to_pylist() for c in batch.columns[3:]]
                rows = [
                    (n, merge_runs(runs + old[0][i]), merge_runs(spans + old[1][i], 0), sorted({*items, *old[2][i]}))
                    for i, (n, runs, spans, items) in enumerate(rows)
                ]
            found = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=schema.names)

    return state.mapInArrow(run, schema)


def contamination_report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from a scan."""
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0] + 1)
    return scanned.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``df``, with all columns, that no benchmark window occurs in."""
    for block, last in _blocks(benchmark, "item_id", "text", block_chars):
        windows = windows_of(block, window)

        def make(windows=windows):
            scanner = WindowScanner(windows)
            return lambda texts: [not scanner.scan(t)[1] for t in texts]

        df = filter_texts(df, make, text_col)
        if not last:
            df = checkpointed(df)
    return df

