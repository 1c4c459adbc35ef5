"""Quality rules from repetition coverage.

Words are maximal runs of characters other than ASCII white space. Every word gets a
dense number inside its text; for several n-gram lengths a polynomial rolling hash over
mixed word numbers is taken in numpy, and the characters of words that lie inside an
n-gram occurring twice or more (first occurrence included) are measured against all word
characters. Repeated lines are measured the same way. A text is rejected when a share
exceeds its limit.

Defined cases: a null text counts as an empty one; it has no words, so it fails the base
rule. Repeated rows give repeated results, an empty table an empty one. Ties cannot occur.
Very long texts are taken whole, one at a time. Columns other than id and text do not
matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamspark.llm.common import filter_texts, map_texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("dup_line_chars", T.LongType()),
        T.StructField("dup_chars_short", T.LongType()),
        T.StructField("dup_chars_mid", T.LongType()),
        T.StructField("dup_chars_long", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class RepetitionLimits:
    """n-gram lengths with the largest share, in percent, of word characters they may cover."""

    lengths: tuple[int, int, int] = (4, 7, 10)
    percents: tuple[int, int, int] = (40, 30, 25)
    line_percent: int = 40
    min_words: int = 50
    base_percent: int = 50


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each dense word number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hashes(mixed: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each window of n word numbers."""
    m = len(mixed) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for j in range(n if m > 0 else 0):
        out *= _BASE
        out += mixed[j : j + m]
    return out


def covered_positions(keys: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in a window whose key occurs twice or more."""
    cover = np.zeros(n_words + 1, dtype=np.int64)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        if same.any():
            repeated = np.zeros(len(keys), dtype=bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            starts = np.flatnonzero(repeated)
            cover[starts] += 1
            np.subtract.at(cover, starts + n, 1)
    return np.cumsum(cover[:-1]) > 0


def _exact_triples(ids: np.ndarray, size: int) -> np.ndarray:
    """Keys of three-word windows that are equal only for equal windows."""
    if len(ids) < 3:
        return np.zeros(0, dtype=np.int64)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size = int(max(pairs.max() + 1, size))
    return pairs[:-1] * size + ids[2:]


def measure(text: str | None, limits: RepetitionLimits = RepetitionLimits()) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                n_dup_lines += 1
                dup_line_chars += len(line) - sum(line.count(c) for c in BLANKS)
            elif line.strip(BLANKS):
                seen.add(line)
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    ids = np.fromiter((number(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    repeat_words, covers = 0, [0, 0, 0]
    if len(numbers) < n:  # else no word occurs twice
        repeat_words = int(covered_positions(_exact_triples(ids, len(numbers)), 3, n).sum())
        if repeat_words:  # longer windows repeat only where shorter ones do
            sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in numbers), dtype=np.int64, count=len(numbers))[ids]
            mixed = _mixed(ids)
            for i, length in enumerate(limits.lengths):
                covers[i] = int(sizes[covered_positions(rolling_hashes(mixed, length), length, n)].sum())
                if not covers[i]:
                    break
    failed = n < limits.min_words or 100 * repeat_words > limits.base_percent * n
    kept = not (
        failed
        or any(100 * c > p * word_chars for c, p in zip(covers, limits.percents, strict=True))
        or 100 * dup_line_chars > limits.line_percent * word_chars
    )
    return n, word_chars, n_symbols, n_dup_lines, repeat_words, dup_line_chars, *covers, failed, kept


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """One row per input row: doc_id and FIELDS. A map without any shuffle."""

    def make():
        def apply(texts):
            rows = [measure(t, limits) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(FIELDS.fields)}

        return apply

    return map_texts(df, make, FIELDS, id_col, text_col)


def keep_by_repetition(df: DataFrame, text_col: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """The rows of ``df``, with all columns, that the rules keep."""
    return filter_texts(df, lambda: lambda texts: [measure(t, limits)[-1] for t in texts], text_col)
