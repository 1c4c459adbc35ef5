"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are taken in one map. On a bounded, documented sample of
labelled rows (``max_rows`` rows, those with the smallest hash of the id) shallow trees are
boosted; each path from a root to any node is a conjunctive rule. A lasso logistic model
over the rules' indicators keeps few of them, and these compile into one Spark column
expression over the statistics.

Labels come only from rows that the caller passes; ids and labels are no inputs of a score.

The chosen labels are broadcast (``max_rows`` ids and labels at most), so no text is shuffled.

Defined cases: a null text counts as an empty one and gets a score like any other. With no
labelled rows, labels of one kind, or no split that tells them apart (constant statistics),
the score is the smoothed share of label 1. Ties of equal splits go to the first statistic
and the lower threshold. A label given twice counts twice, and so does a document given
twice; null labels do not count. An empty table gives an empty result. Very long texts are
taken whole, one at a time. Columns other than id and text do not matter, whatever their
names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import keyed_text, map_texts

STATISTICS = (
    "n_words", "word_length", "long_words", "symbols", "pipes", "marks", "upper", "digits", "commas",
    "distinct_words", "top_word", "same_neighbour", "repeated_pairs", "n_lines", "line_words", "repeated_lines", "no_letters",
)
FIELDS = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])
_SYMBOLS = "#*$%&<>=~^@\\{}[]"


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of STATISTICS; shares are of words, characters or lines."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    some = max(n, 1)
    return (
        float(n),
        sum(map(len, words)) / some,
        sum(len(w) > 12 for w in words) / some,
        sum(text.count(c) for c in _SYMBOLS) / chars,
        text.count("|") / some,
        (text.count("!") + text.count("?")) / some,
        sum(map(str.isupper, words)) / some,
        len(re.findall(r"\d", text)) / chars,
        (text.count(",") + text.count(".")) / some,
        len(counts) / some,
        max(counts.values(), default=0) / some,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / some,
        1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
        float(len(lines)),
        n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        sum(not any(map(str.isalpha, w)) for w in counts) / max(len(counts), 1),
    )


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and STATISTICS of each row."""

    def make():
        def apply(texts):
            rows = [statistics(t) for t in texts]
            return {name: [r[i] for r in rows] for i, name in enumerate(STATISTICS)}

        return apply

    return map_texts(df, make, FIELDS, id_col, text_col)


#: One bound of a rule: statistic, whether the value must exceed the threshold, threshold.
Bound = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[tuple[Bound, ...], float], ...]

    def score(self, name=lambda s: F.col(s)) -> Column:
        """The model as a Spark column over the statistics."""
        total = F.lit(float(self.intercept))
        for bounds, weight in self.rules:
            held = F.lit(True)
            for k, above, threshold in bounds:
                value = name(STATISTICS[k])
                held = held & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        text = lambda b: f"{STATISTICS[b[0]]} {'>' if b[1] else '<='} {b[2]:.4g}"
        return [f"{w:+.3f}  {' and '.join(map(text, bounds))}" for bounds, w in sorted(self.rules, key=lambda r: -abs(r[1]))]


def _thresholds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each statistic: between neighbouring quantiles."""
    out = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _grow(binned: np.ndarray, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, sizes: list[int], depth: int, least: int):
    """A tree's nodes as (path of (statistic, above, bin), rows, step), root left out."""
    out, todo = [], [((), rows)]
    while todo:
        path, rows = todo.pop()
        if path:
            out.append((path, rows, -grad[rows].sum() / (hess[rows].sum() + 1.0)))
        if len(path) == depth or len(rows) < 2 * least:
            continue
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        best, cut = 1e-3, None
        for k, size in enumerate(sizes):
            if not size:
                continue
            codes = binned[rows, k]
            n = np.cumsum(np.bincount(codes, minlength=size + 1))[:-1]
            g = np.cumsum(np.bincount(codes, grad[rows], size + 1))[:-1]
            h = np.cumsum(np.bincount(codes, hess[rows], size + 1))[:-1]
            gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
            gain[(n < least) | (len(rows) - n < least)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, cut = gain[at], (k, at)
        if cut:
            k, at = cut
            below = binned[rows, k] <= at
            todo += [((*path, (k, False, at)), rows[below]), ((*path, (k, True, at)), rows[~below])]
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 48, penalty: float = 0.002) -> RuleModel:
    """Boosted trees to rules, then lasso logistic weights by accelerated proximal steps."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(intercept, ())
    cuts = _thresholds(x, bins)
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin, found = np.full(len(y), intercept), {}
    rng = np.random.default_rng(11)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = np.flatnonzero(rng.random(len(y)) < 0.6)
        if not len(part):
            continue
        nodes = _grow(binned, part, p - y, np.maximum(p * (1 - p), 1e-6), [len(c) for c in cuts], depth, max(3, len(y) // 2000))
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, step in nodes:
            bounds = _merged(path)
            held = np.ones(len(y), dtype=bool)
            for k, above, at in bounds:
                held &= (binned[:, k] > at) if above else (binned[:, k] <= at)
            found[bounds] = held
            if path not in inner:
                margin[held] += 0.3 * step
    keys = list(found)
    if not keys:  # no split tells the labels apart
        return RuleModel(intercept, ())
    a = np.stack([found[k] for k in keys], axis=1).astype(np.float64)
    weights, base = _lasso(a, y.astype(np.float64), intercept, penalty)
    real = lambda bounds: tuple((k, above, float(cuts[k][at])) for k, above, at in bounds)
    kept = [(real(k), float(w)) for k, w in zip(keys, weights, strict=True) if w]
    return RuleModel(float(base), tuple(kept))


def _merged(path: tuple) -> tuple:
    """The tightest bounds that a path states."""
    tight: dict[tuple[int, bool], int] = {}
    for k, above, at in path:
        old = tight.get((k, above))
        tight[k, above] = at if old is None else (max(old, at) if above else min(old, at))
    return tuple((k, above, at) for (k, above), at in sorted(tight.items()))


def _lasso(a: np.ndarray, y: np.ndarray, intercept: float, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    n, m = a.shape
    mean = a.mean(axis=0)
    centred = a - mean
    gram = centred.T @ centred / n if m <= n else None
    bound = float(np.linalg.eigvalsh(gram)[-1]) if gram is not None else float((centred**2).sum() / n)
    rate = 1 / (0.25 * max(bound, 1e-9) + 0.25)
    w = z = np.zeros(m)
    b = zb = intercept
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(centred @ z + zb)))
        new = z - rate * (centred.T @ (p - y) / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = zb - rate * float((p - y).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return w, b - float(mean @ w)


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, max_rows: int = 20_000
) -> DataFrame:
    """doc_id, score, predicted for each row; ``labels`` (doc_id, label) are the training rows only."""
    chosen = labels.where("label is not null").select(F.col("doc_id").alias("__id"), F.col("label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    narrow = keyed_text(docs, id_col, text_col)
    sample = narrow.join(F.broadcast(chosen), narrow["doc_id"] == chosen["__id"]).select("doc_id", "text", "__label")
    keyed = sample.select(F.struct("doc_id", F.col("__label").alias("label")).alias("doc_id"), "text")
    measured = text_statistics(keyed).select("doc_id.doc_id", F.col("doc_id.label").alias("label"), *STATISTICS)
    rows = measured.orderBy(F.xxhash64("doc_id"), *STATISTICS).select(*STATISTICS, F.col("label").cast("double")).limit(max_rows).collect()
    table = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS) + 1)
    model = fit_rules(table[:, :-1], table[:, -1])
    scored = text_statistics(docs, id_col, text_col).select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
