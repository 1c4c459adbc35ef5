"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all documents of the corpus: letters in lower
   case, everything else a word boundary. Counts are summed per task, then by gram; the
   table is bounded by the alphabet (60 symbols, 216,000 grams at most).
2. A suspicious token (letters mixed with look-alike digits or signs, a letter three times
   or more in a row, single letters held apart by blanks or dots) becomes a lattice of the
   characters it may stand for, each with a channel cost. Viterbi picks the likeliest path
   under the model; equal scores go to the smaller string. A look-alike three times or more
   in a row is read twice, as up to three letters and as one; both readings count. Tokens
   and runs of spaced letters are decoded at any length, in time linear in it.
3. Words of the restored text, with their prefixes, are hashed into 2**20 buckets. Buckets
   that toxic training rows have far more often than others carry a log-odds weight; a
   text's score is a logistic function of the weights found in it.

Counts in 1 cover all documents. The classifier of 3 is fitted on a bounded sample of the
training rows: the ``max_labels`` labels with the smallest hash of the id, which are
broadcast (16 bytes each, so under 1 MB by default); no text is shuffled. Its calibration
coefficients are fitted on ``max_rows`` of these. The weights sent to the executors are bounded by ``max_weights``, the
heaviest first, ties by bucket.

Defined cases: a null text counts as an empty one and gets a score. Without training rows,
or with rows of one kind, the score is the smoothed share of label 1. Repeated rows count
as often as they are given. An empty table gives an empty result. Very long texts are taken
whole. Columns other than id and text do not matter, whatever their names. Look-alikes are
those of ``LOOKALIKES``; letters beyond U+02FF are one symbol to the character model, so
look-alike letters of other scripts are not restored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import checkpointed, keyed_text, map_texts

#: What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SUBSTITUTION, DROPPED, DOUBLED = -1.2, -0.4, -0.7
BUCKETS = 1 << 20
_ACCENTED = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_SYMBOLS = " abcdefghijklmnopqrstuvwxyz" + _ACCENTED
OTHER = len(_SYMBOLS)
SIZE = OTHER + 1
_LUT = np.full(0x300, 0, dtype=np.int64)
for _i, _c in enumerate(_SYMBOLS):
    _LUT[ord(_c)] = _i
_LUT[0x100:0x300] = OTHER
_CODE = {c: i for i, c in enumerate(_SYMBOLS)}

_SPACED = re.compile(r"(?<!\S)\w(?:[\s._*\-]\w){3,}(?![\w])")
_EDGE = ".,;:!?\"'#%&*<>[]{}()|$«»“”…"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_SIGN_RUN = re.compile(r"([0-9@$!|+(€£])\1\1")
_SIGNS = re.compile(r"[0-9@$!|+(€£]")
_LETTER = re.compile(r"[^\W\d_]")
_INNER = re.compile(r"^\w(?:[._*\-]\w){2,}$")


def codes(text: str) -> np.ndarray:
    """Symbol numbers of a text, runs of boundaries made one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    out = np.where(points < 0x300, _LUT[np.minimum(points, 0x2FF)], OTHER)
    return out[(out != 0) | np.append(True, out[:-1] != 0)] if len(out) else out


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            texts, held = [], 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text:
                    texts.append(text)
                    held += len(text)
                if held > 2_000_000 or (text is None and texts):
                    c = codes(" " + " ".join(texts) + " ")
                    total += np.bincount(c[:-2] * SIZE**2 + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
                    texts, held = [], 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated trigram log-probabilities."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        three = np.zeros(SIZE**3)
        three[grams] = counts
        three = three.reshape(SIZE, SIZE, SIZE)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)
        self.rows = {}

    def step(self, a: int, b: int, c: int) -> float:
        return float(self.log[a, b, c])

    def decode(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest string; an entry's options are short strings with their channel cost."""
        # A path is a chain of (path before, text), so a step costs the same however long the path is.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*lattice, [(" ", 0.0)]]:
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for text, cost in options:
                    x, y, total = a, b, score + cost
                    for ch in text:
                        code = _CODE.get(ch, OTHER)
                        if code or y:  # a boundary after a boundary adds nothing
                            total += self.step(x, y, code)
                            x, y = y, code
                    old = following.get((x, y))
                    if old is None or total > old[0] or (total == old[0] and _is_smaller((path, text), old[1])):
                        following[x, y] = (total, (path, text))
            states = following
        best = max(score for score, _ in states.values())
        return min(_spelled(path, None) for score, path in states.values() if score == best).strip()


def _spelled(path: tuple | None, since: tuple | None) -> str:
    """The string of a path after the part ``since``."""
    parts = []
    while path is not since:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def _is_smaller(left: tuple, right: tuple) -> bool:
    """Whether the string of the left path is the smaller one, compared from where the two part."""
    a, b = left, right
    while a is not b:
        a, b = a[0], b[0]
    return _spelled(left, a) < _spelled(right, a)


def lattice_of(token: str, single: bool = False) -> list[list[tuple[str, float]]]:
    """What each part of a token in lower case may stand for.

    A run of three or more of one look-alike stands for up to three letters; with
    ``single`` for one or a double one, as a run of letters does.
    """
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c in LOOKALIKES and single and j - i >= 3:
            out.append([(x * n, SUBSTITUTION + DOUBLED * (n - 1)) for x in LOOKALIKES[c] for n in (1, 2)])
        elif c in LOOKALIKES:
            for _ in range(min(j - i, 3)):
                out.append([(x, SUBSTITUTION) for x in LOOKALIKES[c]])
        elif c in " \t\n\r\x0b\x0c._*-":
            out.append([("", DROPPED), (" ", 0.0)])
        elif j - i >= 3:
            out.append([(c, 0.0), (c * 2, DOUBLED)])
        else:
            out.append([(c * (j - i), 0.0)])
        i = j
    return out


def is_suspicious(core: str) -> bool:
    """Whether a token in lower case may hide a word."""
    if core.isalpha():
        return bool(_TRIPLE.search(core))
    return bool(_LETTER.search(core) and (_SIGNS.search(core) or _TRIPLE.search(core) or _INNER.match(core)))


def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed features of one restored word."""
    if len(word) < 3:
        return ()
    raw = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(raw) % BUCKETS]
    found += [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS for n in (4, 5) if len(word) > n]
    return tuple(found)


class Restorer:
    """Tokens to the words they stand for and to a value of these words' buckets.

    ``value`` makes the value from a token's buckets; a table remembers it by token, bounded
    by the number and the characters of its tokens.
    """

    def __init__(self, model: CharacterModel, value=lambda buckets: buckets, limit: int = 300_000, limit_chars: int = 10_000_000):
        self.model, self.value, self.limit, self.limit_chars = model, value, limit, limit_chars
        self.known: dict[str, object] = {}
        self.held = 0

    def readings(self, form: str) -> list[list[str]]:
        """The words a suspicious token stands for; with a run of look-alikes, also those with the run as one letter."""
        found = [self.model.decode(lattice_of(form)).split()]
        if _SIGN_RUN.search(form):
            found.append(self.model.decode(lattice_of(form, single=True)).split())
        return found

    def words(self, token: str) -> list[str]:
        """The words of all readings of a token, then the token itself."""
        low = token.lower()
        core = low.strip(_EDGE)
        if core.isalpha() and len(core) == len(low) and not is_suspicious(core):
            return [core]
        raw = low.strip(".,;:?\"'«»“”…")
        for form in (core, raw) if raw[:1] not in "@$(|" else (raw, core):
            if is_suspicious(form):
                return [*(w for reading in self.readings(form) for w in reading), core]
        return [core]

    def _value(self, words: list[str]):
        return self.value(buckets_of(words[0]) if len(words) == 1 else tuple({b for w in words for b in buckets_of(w)}))

    def of_text(self, text: str | None) -> tuple[int, list]:
        """Number of tokens, and the value of each distinct one and of each run of spaced letters."""
        text = text or ""
        tokens = text.split()
        distinct = set(tokens)
        known = self.known
        if len(known) > self.limit or self.held > self.limit_chars:
            known.clear()
            self.held = 0
        for token in distinct.difference(known):
            known[token] = self._value(self.words(token))
            self.held += len(token)
        found = list(map(known.__getitem__, distinct))
        for m in _SPACED.finditer(text):
            found.append(self._value(self.model.decode(lattice_of(m.group().lower())).split() or [""]))
        return len(tokens), found

    def restore(self, text: str) -> str:
        """The whole text with suspicious tokens replaced."""
        joined = _SPACED.sub(lambda m: self.model.decode(lattice_of(m.group().lower())), text)
        return re.sub(r"\S+", lambda m: " ".join(self.words(m.group())[:-1]) or m.group(), joined)


def bucket_counts(labelled: DataFrame, model: CharacterModel) -> DataFrame:
    """bucket, toxic, clean: training rows (text, label) that have a bucket; bucket -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        seen = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set().union(*restorer.of_text(text)[1])
                seen[int(label == 1), np.fromiter(own, dtype=np.int64, count=len(own))] += 1
                seen[int(label == 1), BUCKETS] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == BUCKETS, -1, at)), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["bucket", "toxic", "clean"])

    rows = labelled.select("text", F.col("label").cast("long")).mapInArrow(run, "bucket long, toxic long, clean long")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def bucket_weights(counts: DataFrame, max_weights: int = 50_000, least_share: float = 0.002, least_rows: int = 4, least_weight: float = 2.5) -> tuple[dict[int, float], int, int]:
    """Log-odds of the buckets that speak for label 1, and the numbers of training rows of both kinds."""
    totals = counts.where("bucket = -1").first()
    toxic, clean = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    odds = F.log((F.col("toxic") + 0.1) / (toxic + 0.2)) - F.log((F.col("clean") + 0.1) / (clean + 0.2))
    enough = max(least_rows, least_share * toxic)
    rows = counts.where(F.col("bucket") >= 0).where(F.col("toxic") >= enough).withColumn("w", odds).where(F.col("w") >= least_weight)
    kept = rows.orderBy(F.desc("w"), "bucket").select("bucket", "w").limit(max_weights).collect()
    return {r[0]: min(float(r[1]), 8.0) for r in kept}, toxic, clean


EVIDENCE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("total", "heaviest", "length")])


def evidence(docs: DataFrame, model: CharacterModel, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, total, heaviest, length: logs of the summed weights and of the number of tokens, and the largest weight."""

    def make():
        heavy = weights.get
        restorer = Restorer(model, lambda buckets: max((heavy(b, 0.0) for b in buckets), default=0.0))

        def of(text):
            n, found = restorer.of_text(text)
            best = sorted(filter(None, found))
            return float(np.log1p(sum(best))), (best[-1] if best else 0.0), float(np.log1p(n))

        def apply(texts):
            rows = [of(t) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(EVIDENCE.fields)}

        return apply

    return map_texts(docs, make, EVIDENCE, id_col, text_col)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Intercept and weights by damped Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + penalty @ w), -4, 4)
    return w


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    rows = gram_counts(docs, text_col).collect()  # 216,000 rows at most
    table = np.array([tuple(r) for r in rows], dtype=np.int64).reshape(len(rows), 2)
    return CharacterModel(table[:, 0], table[:, 1])


def classify_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_rows: int = 20_000, max_labels: int = 50_000
) -> DataFrame:
    """doc_id, score, predicted for each row; ``labels`` (doc_id, label) are the training rows only."""
    model = character_model(docs, text_col)
    narrow = keyed_text(docs, id_col, text_col)
    known = labels.where("label is not null").select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label"))
    given = F.broadcast(known.orderBy(F.xxhash64("__id"), "__id", "label").limit(max_labels))
    labelled = narrow.join(given, narrow["doc_id"] == given["__id"]).select("doc_id", "text", "label")
    weights, toxic, clean = bucket_weights(checkpointed(bucket_counts(labelled, model)))
    prior = (toxic + 0.5) / (toxic + clean + 1.0)
    found = evidence(docs, model, weights, id_col, text_col)
    if not toxic or not clean:
        score = F.lit(float(prior))
    else:
        found = checkpointed(found)
        rows = found.join(given, found["doc_id"] == given["__id"]).orderBy(F.xxhash64("doc_id"), "doc_id", "length", "label")
        sample = rows.select(*EVIDENCE.fieldNames(), F.col("label").cast("double")).limit(max_rows).collect()
        table = np.array([tuple(r) for r in sample])
        w = fit_logistic(table[:, :3], (table[:, 3] == 1).astype(np.float64))
        line = F.lit(float(w[0]))
        for name, weight in zip(EVIDENCE.fieldNames(), w[1:], strict=True):
            line = line + F.lit(float(weight)) * F.col(name)
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-line))
    scored = found.select("doc_id", score.alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
