"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text's blanks become the piece mark, one is put in front, and each stretch from a mark to
the next is counted for itself. One Aho-Corasick automaton yields every vocabulary piece
that ends at each character, the longest first; a dynamic programme carries the best score
and the number of pieces, never the pieces. Tie rules are those of the public ``tokenizers``
library's unigram model: of equal scores the earlier start stays; a character without a
piece of its own may be unknown at 10 below the smallest score, and then counts its UTF-8
bytes where the vocabulary has byte pieces (one for a run of unknowns where not).

Defined cases: a null or empty text has no tokens. Repeated rows give repeated results. A
text of one endless stretch is counted in linear time and constant memory a character. An
empty table gives an empty result. Columns other than id and text do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamspark.llm.common import map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
COUNTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_stretches", T.LongType()), T.StructField("score", T.DoubleType())])


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, in order of id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class ViterbiCounter:
    """Best score and number of pieces of a text."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.has_bytes = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.limit = limit
        self.known: dict[str, tuple[int, float]] = {}

    def stretch(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of one stretch, the mark included."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        reached, fresh = [False] * (n + 1), [False] * (n + 1)
        reached[0] = True
        single, unknown = self.single, self.unknown
        matches = self.automaton.iter(text)
        at, found = next(matches, (n, None))
        for end in range(1, n + 1):
            while at == end - 1:
                length, score = found
                start = end - length
                total = best[start] + score
                if not reached[end] or total > best[end]:
                    best[end], count[end], reached[end], fresh[end] = total, count[start] + 1, True, False
                at, found = next(matches, (n, None))
            char = text[end - 1]
            if char not in single:
                total = best[end - 1] + unknown
                if not reached[end] or total > best[end]:
                    cost = len(char.encode("utf-8", "surrogatepass")) if self.has_bytes else 0 if fresh[end - 1] else 1
                    best[end], count[end], reached[end], fresh[end] = total, count[end - 1] + cost, True, True
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, int, float]:
        """Tokens, stretches and summed score of a whole text."""
        if not text:
            return 0, 0, 0.0
        marked = text.replace(" ", MARK)
        parts = (marked[1:] if marked[0] == MARK else marked).split(MARK)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for part in set(parts).difference(known):
            if len(part) <= 64:
                known[part] = self.stretch(MARK + part)
        got = [known.get(p) or self.stretch(MARK + p) for p in parts]
        return sum(c for c, _ in got), len(parts), sum(s for _, s in got)


@lru_cache(maxsize=2)
def counter(path: str) -> ViterbiCounter:
    """The counter of a vocabulary file, once per Python worker."""
    return ViterbiCounter(load_pieces(path))


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_stretches, score. ``vocabulary`` is a path that every executor can read."""

    def make():
        viterbi = counter(vocabulary)

        def apply(texts):
            rows = [viterbi.count(t) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(COUNTS.fields)}

        return apply

    return map_texts(df, make, COUNTS, id_col, text_col)
