"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut by the vocabulary's pattern. A piece that is itself in the vocabulary is
one id; every other piece starts as its bytes. A segment tree over the byte positions
holds in each node the smallest pair rank below it, packed with the position so that the
leftmost of equal ranks wins. Each merge takes the root, joins two live neighbours and
updates the two leaves that changed, a logarithmic number of nodes each.

Many pieces of similar length are merged at once: their trees are rows of one numpy
array, and every round takes each row's root. Pieces over ``LONG`` bytes have a tree of
their own in plain lists. Encoded pieces are kept in a table of bounded size per worker.

Defined cases: a null or empty text has no ids. Bytes are merged whatever they are; a
text of one endless word costs n log n. Repeated rows give repeated results, an empty table an
empty one. Columns other than id and text do not matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamspark.llm.common import map_texts

LONG = 128
_SHIFT = 2**20  # positions in a packed key of a batched tree
_NONE = np.int64(2**62)
CACHE = 100_000  # pieces whose ids a worker keeps; workers live on, so what they keep counts in every later stage
CHUNK_CHARS = 1_000_000
PIECES = 400_000  # characters of a text, or matches of a longer one, that are held at once

ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairEncoder:
    """Ids of a text and bytes of ids under one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token_of = {rank: token for token, rank in ranks.items()}
        # White space as Unicode has it; the engine's own \s also takes four control characters.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}"))
        self.size = max(ranks.values(), default=0) + 1
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        self._hash_pairs(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64))
        self.pair_rank = dict(zip(keys, merged, strict=True))
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a rank, whose text would be lost: {missing}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of the pairs, looked up by whole arrays at a time."""
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.mask, self.drop = np.int64((1 << bits) - 1), np.int64(62 - bits)
        self.slot_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << bits, _NONE // _SHIFT, dtype=np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            free = left[self.slot_keys[at[left]] < 0]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.slot_keys[at[first]], self.slot_ranks[at[first]] = keys[first], ranks[first]
            left = left[self.slot_keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x1E3779B97F4A7C15)) >> self.drop) & self.mask

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, or a very large number."""
        wanted = left * self.size + right
        wanted[(left < 0) | (right < 0)] = -2
        at = self._slot(wanted)
        got = self.slot_keys.take(at)
        out = self.slot_ranks.take(at)
        missed = np.flatnonzero(got != wanted)
        out[missed] = _NONE // _SHIFT
        for _ in range(self.probes):
            missed = missed[got[missed] >= 0]  # else the pair is in no slot
            if not len(missed):
                break
            at[missed] = (at[missed] + 1) & self.mask
            got[missed] = self.slot_keys.take(at[missed])
            hit = missed[got[missed] == wanted[missed]]
            out[hit] = self.slot_ranks.take(at[hit])
            missed = missed[got[missed] != wanted[missed]]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, (piece, rank) in enumerate(zip(pieces, map(self.ranks.get, pieces), strict=True)):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = np.array(self._merge_long(piece), dtype="<u4").tobytes()
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in groups.items():
            for lo in range(0, len(members), 4096):
                part = members[lo : lo + 4096]
                for i, ids in zip(part, self._merge_batch([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_batch(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Rows of trees: leaf j of a row is the pair that begins at byte j."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], -1)
        column = np.arange(width, dtype=np.int64)
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:] = np.minimum(self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width) * _SHIFT + column, _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        tree, flat = tree.ravel(), ids.ravel()
        after = np.tile(np.arange(1, width + 2), n)  # the next live position
        before = np.tile(np.arange(-1, width), n)
        row = np.arange(n)
        while len(row := row[tree.take(row * (2 * width) + 1) < _NONE]):
            base = row * (width + 1)
            root = tree.take(row * (2 * width) + 1)
            at, rank = root % _SHIFT, root // _SHIFT
            gone = after.take(base + at)
            beyond = after.take(base + gone)
            flat[base + at], flat[base + gone] = rank, -1
            after[base + at] = beyond
            before[base + beyond] = at
            prior = before.take(base + at)
            inner = np.flatnonzero(prior >= 0)
            beyond_ids = flat.take(base + beyond)
            pairs = self._pair(
                np.concatenate([rank, flat.take(base[inner] + prior[inner])]),
                np.concatenate([beyond_ids, rank[inner]]),
            ) * _SHIFT
            m = len(row)
            value = np.minimum(pairs[:m] + at, _NONE)
            prior_value = np.full(m, _NONE)
            prior_value[inner] = np.minimum(pairs[m:] + prior[inner], _NONE)
            # Leaves of the vanished position, of the merged one, and of the one before it.
            top = np.concatenate([row, row, row[inner]]) * (2 * width)
            node = np.concatenate([gone, at, prior[inner]]) + width
            tree[top + node] = np.concatenate([np.full(m, _NONE), value, prior_value[inner]])
            step = width
            while step > 1:
                node, step = node >> 1, step >> 1
                below = top + 2 * node
                tree[top + node] = np.minimum(tree.take(below), tree.take(below + 1))
        kept = ids >= 0
        ends = np.cumsum(4 * np.count_nonzero(kept, axis=1)).tolist()
        joined = ids[kept].astype("<u4").tobytes()
        return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """One tree in plain lists, for a piece of any length."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = width * self.size * 2
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        size, pair_rank = self.size, self.pair_rank
        tree = [none] * (2 * width)
        for j in range(n - 1):
            rank = pair_rank.get(ids[j] * size + ids[j + 1])
            if rank is not None:
                tree[width + j] = rank * width + j
        for node in range(width - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone] = rank, -1
            after[at] = beyond
            put(gone, none)
            value = none
            if beyond < n:
                before[beyond] = at
                got = pair_rank.get(rank * size + ids[beyond])
                value = none if got is None else got * width + at
            put(at, value)
            prior = before[at]
            if prior >= 0:
                got = pair_rank.get(ids[prior] * size + rank)
                put(prior, none if got is None else got * width + prior)
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; new pieces of all texts are merged in common batches."""
        matches = [self.pattern.findall(t) if t and len(t) <= PIECES else [] for t in texts]
        new = set().union(*matches).difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = set().union(*matches)
        self._learn(list(new))
        known = self.cache.__getitem__
        return [self._encode_long(t) if t and len(t) > PIECES else b"".join(map(known, m)) for t, m in zip(texts, matches, strict=True)]

    def _learn(self, new: list[str]) -> None:
        self.cache.update(zip(new, self.encode_pieces([m.encode("utf-8", "surrogatepass") for m in new]), strict=True))

    def _encode_long(self, text: str) -> bytes:
        """A text whose matches are not held all at once."""
        matches, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(matches, PIECES)):
            self._learn(list(set(part).difference(self.cache)))
            out.append(b"".join(map(self.cache.__getitem__, part)))
            if len(self.cache) > CACHE:
                self.cache = {}
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The encoder of a vocabulary file, once per Python worker."""
    return BytePairEncoder(load_ranks(path), pattern)


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids. ``vocabulary`` is a path that every executor can read."""

    def make():
        bpe = encoder(vocabulary, pattern)
        return lambda texts: {"ids": [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_all(texts)]}

    return map_texts(df, make, IDS, id_col, text_col, CHUNK_CHARS)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the bytes decoded from these ids."""

    def make():
        bpe = encoder(vocabulary, pattern)

        def apply(texts):
            ids = bpe.encode_all(texts)
            return {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

        return apply

    return map_texts(df, make, ENCODED, id_col, text_col, CHUNK_CHARS)
