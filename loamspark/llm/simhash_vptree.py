"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 hashes do.
Fingerprints link at ``RADIUS`` = 3 or fewer differing bits; classes are the connected
components of all links.

Distances between unrelated 64-bit fingerprints crowd around 32, so a tree over whole
fingerprints prunes little at radius 3. Two fingerprints within 3 bits are within 1 bit in
one 32-bit half at least, so there are two trees, one over each half, searched at radius 1;
a pair found by neither cannot exist. A tree node has a vantage half and a threshold; a
half at distance d of it lives on one side, and the triangle bound sends it to the other
side as well only where d is within 1 of the boundary. Leaves are the shards: every
fingerprint is dealt to each leaf its ball reaches, so both ends of a link meet in the
leaf where either of them lives. Trees are fitted on a bounded sample of fingerprints
(``sample``) and only decide how rows are dealt; every fingerprint is dealt, so the pairs
are exact whatever the sample.

Equal fingerprints are one row from the start, however many documents have them. A leaf
returns stars, from each of its linked fingerprints to the smallest of its local class,
never all pairs. Stars are joined to components by alternating large-star and small-star
rounds on checkpointed tables; no link or label is collected to the driver. The hub of a
star, and a fingerprint that many documents have, are joined in many tasks (``spread_join``).

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links
like any other. A class's id is its smallest doc_id; null ids are not counted, a class
that has none else has a null id. Repeated rows are repeated in the result. An empty table
gives an empty result. Very long texts are taken whole. Other columns do not matter,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.common import checkpointed, map_texts, spread_join

RADIUS = 3
SEED = 42
HALF_RADIUS = RADIUS // 2
#: Points of a leaf that are compared with each other.
SMALL_LEAF = 48
#: Rows by which a vantage point is chosen, where a node has more.
SPLIT_ROWS = 1024
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return digest(b" ".join(parts), SEED)
    shingles = zip(*(parts[i:] for i in range(words)), strict=False)
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), dtype=np.uint64, count=len(parts) - words + 1)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(df, make, T.StructType([T.StructField("fp", T.LongType())]), id_col, text_col)


@dataclass
class VantageTree:
    """Nodes as arrays; a child below zero is leaf -1 - child."""

    vantage: np.ndarray
    threshold: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, halves: np.ndarray, leaf_rows: int, seed: int = 7) -> VantageTree:
        """Split the sample until a leaf has ``leaf_rows`` of it or no split helps."""
        rng = np.random.default_rng(seed)
        vantage, threshold, near, far = [], [], [], []
        leaves = 0
        # Entries: rows of the sample, parent node, whether its far child.
        todo: list[tuple[np.ndarray, int, bool]] = [(halves.astype(np.uint32), -1, False)]
        while todo:
            rows, parent, is_far = todo.pop()
            split = cls._best_split(rows, rng) if len(rows) > leaf_rows else None
            if split is None:
                leaves += 1
                here = -leaves
            else:
                here = len(vantage)
                point, limit, d = split
                vantage.append(point)
                threshold.append(limit)
                near.append(0)
                far.append(0)
                todo += [(rows[d <= limit], here, False), (rows[d > limit], here, True)]
            if parent >= 0:
                (far if is_far else near)[parent] = here
        as_int = lambda x: np.array(x, dtype=np.int64)
        return cls(np.array(vantage, dtype=np.uint32), as_int(threshold), as_int(near), as_int(far), leaves)

    @staticmethod
    def _best_split(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.uint32, int, np.ndarray] | None:
        """The vantage point and threshold with the least overlap for the balance gained."""
        best, found = 0.75, None  # a split must tell apart more than it repeats
        some = rows if len(rows) <= SPLIT_ROWS else rows[rng.integers(0, len(rows), SPLIT_ROWS)]  # a split only decides how rows are dealt
        for point in rows[rng.integers(0, len(rows), 12)]:
            share = np.bincount(np.bitwise_count(some ^ point), minlength=34) / len(some)
            below = np.cumsum(share)
            for limit in range(33):
                p = below[limit]
                if 0.1 <= p <= 0.9:
                    both = share[max(0, limit - HALF_RADIUS + 1) : limit + HALF_RADIUS + 1].sum()
                    cost = np.log2(1 + both) / -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
                    if cost < best:
                        best, found = cost, (point, limit)
        return found and (*found, np.bitwise_count(rows ^ found[0]).astype(np.int64))

    def route(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves: each row with every leaf that its ball reaches."""
        if not len(self.vantage):
            return np.arange(len(halves)), np.zeros(len(halves), dtype=np.int64)
        rows, nodes = np.arange(len(halves)), np.zeros(len(halves), dtype=np.int64)
        out_rows, out_leaves = [], []
        while len(rows):
            d = np.bitwise_count(halves[rows] ^ self.vantage[nodes]).astype(np.int64)
            limit = self.threshold[nodes]
            to_near, to_far = d - HALF_RADIUS <= limit, d + HALF_RADIUS > limit
            rows = np.concatenate([rows[to_near], rows[to_far]])
            nodes = np.concatenate([self.near[nodes[to_near]], self.far[nodes[to_far]]])
            done = nodes < 0
            out_rows.append(rows[done])
            out_leaves.append(-1 - nodes[done])
            rows, nodes = rows[~done], nodes[~done]
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def local_classes(points: np.ndarray, radius: int = RADIUS, halves_: tuple[int, ...] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the linked classes among distinct points: (member, smallest member) without the centres.

    The points' own vantage-point trees, one over each half, deal them on to small leaves,
    each point to every leaf its ball reaches; points of one leaf are compared at every
    offset. A leaf of a whole tree needs only the half of its tree: links that are near in
    the other half alone meet in the other tree's leaves. A leaf that no vantage point splits (a dense ball) is searched breadth-first
    against what has not been reached yet, so it costs little more than its size.
    """
    points = np.unique(points.astype(np.uint64))
    n = len(points)
    parent = np.arange(n)

    def join(left: np.ndarray, right: np.ndarray) -> None:
        """Make the classes of each left and right one; the smaller root stays."""
        while len(left):
            left, right = find(left), find(right)
            differs = left != right
            left, right = left[differs], right[differs]
            np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))

    def find(at: np.ndarray) -> np.ndarray:
        while True:
            up = parent[parent[at]]
            if (up == parent[at]).all():
                return up
            parent[at] = up
            at = up

    for h in halves_ if n > 1 else ():
        halves = (points >> np.uint64(32 * h)).astype(np.uint32)
        rows, leaf = VantageTree.fit(halves, SMALL_LEAF).route(halves)
        order = rows[np.argsort(leaf, kind="stable")]
        leaf = np.sort(leaf, kind="stable")
        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        sizes = np.diff(np.append(starts, len(leaf)))
        dense = np.repeat(sizes > 2 * SMALL_LEAF, sizes)
        for k in range(1, min(2 * SMALL_LEAF, int(sizes.max()))):
            left = np.flatnonzero((leaf[k:] == leaf[:-k]) & ~dense[k:])
            if len(left):
                a, c = order[left], order[left + k]
                close = np.bitwise_count(points[a] ^ points[c]) <= radius
                join(a[close], c[close])
        for start, size in zip(starts[sizes > 2 * SMALL_LEAF], sizes[sizes > 2 * SMALL_LEAF], strict=True):
            _search(points, order[start : start + size], radius, join)
    roots = find(np.arange(n))
    linked = roots != np.arange(n)
    return points[linked], points[roots[linked]]


def _search(points: np.ndarray, run: np.ndarray, radius: int, join) -> None:
    left = run
    while len(left):
        seed, left = left[:1], left[1:]
        frontier = [seed]
        while frontier and len(left):
            at = frontier.pop()
            for i in at:
                close = np.bitwise_count(points[left] ^ points[i]) <= radius
                if close.any():
                    reached, left = left[close], left[~close]
                    join(np.full(len(reached), i), reached)
                    frontier.append(reached)
                if not len(left):
                    break


def link_stars(distinct: DataFrame, sample: int = 65_536, leaf_rows: int = 4096) -> DataFrame:
    """(a, b): stars whose connected components are those of all links between the column fp."""
    picked = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    known = np.array([r[0] for r in picked], dtype=np.int64).view(np.uint64)
    total = distinct.count()
    in_leaf = max(8, -(-leaf_rows * len(known) // max(total, 1)))
    trees = [VantageTree.fit((known >> np.uint64(32 * h)).astype(np.uint32), in_leaf) for h in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for h, tree in enumerate(trees):
                halves = (fps.view(np.uint64) >> np.uint64(32 * h)).astype(np.uint32)
                for lo in range(0, len(fps), 20_000):
                    rows, leaves = tree.route(halves[lo : lo + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(leaves * 2 + h), pa.array(fps[lo + rows])], names=["leaf", "fp"])

    def links(leaf: pa.Table) -> pa.Table:
        half = leaf.column("leaf")[0].as_py() % 2
        members, centres = local_classes(leaf.column("fp").to_numpy().view(np.uint64), halves_=(half,))
        return pa.table({"a": members.view(np.int64), "b": centres.view(np.int64)})

    return distinct.select("fp").mapInArrow(deal, "leaf long, fp long").groupBy("leaf").applyInArrow(links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): root is the smallest node of its component."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return spread_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = spread_join(down, least, "u", "v")
        return joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()

    current = checkpointed(edges.where("a != b").distinct())
    state = None
    while True:
        now = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(2**40 - 1)))).first()
        if now == state or not now[0]:
            break
        state = now
        current = checkpointed(small_star(large_star(current)))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, sample: int = 65_536, leaf_rows: int = 4096) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of ``df``."""
    marked = checkpointed(fingerprints(df, id_col, text_col, words))
    return attach_components(marked, F.col("doc_id"), sample, leaf_rows)


def attach_components(marked: DataFrame, number, sample: int = 65_536, leaf_rows: int = 4096) -> DataFrame:
    """``marked``, which has a column fp, with component_id: the smallest ``number`` in the class."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(number).alias("least")))
    roots = checkpointed(components(link_stars(distinct, sample, leaf_rows)))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = spread_join(classes.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    return spread_join(marked, of, "fp", "doc_id").select("doc_id", "fp", "component_id")


def hex_fingerprint(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``df``, with all columns, less all but one document of each class.

    The row with the smallest id stays, a null id after all others; of rows of one class with
    equal ids that with the smallest text hash, and of identical rows one. Rows of different
    classes never replace each other, whatever their ids.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    marked = checkpointed(fingerprints(df.select(key.alias("doc_id"), text_col), "doc_id", text_col, words))
    order = F.struct(F.col("doc_id.id").isNull().alias("missing"), F.col("doc_id.id").alias("id"), F.col("doc_id.hash").alias("hash"))
    found = checkpointed(attach_components(marked, order))
    first = order.eqNullSafe(F.col("component_id"))
    same = lambda keys: df[id_col].eqNullSafe(keys["id"]) & F.xxhash64(df[text_col]).eqNullSafe(keys["hash"])
    gone = found.where(~first).select("doc_id.*").distinct()
    kept = df.join(gone, same(gone), "left_anti")
    repeated = checkpointed(found.where(first).groupBy("doc_id").count().where("count > 1").select("doc_id.*"))
    if repeated.isEmpty():
        return kept
    one = kept.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, same(repeated), "left_anti").unionByName(one)
