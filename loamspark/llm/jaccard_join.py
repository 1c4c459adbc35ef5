"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A text's set has its distinct word n-grams as XXH64 hashes. Two sets link when
``100 * intersection >= THRESHOLD * union``.

Prefixes. All sets list their tokens in one global order, rare first: by the count of the
token's bucket in a sketch of fixed size over the whole corpus, then by hash. For a set of
n tokens, of which a linked set must share a = ceil(THRESHOLD * n / 100), the first
``n - a + L`` tokens hold at least L of the shared ones; so two linked sets share at least
min(Lx, Ly) tokens of their prefixes, whatever L each has chosen. A set chooses its own L:
for every L up to ``longest`` the lengths of the prefix tokens' lists give the rows that
must be matched, and divided by L a bound on the candidates that would have to be
verified; the L of least cost is taken. Sets in crowded lists get longer prefixes and
demand more shared tokens of their partners, unique sets stay at one.

Candidates. Linked sets are of the same class of lengths or of neighbouring ones
(``length_class``), so a token's list is taken apart into groups of two neighbouring
classes, and what is counted and matched is the group, not the list. Groups of up to
``heavy`` sets give pairs, at most ``heavy`` for each of their rows, counted and held
against min(Lx, Ly) and the lengths. Heavier groups give no pairs: each set is tied to the
group's first. Pairs and ties make families, the components of
``simhash_vptree.components``. Sets travel once to their family (a family of more than
``block`` sets by groups of classes again, larger groups in blocks, each pair of blocks a
task), where the prefixes are matched again and candidates verified against whole sets. A
task returns for each set the smallest of its class and the number of its links, never the
pairs. Every linked pair is inside one family and one group, so nothing is lost, however
they are dealt.

Equal sets are one from the start. Texts are hashed once for the sketch, once for the
prefixes, and those of family members once more, so that whole sets never go to disk.
Prefixes are written once, eight bytes a token; of these only tokens that a filter of
fixed size over the tokens seen twice lets through are shuffled with their sets. Sets are
named by the first eight bytes of their digest until they are compared; two of one name
are in one family if either is.

Defined cases: a text without words (null, empty, blank) has an empty set and links with
nothing. Fewer words than n: the whole sequence is the only n-gram. A class's id is its
smallest doc_id; null ids are not counted, a class that has none else has a null id.
Repeated rows are repeated in the result and link with each other. Very long texts are
taken whole. An empty table gives an empty result. Other columns do not matter, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.llm.common import checkpoint_folder, checkpointed, keyed_text, spread_join, text_runs
from loamspark.llm.simhash_vptree import components

WORDS, THRESHOLD, SEED = 3, 90, 42
#: Buckets of the corpus sketch, bits of the filters of family texts and of tokens seen twice, as powers of two: 2, 1 and 8 MB.
SKETCH_BITS, FILTER_BITS, TWICE_BITS = 18, 23, 26
#: Tasks that make a filter: each holds one and sends it to be merged.
FILTER_TASKS = 16
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(b" ".join(parts), SEED)], dtype=np.uint64)
    grams = zip(*(parts[i:] for i in range(words)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype=np.uint64, count=len(parts) - words + 1))


def set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def set_key(sid: bytes) -> int:
    """The first eight bytes of a digest, as a signed number."""
    return int.from_bytes(sid[:8], "big", signed=True)


def length_class(n: Column, threshold: int) -> Column:
    """Classes such that linked sets are in the same or in neighbouring ones: their lengths differ by 100 / threshold at most."""
    if threshold >= 100:
        return n.cast("int")
    return F.floor(F.ln(n) / (math.log(100 / threshold) * (1 + 1e-9))).cast("int")  # a little wider, so that rounding cannot part two classes


def needed(n, threshold: int = THRESHOLD):
    """Tokens that a set of n must share with any linked set."""
    return -(-threshold * n // 100)


def bucket(tokens: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def in_order(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Tokens in the global order, rare buckets first."""
    return tokens[np.lexsort((tokens, sketch[bucket(tokens)]))]


def _merged(parts: DataFrame, column: str, combine) -> np.ndarray | None:
    """Arrays of one fixed size, one a task, combined in a tree."""
    arrays = parts.where(F.col(column).isNotNull()).select(column).rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    return arrays.treeReduce(combine) if not arrays.isEmpty() else None


def described(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, uid, mark, n, sid) of every row, written in the shared folder, and the sketch of all sets.

    ``sid`` is a digest of the set, null for an empty one; ``mark`` a hash of the text.
    """
    narrow = keyed_text(df, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, any_row, id_type = np.zeros(1 << SKETCH_BITS, dtype=np.int64), False, pa.null()
        names = ["doc_id", "mark", "n", "sid", "sketch"]
        for batch in batches:
            id_type = batch.column(0).type
            for start, texts in text_runs(batch.column(1)):
                sets = [shingle_set(t, words) for t in texts]
                any_row = True
                sketch += np.bincount(bucket(np.concatenate(sets)), minlength=len(sketch))
                marks = np.array([xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, len(texts)), pa.array(marks), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(texts), pa.binary()),
                ], names=names)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([sketch.tobytes()], pa.binary())], names=names)

    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/jaccard-{uuid.uuid4().hex}"
    described_rows = narrow.mapInArrow(run, f"doc_id {kind}, mark long, n long, sid binary, sketch binary")
    described_rows.withColumn("uid", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path)
    sketch = _merged(back, "sketch", np.add)
    rows = back.where("sketch IS NULL").select("doc_id", "uid", "mark", "n", "sid")
    return rows, np.zeros(1 << SKETCH_BITS, dtype=np.int64) if sketch is None else sketch


def _filter(values: DataFrame, bits: int):
    """A filter of 2 ** ``bits`` bits over a column of hashes, null if there are none."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            at = np.unique(bucket(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([held.tobytes()], pa.binary())})

    found = _merged(values.coalesce(FILTER_TASKS).mapInArrow(flag, "bits binary"), "bits", np.bitwise_or)
    return values.sparkSession.sparkContext.broadcast(None if found is None else found.view(np.uint8))


def postings(df: DataFrame, sketch: np.ndarray, text_col: str, words: int, threshold: int, longest: int) -> DataFrame:
    """(token, sid, i, n): each set's longest prefix, i counting from 0, as its task finds it; sets are named by ``set_key``.

    Written in the shared folder; texts of one set in several tasks repeat its rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(sketch)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                parts, keys, places = [], [], []
                for text in texts:
                    tokens = shingle_set(text, words)
                    n = len(tokens)
                    if not n or (key := set_key(set_id(tokens))) in seen:
                        continue
                    seen.add(key)
                    prefix = in_order(tokens, shared.value)[: n - needed(n, threshold) + longest]
                    parts.append(prefix)
                    keys.append((key, n))
                    places.append(np.arange(len(prefix)))
                if parts:
                    each = [len(p) for p in parts]
                    named, lengths = (np.repeat(np.array(c, dtype=np.int64), each) for c in zip(*keys, strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(parts).view(np.int64)), pa.array(named), pa.array(np.concatenate(places), pa.int32()), pa.array(lengths),
                    ], names=["token", "sid", "i", "n"])

    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/jaccard-{uuid.uuid4().hex}"
    df.select(F.col(text_col).cast("string")).mapInArrow(run, "token long, sid long, i int, n long").write.parquet(path)
    return spark.read.parquet(path)


def seen_twice(posted: DataFrame, bits: int = TWICE_BITS) -> DataFrame:
    """The rows of ``posted`` whose token has another row, and few others: a filter of fixed size lets them through."""
    twice = _filter(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if twice.value is not None:
                at = bucket(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits)
                yield batch.filter(pa.array((twice.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return posted.mapInArrow(run, posted.schema)


def matches_chosen(found: DataFrame, threshold: int, longest: int) -> DataFrame:
    """(sid, n, L) from (sid, i, n, others): the L of least cost, found for all L at once.

    ``others`` is the number of other sets in the token's list that may link. Cost of L: the rows to match,
    C(L), and n / 16 steps for each of at most C(L) / L candidates.
    """
    base = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1  # tokens of the prefix for L = 1
    beyond = F.greatest(F.col("i") - base + 1, F.lit(0)).cast("int")  # the L - 1 from which the token is in the prefix
    steps = found.groupBy("sid", "n", beyond.alias("step")).agg(F.sum("others").alias("others"))
    held = steps.groupBy("sid", "n").agg(F.map_from_entries(F.collect_list(F.struct("step", "others"))).alias("by"))
    most = F.least(F.lit(longest), F.ceil(F.col("n") * threshold / 100)).cast("int")
    upto = lambda m: F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0).cast("long"), lambda s, k: s + F.coalesce(F.element_at("by", k), F.lit(0)))
    cost = lambda m: F.struct((upto(m) * (1 + F.col("n") / 16 / m)).alias("cost"), m.alias("m"))
    return held.select("sid", "n", F.array_min(F.transform(F.sequence(F.lit(1), most), cost))["m"].alias("matches"))


def candidate_ties(df: DataFrame, sketch: np.ndarray, text_col: str, words: int, threshold: int, longest: int, heavy: int) -> DataFrame:
    """(a, b): pairs of sets that may link, and ties of sets that share a heavy group of a list; sets by ``set_key``."""
    posted = checkpointed(seen_twice(postings(df, sketch, text_col, words, threshold, longest)).distinct())
    place = length_class(F.col("n"), threshold)
    lists = posted.groupBy("token", place.alias("k")).agg(F.count("*").alias("held")).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("k", "held"))).alias("by"))
    held = lambda away: F.coalesce(F.element_at("by", place + away), F.lit(0))
    # A list's sets that may link with this one, and the groups in which it is of the lower class and of the upper one.
    beside = {"others": held(-1) + held(0) + held(1) - 1, "low": held(0) + held(1), "up": F.when(held(-1) > 0, held(-1) + held(0)).otherwise(F.lit(0))}
    crowded = checkpointed(posted.join(lists, "token").select("token", "sid", "i", "n", *[v.cast("int").alias(c) for c, v in beside.items()]).where("others > 0"))
    matches = matches_chosen(crowded, threshold, longest)
    base = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    kept = checkpointed(crowded.join(matches, ["sid", "n"]).where(F.col("i") < base + F.col("matches") - 1).select("token", "sid", "n", "matches", "low", "up"))
    own, below = F.struct(place.alias("k"), F.col("low").alias("size")), F.struct((place - 1).alias("k"), F.col("up").alias("size"))
    grouped = lambda *groups: kept.select("token", "sid", "n", "matches", F.explode(F.array(*groups)).alias("g")).select("token", "g.k", "g.size", "sid", "n", "matches")
    light = lambda side, *groups: grouped(*groups).where(F.col("size").between(2, heavy)).select("token", "k", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "n", "matches")])
    near = (100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & ((length_class(F.col("n_a"), threshold) < length_class(F.col("n_b"), threshold)) | (F.col("sid_a") < F.col("sid_b")))
    met = light("a", own).join(light("b", own, below), ["token", "k"]).where(near)
    counted = met.groupBy("sid_a", "sid_b").agg(F.count("*").alias("shared"), F.first(F.least("matches_a", "matches_b")).alias("least"))
    pairs = counted.where(F.col("shared") >= F.col("least")).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
    dense = grouped(own, below).where(F.col("size") > heavy).select(F.struct("token", "k").alias("group"), "sid")
    firsts = dense.groupBy("group").agg(F.min("sid").alias("b"))
    ties = spread_join(dense, firsts, "group", "sid").where("sid != b").select(F.col("sid").alias("a"), "b")
    return pairs.unionByName(ties)


def local_links(
    sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray | None, threshold: int = THRESHOLD, matches: int = 4, upper: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(smallest position of the class, weight of links) for each of the sets of a family.

    With ``side``, only pairs of different sides are looked at, with ``upper`` none of two
    upper sets: these meet in their own group. Prefixes are matched again
    in the order of counts inside the family, ``matches`` tokens each (fewer where a set
    needs fewer); candidates are verified against whole sets.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.append(0, np.cumsum(sizes))
    rank = np.argsort(np.lexsort((tokens, counts)))  # place of a token in the family's order
    ordered = [np.sort(rank[column[starts[i] : starts[i + 1]]]) for i in range(n)]
    least = np.minimum(matches, needed(sizes, threshold))
    prefixes = [o[: len(o) - needed(len(o), threshold) + m] for o, m in zip(ordered, least, strict=True)]
    owner = np.repeat(np.arange(n), [len(p) for p in prefixes])
    flat = np.concatenate(prefixes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first, last = np.searchsorted(flat, flat, "left"), np.searchsorted(flat, flat, "right")
    back = np.argsort(order, kind="stable")
    at = np.append(0, np.cumsum([len(p) for p in prefixes]))
    root, links = np.arange(n), np.zeros(n, dtype=np.int64)
    mark = np.zeros(len(tokens), dtype=bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        rows = back[at[i] : at[i + 1]]
        spans = [owner[first[r] : last[r]] for r in rows[last[rows] - first[rows] > 1]]
        if not spans:
            continue
        partner, shared = np.unique(np.concatenate(spans), return_counts=True)
        ok = (partner > i) & (shared >= np.minimum(least[i], least[partner])) & (100 * np.minimum(sizes[i], sizes[partner]) >= threshold * np.maximum(sizes[i], sizes[partner]))
        if side is not None:
            ok &= side[partner] != side[i]
        if upper is not None and upper[i]:
            ok &= ~upper[partner]
        partner = partner[ok]
        if not len(partner):
            continue
        mark[ordered[i]] = True
        for lo in range(0, len(partner), 256):  # of long sets not too many at once
            some = partner[lo : lo + 256]
            hits = mark[np.concatenate([ordered[j] for j in some])]
            both = np.add.reduceat(hits, np.append(0, np.cumsum(sizes[some])[:-1]), dtype=np.int64)
            linked = some[100 * both >= threshold * (sizes[i] + sizes[some] - both)]
            links[i] += weights[linked].sum()
            links[linked] += weights[i]
            for j in linked:
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
        mark[ordered[i]] = False
    return np.array([find(i) for i in range(n)]), links


def family_sets(df: DataFrame, members: DataFrame, text_col: str, words: int) -> DataFrame:
    """(sid, tokens) of the members' sets from their texts, found again by a filter of fixed size over (sid, mark)."""

    bits = _filter(members.select("mark"), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                sids, sets = [], []
                for text in texts:
                    mark = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> (64 - FILTER_BITS)
                    if bits.value is None or not bits.value[mark >> 3] >> (mark & 7) & 1:
                        continue
                    tokens = shingle_set(text, words)
                    if len(tokens) and (sid := set_id(tokens)) not in seen:
                        seen.add(sid)
                        sids.append(sid)
                        sets.append(tokens.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.binary()), pa.array(sets, pa.binary())], names=["sid", "tokens"])

    again = df.select(F.col(text_col).cast("string")).mapInArrow(run, "sid binary, tokens binary")
    return again.join(members.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("tokens").alias("tokens"))


def family_tasks(members: DataFrame, block: int) -> DataFrame:
    """(sid, copies, root, group, lo, hi, own, upper): the tasks that a set goes to.

    A family of up to ``block`` sets is one task. A larger one is dealt by classes of
    lengths, a group having those of one class and, as upper sets, those of the next; groups
    of more than ``block`` sets in blocks, each pair of blocks a task.
    """
    small = F.col("size") <= block
    groups = F.explode(F.when(small, F.array(F.lit(-1))).otherwise(F.array("class", F.col("class") - 1))).alias("group")
    dealt = members.select("sid", "root", "copies", "class", "size", groups).withColumn("upper", ~small & (F.col("class") != F.col("group")))
    held = dealt.groupBy("root", "group").agg(F.count("*").alias("held"), F.count_if(~F.col("upper")).alias("lower")).where("lower > 0 and held > 1")
    known = held.select(F.struct("root", "group").alias("of"), F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    placed = spread_join(dealt.withColumn("of", F.struct("root", "group")), known, "of", "sid")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    paired = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return paired.select("sid", "copies", "root", "group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "upper")


def jaccard_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, longest: int = 8, heavy: int = 128, block: int = 1024
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (rows that the row links with), one row for each row of ``df``."""
    rows, sketch = described(df, id_col, text_col, words)
    key = F.conv(F.substring(F.hex("sid"), 1, 16), 16, -10).cast("long")
    sets = checkpointed(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("mark").alias("mark"), F.first("n").alias("n")))
    families = components(candidate_ties(df, sketch, text_col, words, threshold, longest, heavy))
    sizes = families.groupBy("root").agg(F.count("*").alias("size"))
    near = spread_join(families, sizes, "root", "node").join(sets.withColumn("node", key), "node")
    members = checkpointed(near.select("sid", "root", "size", "copies", "mark", length_class(F.col("n"), threshold).alias("class")))
    tasks = family_tasks(members, block).join(family_sets(df, members, text_col, words), "sid")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")
        own, upper = (table.column(c).to_numpy() for c in ("own", "upper"))
        across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        held = [np.frombuffer(t, dtype=np.uint64) for t in table.column("tokens").to_pylist()]
        root, links = local_links(held, table.column("copies").to_numpy(), own if across else None, threshold, upper=upper)
        linked = pa.array(np.flatnonzero(links))
        sids = table.column("sid").combine_chunks()
        return pa.table({"a": sids.take(linked), "b": sids.take(pa.array(root)).take(linked), "links": pa.array(links).take(linked)})

    found = checkpointed(tasks.groupBy("root", "group", "lo", "hi").applyInArrow(join, "a binary, b binary, links long"))
    classes = components(found.select("a", "b")).select(F.col("node").alias("sid"), "root")
    partners = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("sid"), "links")
    of = sets.join(classes, "sid", "left").join(partners, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    known = checkpointed(spread_join(of, least, "root", "sid").select("sid", "component_id", "n_links"))
    worded = spread_join(rows.where("sid IS NOT NULL"), known, "sid", "uid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = rows.where("sid IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(empty)
