"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from loamspark.llm import jaccard_join, queries_corpus
from loamspark.llm.common import read_table

WHITE = {9, 10, 11, 12, 13, 32}


def plain_sets(texts):
    out = []
    for text in texts:
        words, word = [], ""
        for ch in text or "":
            if ord(ch) in WHITE:
                words, word = words + [word] * bool(word), ""
            else:
                word += chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch
        words += [word] * bool(word)
        grams = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()
        out.append(grams)
    return out


def plain(rows, threshold=90):
    """Sorted (doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = plain_sets([t for _, t in rows])
    n = len(rows)
    root, links = list(range(n)), [0] * n
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted(((d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=key)


def got(df, **options):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted((tuple(r) for r in jaccard_join.jaccard_classes(df, **options).collect()), key=key)


def near_copies(rng, groups, size, words, edits, first=0):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((first + len(rows), " ".join(copy)))
    return rows


def test_whole_query(spark, sf_dir):
    rows = [tuple(r) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    out = queries_corpus.op11_jaccard_join(spark, sf_dir).collect()
    assert sorted(map(tuple, out)) == plain(rows) and any(r.n_links for r in out)


@pytest.mark.parametrize("options", [{}, {"heavy": 4, "block": 9, "longest": 2}])
def test_near_copies_and_edges(spark, options):
    rng = random.Random(4)
    rows = near_copies(rng, 12, 6, 70, 5) + near_copies(rng, 1, 60, 120, 9, 1000) + near_copies(rng, 1, 40, 120, 2, 1500) + near_copies(rng, 30, 2, 12, 1, 2000)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "one two three four"), (None, "One two three FOUR"), (5003, "a b"), (5004, "A  b"), (5005, "a"), (5006, "a b c"), (5006, "a b c"), (5006, "other words here"), (None, "alone in null"), (5007, "É a b"), (5008, "é a b")]
    rows += [(6000 + i, " ".join(f"long{j}" for j in range(6000 + i))) for i in range(3)]
    df = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows], "doc_id long, text string, sid string, token int, n int, mark int").repartition(5)
    want = plain(rows)
    assert got(df, **options) == want and sum(r[3] > 20 for r in want) > 10


def test_other_thresholds_and_an_empty_table(spark):
    rng = random.Random(9)
    rows = near_copies(rng, 6, 5, 40, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (70,):
        assert got(df, threshold=threshold) == plain(rows, threshold)
    assert got(df.limit(0)) == []


def test_prefixes_share_what_they_promise():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 5, 1 << jaccard_join.SKETCH_BITS)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.append(rng.permutation(x)[: max(1, int(len(x) * 0.97))], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both):
            continue
        for lx in range(1, 6):
            for ly in range(1, 6):
                a = jaccard_join.in_order(x, sketch)[: len(x) - jaccard_join.needed(len(x)) + min(lx, jaccard_join.needed(len(x)))]
                b = jaccard_join.in_order(y, sketch)[: len(y) - jaccard_join.needed(len(y)) + min(ly, jaccard_join.needed(len(y)))]
                assert len(np.intersect1d(a, b)) >= min(lx, ly, jaccard_join.needed(len(x)), jaccard_join.needed(len(y)))


def test_a_passage_in_texts_of_all_lengths_makes_no_family(spark):
    """A list is counted by lengths that can link, so what many texts of different lengths share ties none of them."""
    passage = " ".join(f"p{i}" for i in range(24))
    rows = [(100 * k + c, passage + "".join(f" u{k}x{c}x{i}" for i in range(int(30 * 1.5**k)))) for k in range(10) for c in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sketch = np.zeros(1 << jaccard_join.SKETCH_BITS, dtype=np.int64)
    found = jaccard_join.candidate_ties(df, sketch, "text", 3, 90, 8, 8)
    sizes = [r["count"] for r in jaccard_join.components(found).groupBy("root").count().collect()]
    assert max(sizes, default=0) <= 3
    assert got(df, heavy=8, block=2) == plain(rows)


def test_large_families_are_dealt_by_lengths(spark):
    """A set meets those of its length and not all of its family, and each pair that can link once."""
    lengths = [int(20 * 1.06**i) for i in range(60)]
    members = spark.createDataFrame([(bytes([i]), 1, len(lengths), 1, i, n) for i, n in enumerate(lengths)], "sid binary, root long, size long, copies long, mark long, n long")
    tasks = jaccard_join.family_tasks(members.withColumn("class", jaccard_join.length_class(jaccard_join.F.col("n"), 90)), 8).collect()
    met = {}
    for r in tasks:
        met.setdefault((r["group"], r["lo"], r["hi"]), []).append(r)
    pairs = [
        tuple(sorted((a["sid"][0], b["sid"][0]))) for (_, lo, hi), rows in met.items() for i, a in enumerate(rows) for b in rows[i + 1 :]
        if not (a["upper"] and b["upper"]) and (lo == hi or a["own"] != b["own"])
    ]
    near = {(i, j) for j, n in enumerate(lengths) for i in range(j) if 100 * lengths[i] >= 90 * n}
    assert len(pairs) == len(set(pairs)) and near <= set(pairs)
    assert len(tasks) <= 3 * len(lengths)
