"""Rules, decontamination, byte-level BPE, line dedup and near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from loamspark.llm import byte_bpe, decontamination, line_runs, queries_corpus, repetition_rules, simhash_vptree

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE_TEXTS = [None, "", " ", "\n\n", "a", "a b", "x " * 60, "word\n" * 80, "é 中文 😀 " * 30, "a" * 5000, "# $ % | <b>"]


def docs_of(spark, texts, extra=()):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """Extra columns whose names an operator might use itself."""
    for name in ("n_words", "gone", "fp", "kept", "ids", "items", "batch", "component_id", "leaf", "row", "th", "node"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


# --- repetition rules ---------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        hit = [False] * len(words)
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                hit[i : i + n] = [True] * n
        return hit

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(re.sub(r"[\x20\x09-\x0D]", "", line))
            seen.add(line)
    chars = sum(map(len, words))
    repeat = sum(covered(3))
    shares = [sum(len(w) for w, h in zip(words, covered(n), strict=True) if h) for n in (4, 7, 10)]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not (failed or any(100 * s > p * chars for s, p in zip(shares, (40, 30, 25), strict=True)) or 100 * dup_chars > 40 * chars)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, repeat, dup_chars, *shares, failed, kept


def test_rules_match_brute_force(spark):
    rnd = random.Random(3)
    texts = EDGE_TEXTS + [" ".join(rnd.choice(["aa", "b", "ccc", "dé"] + [f"w{k}" for k in range(rnd.choice([1, 30, 400]))]) for _ in range(rnd.randint(0, 150))) for _ in range(60)]
    texts += ["\n".join(rnd.choice(["one line here", "other", "", " \t"]) for _ in range(9)) for _ in range(10)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repetition_rules.repetition_rules(with_clashes(docs_of(spark, texts))).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_rules_keep_filter_and_empty_table(spark):
    good = " ".join(f"w{i}" for i in range(80))
    df = docs_of(spark, [good, "bad", None, good])
    assert sorted(r[0] for r in repetition_rules.keep_by_repetition(df).collect()) == [0, 3]
    assert repetition_rules.repetition_rules(df.limit(0)).count() == 0


def test_exact_triples_with_many_numbers():
    ids = np.array([0, 5_000_000, 1, 0, 5_000_000, 1], dtype=np.int64)
    keys = repetition_rules._exact_triples(ids, 5_000_001)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 3


# --- decontamination ----------------------------------------------------------------


def brute_hits(text, items, window=10):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = low(text), set(), set()
    for item_id, item in items:
        ws = low(item)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == ws[i : i + n]:
                    hit.update(range(j, j + n))
                    if item_id is not None:
                        found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_chars", [10**7, 150])
def test_decontamination_matches_brute_force(spark, block_chars):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("ab cd é Z9".split()) for _ in range(n))
    items = [(1, say(14)), (2, "Short one"), (3, None), (4, ""), (10, say(30)), (None, "nameless thing"), (2, "Short one"), (5, "É")]
    texts = EDGE_TEXTS + [say(rnd.randint(0, 80)) for _ in range(30)] + ["x short, ONE y", "shortone", "a nameless -- thing", (items[0][1] + " ") * 3, "É é"]
    df, bench = with_clashes(docs_of(spark, texts)), spark.createDataFrame(items, "item_id long, text string")
    scanned = decontamination.decontaminate(df, bench, block_chars=block_chars)
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.contamination_report(scanned).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = {r[0] for r in decontamination.drop_contaminated(docs_of(spark, texts), bench, block_chars=block_chars).select("doc_id").collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_hits(t, items)[-1]}


def test_hit_spans_point_into_the_original():
    scanner = decontamination.WindowScanner(decontamination.windows_of([(7, "Alpha, BETA gamma")], 10))
    text = "é!! alpha -- Beta\tGAMMA? and alpha beta"
    assert [text[a:b] for a, b in scanner.scan(text)[2]] == ["alpha -- Beta\tGAMMA"]


def test_empty_benchmark(spark):
    df = docs_of(spark, ["some words", None])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontamination.contamination_report(decontamination.decontaminate(df, none)).collect()] == [False, False]


# --- byte-level BPE ------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_matches_the_library(bpe, reference):
    rnd = random.Random(1)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), 0x3000, 0x4E2D, 0x1F600, 0x85, 0xA0, 0x2028, 0xFEFF, 0x180E]]
    texts = ["".join(rnd.choice(letters) if rnd.random() < 0.6 else rnd.choice("  ab \n'") for _ in range(rnd.randint(0, 80))) for _ in range(600)]
    texts += [x for x in EDGE_TEXTS if x] + ["ab" * 700, " " * 900 + "x", "".join(rnd.choice("abcde") for _ in range(3000))]
    got = bpe.encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x) for x in got] == [t.encode() for t in texts]


def test_bpe_long_text_in_parts(bpe, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 50)
    text = "Some words, 12 and  more.\n" * 40
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_cache_is_bounded(bpe, monkeypatch, reference):
    monkeypatch.setattr(byte_bpe, "CACHE", 20)
    for text in ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten eleven"):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_query_shape(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = {r["doc_id"]: r for r in byte_bpe.round_trip(with_clashes(docs_of(spark, EDGE_TEXTS)), path, pattern).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode_documents(docs_of(spark, EDGE_TEXTS), path, pattern).collect()}
    assert [len(ids[i]) for i in range(len(EDGE_TEXTS))] == [rows[i]["n_tokens"] for i in range(len(EDGE_TEXTS))]


# --- line dedup -------------------------------------------------------------------------


def worded(text):
    """Numbers of the lines that hold a letter or digit, and these lines."""
    found = [(k, x) for k, x in enumerate(text.split("\n")) if any(c.isalpha() or c.isnumeric() for c in x)]
    return [k for k, _ in found], [x for _, x in found]


def in_order(rows):
    """Distinct (doc_id, text), null ids first, equal ids by text hash."""
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    return sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))


def brute_lines(rows, min_lines=3, min_words=10):
    """Line numbers to delete of each distinct (doc_id, text): every later copy of every run, longest runs first."""
    docs = in_order(rows)
    seqs = {d: worded(d[1]) for d in docs}
    gone = {}
    seen = set()  # all runs of all earlier places
    for d in docs:
        numbers, lines = seqs[d]
        cut = set()
        for i in range(len(lines)):
            for n in range(len(lines) - i, 0, -1):
                run = tuple(lines[i : i + n])
                if run in seen:
                    if n >= min_lines or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= min_words:
                        cut.update(range(i, i + n))
                    break
            seen.update(tuple(lines[i : i + n]) for n in range(1, len(lines) - i + 1))
        lost = {numbers[c] for c in cut}
        for c in range(len(numbers) - 1):
            if c in cut and c + 1 in cut:
                lost.update(range(numbers[c], numbers[c + 1]))
        gone[d] = sorted(lost)
    return gone


def without(text, lines):
    return text if text is None or not lines else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lines)


def numbers_of(runs):
    return [k for r in runs for k in range(r["first"], r["last"] + 1)]


POOL = ["short", "", "a line of some ten words that is long enough now", "two words", "x", "    }", "---", "another long line with ten words in it for sure yes"] + [f"unique {i}" for i in range(30)]


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14))) for _ in range(50)] + EDGE_TEXTS + ["y\n" * 40]
    long_run = "\n".join(f"row {k}" for k in range(50))
    texts += [long_run, "head\n" + long_run + "\ntail", "\n".join(f"row {k}" for k in range(3, 40)) + "\nother", "p\nrow 7\nq", "p2\nrow 7\nrow 8\nrow 9\nrow 10\nq2"]
    df = docs_of(spark, texts, extra=[(None, texts[3], "en", "s", 1), (None, None, None, None, None), (0, "other\n" + texts[1], "en", "s", 1), (0, "other\n" + texts[1], "en", "s", 1)])
    rows = [(r[0], r[1]) for r in df.collect()]
    want = brute_lines(rows)
    clashing = with_clashes(df).selectExpr("*", "'y' as runs", "'y' as t1", "'y' as d", "'y' as r")
    out = line_runs.dedup_lines(clashing, runs_col="stretches")
    assert out.columns == [*clashing.columns, "stretches"]
    got = [(r["doc_id"], r["text"], numbers_of(r["stretches"]), r["gone"], r["runs"]) for r in out.collect()]
    expected = [(i, without(t, want.get((i, t), [])), want.get((i, t), []), "x", "y") for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2])
    assert sorted(got, key=key) == sorted(expected, key=key)
    with pytest.raises(ValueError):
        line_runs.dedup_lines(clashing, runs_col="gone")


def test_line_dedup_over_many_ranges(spark, monkeypatch):
    """Classes and intervals that run over several ranges: one line as most of the table."""
    monkeypatch.setattr(line_runs, "BLOCK", 16)
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["the one common line", "c 1", "c 2", f"own {i}"]) for _ in range(8)) for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, t) for i, t in enumerate(texts)]
        got = {r["doc_id"]: numbers_of(r["s"]) for r in line_runs.dedup_lines(docs_of(spark, texts), runs_col="s").collect()}
        want = brute_lines(rows)
        assert got == {i: want[i, t] for i, t in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_code_and_blank_lines_are_no_runs(spark):
    code = "int {0}() {{\n  if ({0}) {{\n    go({0});\n    }}\n  }}\n}}\n\n\n"
    texts = [code.format(n) for n in ("one", "two", "three")]
    assert sorted(r["text"] for r in line_runs.dedup_lines(docs_of(spark, texts)).collect()) == sorted(texts)


def test_runs_that_overlap_themselves(spark):
    """Six equal lines are four equal runs of three; all but the first are later copies, which covers all lines but one."""
    rows = [(1, "\n".join(["four words a line"] * 6)), (2, "\n".join(["some other short line"] * 2 + ["end of it here"]))]
    got = {r["doc_id"]: r["text"] for r in line_runs.dedup_lines(docs_of(spark, [t for _, t in rows])).collect()}
    want = brute_lines(list(enumerate(t for _, t in rows)))
    assert got[0] == "four words a line" and got[1] == rows[1][1]
    assert len(want[0, rows[0][1]]) == 5


def test_a_vocabulary_must_hold_every_byte():
    ranks = {bytes([b]): b for b in range(256)}
    assert byte_bpe.BytePairEncoder(ranks, r"\S+|\s+") is not None
    del ranks[b"q"]
    with pytest.raises(ValueError, match="113"):
        byte_bpe.BytePairEncoder(ranks, r"\S+|\s+")


def test_line_dedup_longer_runs_and_empty(spark):
    df = docs_of(spark, ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "b\nc\nd\ne\nz"])
    four = {r[0]: r[1] for r in line_runs.dedup_lines(df, min_lines=4, min_words=99).select("doc_id", "text").collect()}
    assert four == {0: "a\nb\nc\nd\ne", 1: "x\ny", 2: "z"}
    assert line_runs.dedup_lines(df.limit(0)).count() == 0 and line_runs.dedup_lines(df.limit(0)).columns == df.columns
    assert line_runs.maximal_runs(df.limit(0)).count() == 0
    single = spark.createDataFrame([("k", "only text")], "doc_id string, text string")
    assert [tuple(r) for r in line_runs.dedup_lines(single).collect()] == [("k", "only text")]


def brute_maximal(rows):
    """(doc_id, first, last, lines) of runs that recur and cannot be extended to either side."""
    docs, seen = [], set()
    for i, t in in_order(rows):
        if t not in seen:
            seen.add(t)
            docs.append((i, *worded(t)))
    places = [(k, c) for k, (_, _, lines) in enumerate(docs) for c in range(len(lines))]

    def common(a, b):
        x, y, n = docs[a[0]][2], docs[b[0]][2], 0
        while a[1] + n < len(x) and b[1] + n < len(y) and x[a[1] + n] == y[b[1] + n]:
            n += 1
        return n

    longest = {p: max((common(p, q) for q in places if q != p), default=0) for p in places}
    return sorted(
        (docs[k][0], docs[k][1][c], docs[k][1][c + n - 1], n) for (k, c), n in longest.items() if n and longest.get((k, c - 1), 0) <= n
    )


def test_maximal_runs_match_brute_force(spark):
    rnd = random.Random(12)
    texts = ["\n".join(rnd.choice(POOL[:9]) for _ in range(rnd.randint(0, 10))) for _ in range(25)] + ["y\n" * 21]
    long_run = "\n".join(f"row {k}" for k in range(50))
    texts += [long_run + "\nend", "head\n" + long_run, "\n".join(f"row {k}" for k in range(5, 42))]
    got = sorted(tuple(r) for r in line_runs.maximal_runs(docs_of(spark, texts)).collect())
    assert got == brute_maximal(list(enumerate(texts)))
    assert {n for *_, n in got} >= {1, 2, 37, 50}


def test_line_dedup_plan_is_native(spark, sf_dir):
    plan = queries_corpus.op5_line_dedup(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- near-dedup ---------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, fingerprint) to the smallest id reachable."""
    fps = sorted({f for _, f in rows})
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f, least.get(root(f))) for i, f in rows), key=repr)


def test_fingerprints_match_brute_force(spark):
    texts = EDGE_TEXTS + ["The quick Brown fox jumps over the lazy dog É", "one two", "A a a A a"]
    got = {r[0]: r[1] % 2**64 for r in simhash_vptree.fingerprints(docs_of(spark, texts)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_components_match_brute_force(spark):
    rnd = random.Random(4)
    rows, n = [], 0
    for _ in range(60):  # chains of small steps, stars, lone points and equal points
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 6, 25])):
            rows.append((n, f))
            n += 1
            for _ in range(rnd.randint(0, 4)):
                f ^= 1 << rnd.randrange(64)
    rows += [(rows[5][0], rows[5][1]), (None, rows[9][1]), (None, rnd.getrandbits(64)), (n + 5, 0), (n + 6, 0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in rows], "doc_id long, fp long")
    from pyspark.sql import functions as F

    for sample, leaf in ((65_536, 4096), (64, 4), (7, 1)):
        got = simhash_vptree.attach_components(df, F.col("doc_id"), sample, leaf).collect()
        assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == brute_components(rows)


def test_dense_group_and_tree_routing():
    rng = np.random.default_rng(0)
    points = np.unique(np.concatenate([rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (300, 4), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)]))
    members, centres = simhash_vptree.local_classes(points)
    star = dict(zip(members.tolist(), centres.tolist(), strict=True))
    want = {f: c for _, f, c in brute_components([(int(p), int(p)) for p in points])}
    assert {int(p): star.get(int(p), int(p)) for p in points} == want
    halves = rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32)
    tree = simhash_vptree.VantageTree.fit(halves, 50)
    assert tree.leaves > 10
    home = lambda h: set(tree.route(np.array([h], dtype=np.uint32))[1].tolist())
    for h in halves[:50]:  # two halves a bit apart share a leaf
        assert home(h) & home(h ^ np.uint32(1 << int(rng.integers(0, 32))))


def test_keep_first_of_each(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w150", "other")
    assert (brute_fingerprint(base) ^ brute_fingerprint(near)).bit_count() <= 3
    texts = ["something else entirely here", base, near, base]
    df = with_clashes(docs_of(spark, texts, extra=[(1, base, "en", "s", 1), (None, None, None, None, None)]))
    kept = simhash_vptree.keep_first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[0]) for r in kept.collect()) == [(False, 0), (False, 1), (True, None)]
    assert simhash_vptree.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_query_matches_brute_force(spark, sf_dir):
    """The whole query over the smallest tables."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components([(i, brute_fingerprint(t)) for i, t in docs])
    got = queries_corpus.op9_simhash(spark, sf_dir).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted(want)


def test_one_fingerprint_as_most_of_the_table(spark):
    texts = [""] * 300 + ["some words that stand alone"] * 3 + [None]
    got = simhash_vptree.near_duplicates(docs_of(spark, texts)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, 0 if i < 300 or i == 303 else 300) for i in range(304)]
