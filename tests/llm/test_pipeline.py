"""The pipeline against a brute-force version of its stages."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from loamspark.llm import byte_bpe, simhash_vptree

from .test_corpus_ops import brute_components, brute_fingerprint, brute_hits, brute_lines, brute_rules


def brute_line_stage(rows):
    """(id, text) after line dedup, less what keeps under 50 words and under a quarter of its words."""
    gone = brute_lines(rows)
    cut = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]) if gone[i, t] else t for i, t in rows]
    return [(i, c) for (i, t), c in zip(rows, cut, strict=True) if not gone[i, t] or len(c.split()) >= 50 or 4 * len(c.split()) >= len(t.split())]


def lines_of(name, n, width=12):
    return [" ".join(f"{name}{k}w{j}" for j in range(width)) for k in range(n)]


def test_line_stage_keeps_unique_remnants(spark):
    licence = lines_of("licence", 1, 12)
    a, b = "\n".join(licence + lines_of("a", 5)), "\n".join(licence + lines_of("b", 4, 11))
    base = lines_of("base", 30)
    near = "\n".join([*base[:29], base[29] + " again"])
    passage = lines_of("passage", 10)  # most of c and d, whose own words resemble nothing
    c, d = "\n".join(passage + lines_of("c", 1)), "\n".join(passage + ["other words of d", *lines_of("d", 2, 9)])
    only = "\n".join(passage[:5] + base[:5])
    rows = [(1, a), (2, b), (3, "\n".join(base)), (4, near), (5, c), (6, d), (7, only), (8, "\n".join(base)), (9, "\n".join(base))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert {i: r["text"] for i, r in got.items()} == dict(brute_line_stage(rows))
    assert got[2]["text"] == "\n".join(lines_of("b", 4, 11)) and got[2]["n_chars"] == len(got[2]["text"])
    assert 4 not in got and 8 not in got and 9 not in got


def test_every_class_keeps_one(spark):
    """On given tables: nearly all classes of documents over whole texts have a survivor of the stage, and these documents stay."""
    source = "/root/testdata/sf0.01"
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{source}/documents.parquet"), source).cache()
    left = {r[0] for r in corpus_pipeline.line_dedup(spark, docs, source).select("doc_id").collect()}
    classes = simhash_vptree.near_duplicates(docs).collect()
    members = {}
    for r in classes:
        members.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert sum(not m & left for m in members.values()) <= 1 and {56, 255, 464, 875} - left <= {56, 255, 464}
    docs.unpersist()


def test_pipeline_matches_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs if r["n_chars"] < 6000 or r["doc_id"] % 3 == 0]  # long ones too
    rows += [(10_001, rows[0][1], "en", "s", 1), (10_002, None, "en", "s", None), (10_003, rows[1][1] + " more", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]

    left = [(i, t) for i, t, *_ in rows if brute_rules(t)[-1]]
    left = brute_line_stage(left)
    first = {i for i, _, least in brute_components([(i, brute_fingerprint(t)) for i, t in left]) if i == least}
    left = [(i, t) for i, t in left if i in first and not brute_hits(t, items)[-1]]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    want = {}
    for i, t in left:
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())

    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(got) > 50 and got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "tokenize"]


def test_one_row_of_each_class_stays(spark):
    """Equal and null ids in different classes do not replace each other."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[0]), (7, texts[4]), (7, texts[4]), (9, texts[4])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    want = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4])]
    key = lambda r: (r[0] or 0, r[1])
    for given, kept in ((df, want), (df.where("doc_id is null"), [(None, t) for t in (texts[0], texts[2], texts[3])])):
        got = simhash_vptree.keep_first_of_each(given)
        assert got.columns == df.columns
        assert sorted((tuple(r)[:2] for r in got.collect()), key=key) == sorted(kept, key=key)


def test_stages_on_edge_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, extra columns and empty tables in every stage."""
    long_text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, long_text, "en", "s", 1), (1, long_text, "en", "s", 1), (None, None, None, None, None), (None, long_text + " x", "en", "s", 2), (3, "", "en", "s", 0), (4, "\n".join(f"a{i} b{i} c{i}" for i in range(40)), "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as runs", "'y' as fp", "'z' as kept")
    spark.createDataFrame([(1, "a benchmark item of some ten words that nothing has here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (full, full.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs.selectExpr("*", "1 as extra"), str(tmp_path))
            assert docs.columns == corpus_pipeline.COLUMNS, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(r["doc_id"] for r in last) == ([] if given is not full else [1, 4])
