"""Steps whose cost must grow no faster than their input, held against plain results."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamspark import session
from loamspark.llm import simhash_vptree
from loamspark.functions import embed
from loamspark.functions import pdf_rules as rules
from loamspark.functions import text as X
from loamspark.operators import chunking, counted, ordered, pdf, ranking, scoping
from loamspark.operators.blocks import line_blocks
from loamspark.operators.intent import analyzed
from loamspark.plans import retrieval
from loamspark.schemas import CHUNKS, conform
from loamspark.sources import html


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_of_contents_are_windows(spark):
    """A path never copies the paths before it; levels that skip places keep what stands above."""
    lines = [rules.CONTENTS] + [f"{k} Title{i} {i + 1}" for i, k in enumerate(("2.1.1", "1.1", "1.1.1.1", "1.2.1", "3", "3.1.1.1.1", "3.1.2", "4.1"))]
    df = spark.createDataFrame([("d", 1, lines), ("e", 1, lines[:3])], "document_id string, page_number int, lines array<string>")
    entries = pdf.contents_table(df)
    assert "collect_list" not in plan(entries)
    for document in ("d", "e"):
        path: list[str] = []
        for r in entries.where(F.col("document_id") == document).orderBy("seq").collect():
            path = pdf.below(path, r["level"], r["title"]) if path else [r["title"]]
            assert r["path"] == path
    assert entries.count() == 10


def test_documents_share_batches(spark):
    schema = pa.schema([("x", pa.int64())])
    assert [b.num_rows for b in ordered.batched(({"x": i} for i in range(ordered.BATCH_ROWS + 1)), schema)] == [ordered.BATCH_ROWS, 1]
    texts = spark.range(3000).select(F.col("id").cast("string").alias("document_id"), F.lit("f").alias("filename"), F.lit("u").alias("source_uri"), F.lit("text").alias("role"), F.when(F.col("id") % 3 > 0, F.lit("a\n\nb")).alias("text"))
    blocks = line_blocks(texts)
    assert "MapInPandas" not in plan(blocks) and blocks.count() == 2000
    rows = blocks.withColumns({"block_type": F.col("role"), "content": F.col("text")})
    merged = chunking.merge_short(rows)
    assert "FlatMapGroups" not in plan(merged)
    assert merged.count() == 2000 and merged.where("content = 'a\n\nb'").count() == 2000


def test_pages_are_read_a_few_at_a_time(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/b", "<title>t</title><main>x<h2>H</h2>y</main>")], "page_id long, url string, html string")
    got = html.extracted_pages(pages)
    assert "MapInPandas" not in plan(got) and "MapInPandas" not in plan(html.page_blocks(got))
    assert [(r["document_id"], r["source_uri"]) for r in html.page_blocks(got).collect()][-1] == ("2", "http://h/b#h")
    batch = pa.RecordBatch.from_pylist([{"x": i} for i in range(ordered.READ_ROWS * 2 + 1)])
    assert len(list(ordered.records([batch]))) == batch.num_rows


def test_terms_are_sought_once(spark):
    """What a rule looks for is a flag of the chunk or of the question, so pairs run no patterns."""
    rows = spark.createDataFrame([("ble only with nimble", "datasheet overview"), ("plain", None)], "t string, title string")
    said = rows.select(ranking.sought("text", F.col("t")).alias("s"), ranking.sought("title", F.col("title")).alias("n")).collect()
    at = ranking.SOUGHT["text"].index(("nimble",))
    assert [r["s"][at] for r in said] == [True, False]
    assert [list(r["n"])[:2] for r in said] == [[True, True], [False, False]]


def test_questions_are_sent_whole_while_they_are_few(spark, monkeypatch):
    few = spark.range(3)
    joined = lambda mark: spark.range(9).join(mark(few), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in joined(session.sent_whole(few))
    monkeypatch.setattr(session, "SENT_ROWS", 2)
    assert "strategy=broadcast" not in joined(session.sent_whole(few))


def test_a_leaf_is_searched_by_its_own_half():
    """Links near in one half are found by it alone; those of both halves together are all links."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = points
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    points = np.unique(np.concatenate([points, near]))
    linked = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    for half in (0, 1):
        found = dict(zip(*map(list, simhash_vptree.local_classes(points, halves_=(half,))), strict=True))
        shift = np.uint64(32 * half)
        close = np.bitwise_count(((points[:, None] ^ points[None, :]) >> shift).astype(np.uint32)) <= 1
        for i, j in zip(*np.nonzero(linked & close), strict=True):
            assert found.get(points[i], points[i]) == found.get(points[j], points[j])
        assert all(any(linked[i] & (points != p)) for i, p in enumerate(points) if p in found)


def test_a_title_meets_one_entry_of_a_page(spark):
    """Entries are cut to one for each page and key before titles meet them, so equal keys make no pairs."""
    titles = spark.createDataFrame([("d", p, f"表 1-1 t{p}") for p in range(6)] + [("d", 2, "表 9.9 none"), ("e", 1, "no number")], "document_id string, page_number int, title string")
    listed = spark.createDataFrame([("d", 9, "表1-1. late", 2, "table"), ("d", 3, "表1-1. here", 2, "table"), ("d", 1, "表1.1. before", 4, "table"), ("d", 0, "1.1 x", 2, "section")], "document_id string, seq int, title string, target_page int, kind string")
    got = pdf.canonical_titles(titles, listed)
    assert plan(got).count("Join") == 1
    assert {(r["page_number"], r["title"]): r["canonical"] for r in got.collect()} == {
        (0, "表 1-1 t0"): "表1-1. t0", (1, "表 1-1 t1"): "表1-1. here", (2, "表 1-1 t2"): "表1-1. here", (3, "表 1-1 t3"): "表1-1. here", (4, "表 1-1 t4"): "表1.1. before",
        (5, "表 1-1 t5"): "表1.1. before", (2, "表 9.9 none"): "表9.9. none", (1, "no number"): "no number",
    }


def test_patterns_run_only_where_they_may_match(spark):
    """What a sign needs is tested first and changes nothing."""
    texts = [None, "", "plain text", "乐鑫信息科技 4 esp32 技术参考手册 v1.0", "Espressif Systems 12", "esp32-C3 TRM (Version 1)", "chapter 3 Radio", "x Submit Documentation Feedback", "a GoBack", "7 汽车 a", "绪 论 3 b", "a 乐鑫信息科技 1 ESP32 v2 b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for sign in rules.NEEDED:
        pattern = "(?U)" + "|".join(f"(?:{p})" for p in rules.SIGNS[sign])
        plain = F.col("t")
        for p in rules.SIGNS[sign]:
            plain = F.regexp_replace(plain, f"(?U){p}", "-")
        got = rows.select(rules.says(F.col("t"), sign).alias("a"), F.col("t").rlike(pattern).alias("b"), rules.cut(F.col("t"), sign, "-").alias("c"), plain.alias("d")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got] and [r["c"] for r in got] == [r["d"] for r in got]
        assert any(r["a"] for r in got)


def test_white_space_is_matched_where_it_changes(spark):
    texts = ["a b", " a  b ", "a\tb", "a \t b\n", "\u3000a\xa0b\x85 c", "a\n \nb", "\x1ca b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert all(r[0] == r[1] for r in rows.select(X.compact(F.col("t")), plain).collect())
    assert rows.where(F.col("t") == "a b").select(F.size(F.regexp_extract_all("t", F.lit(X.SPACES), 0))).first()[0] == 0


def test_margins_are_found_without_a_row_for_each_line(spark):
    pages = spark.createDataFrame([("d", p, ["Head", f"line {p}", "x", " y  z ", "more", f"第 {p} 页"]) for p in range(1, 5)] + [("e", 1, [])], "document_id string, page_number int, lines array<string>")
    left = pdf.without_margins(pages)
    assert plan(left).count("Generate") == 1 and "posexplode" not in plan(left)
    got = {(r["document_id"], r["page_number"]): r["lines"] for r in left.collect()}
    assert got == {("e", 1): []} | {("d", p): ["x", "y z"] for p in range(1, 5)}


TEXTS = (
    "Running tests passed boxes is A/B® ble", None, "", "...", "the the host api 蓝牙 主机栈 x", "Blue tooth LE scans\nİs K", "ring ring rings ble-only", "低功耗蓝牙特征值 wi-fi", "the the host api 蓝牙 主机栈 x",
    "bluetooth low energy guides", "programming guide GAP Spp", "no term here", "a\u00a0b\u2028c the", "rolling  resistance coefficient",
)


def test_words_are_counted_where_texts_are_read(spark, monkeypatch):
    """Postings need no shuffle and equal those of single words, rows that share an id too."""
    monkeypatch.setattr(counted, "TEXTS", 3)
    for ids in (range(len(TEXTS)), (None, None, 1, 1, *range(2, len(TEXTS) - 2))):
        docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "id long, t string").coalesce(1)
        got = ranking.build_latin_index(docs, "id", F.col("t")).postings
        plain = ranking.build_index(docs, "id", X.latin_tokens(F.col("t"))).postings
        assert sorted(map(str, got.select("token", "chunk_id", "tf").collect())) == sorted(map(str, plain.select("token", "chunk_id", "tf").collect()))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    executed = ranking.build_latin_index(docs, "id", F.col("t")).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in executed and "Generate" not in executed


def test_a_search_moves_only_what_can_be_among_the_best(spark, monkeypatch):
    """One pass over texts equals the joins of postings, ties, slices and blocks of questions included."""
    monkeypatch.setattr(counted, "TEXTS", 3)
    docs = spark.createDataFrame([(100 - i, t) for i, t in enumerate(TEXTS * 3)], "id long, t string").coalesce(2)
    filled = docs.withColumn("t", F.coalesce("t", F.lit("")))
    questions = spark.createDataFrame([(7, "the host the tests"), (3, "BLE scan of 蓝牙"), (5, ""), (9, "zzz"), (4, "guide a b ring")], "question_id int, question string")
    for groups, tokens in (((), X.latin_tokens), (X.TERM_GROUPS, X.tokenize)):
        asked = ranking.question_tokens(questions, tokens(F.col("question")))
        index = ranking.build_index(filled, "id", tokens(F.col("t")))
        rows = lambda df: sorted((r["question_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
        lexical, shared = counted.search(asked, docs, "id", F.col("t"), 4, groups, block=2)
        assert rows(lexical) == rows(ranking.top_k(ranking.bm25(asked, index), 4))
        joined = index.postings.join(asked, "token").groupBy("question_id", "chunk_id").agg(F.count("*").cast("double").alias("score"))
        assert rows(shared) == rows(ranking.top_k(joined, 4)) and rows(shared)
        assert "postings" not in lexical.columns and "Join" not in plan(lexical)
    assert counted.search(asked.limit(0), docs, "id", F.col("t"), 4)[0].count() == 0


def shuffled(spark, run, *given) -> int:
    """Bytes that the stages of a run write for shuffles."""
    sc = spark.sparkContext
    bus, store, none = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages() -> dict:
        bus.waitUntilEmpty()
        found = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    run(*given).collect()
    return sum(n for stage, n in stages().items() if stage > before)


def test_normalized_scores_shuffle_no_more_over_more_texts(spark, sf_dir, tmp_path):
    """What moves are the k best of each task and question, not a row for each question, text and shared token."""
    docs, moved = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for times in (1, 6):
        folder = tmp_path / str(times)
        copies = docs.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 1_000_000).drop("copy")
        copies.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        (folder / "benchmark.parquet").symlink_to(f"{sf_dir}/benchmark.parquet")
        moved.append(shuffled(spark, retrieval.score_normalize, spark, str(folder)))
    assert 0 < moved[1] < 1.5 * moved[0]


def test_names_of_documents_are_looked_up(spark):
    """Documents do not meet every question; names shorter than six characters name nothing."""
    documents = spark.createDataFrame([("a", "Guide A", "20240101000000_guide_a.md", "/in/x/guide_a.md"), ("b", "Manual B", None, None), ("c", "ABC", "abc.d", None), ("d", None, "é tests 文.pdf", None)], "id string, title string, filename string, source_path string")
    questions = spark.createDataFrame([(1, "see  GUIDE A and manual b"), (2, "guide_a.md"), (3, "abc.d abc"), (4, ""), (5, None), (6, "in x\\\\guide_a: É TESTS 文.pdf"), (7, "manual")], "question_id int, question string")
    found = scoping.named_documents(questions, documents)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "a"), (1, "b"), (2, "a"), (6, "a"), (6, "d")]


def test_hints_are_found_in_the_pass_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(scoping, "HEADS", 3)
    texts = ["ble_start and start", None, "", "x restart ble", "void ble_stop() { }", "START é start_it", "no", "start"]
    rows = [(str(i), "d", "T", i, t, "code", "source_code", None) for i, t in enumerate(texts)]
    chunks = conform(spark.createDataFrame(rows, "id string, document_id string, document_title string, chunk_index int, content string, block_type string, doc_type string, symbol_name string"), CHUNKS).coalesce(1)
    heads = chunks.select("id", "document_id", F.lit("p").alias("profile"), F.lower(F.coalesce("content", F.lit(""))).alias("head"))
    hints = ["ble_start", "start", "void", "zzz"]
    got = {int(r["id"]): r["held"] for r in scoping.with_hints(heads, hints).collect()}
    assert got == {i: [h for h in hints if h in (t or "").lower()] for i, t in enumerate(texts)}
    assert all(r["held"] == [] for r in scoping.with_hints(heads, []).collect())
    asked = analyzed(spark.createDataFrame([(1, "function ble_start"), (2, "function start and void"), (3, "wheel")], "question_id int, question string"), 5)
    none = spark.createDataFrame([], "question_id int, document_id string")
    pairs = [sorted(map(tuple, scoping.question_scope(asked, chunks, none, symbols).pairs().collect())) for symbols in (None, scoping.Symbols.of(chunks))]
    assert pairs[0] == pairs[1] and (1, "0") in pairs[0]


def test_a_search_in_scopes_makes_no_pairs(spark, monkeypatch):
    """One pass over texts equals the joins of postings in each question's own chunks: profiles, lists, null and equal scores, slices and blocks included."""
    monkeypatch.setattr(counted, "TEXTS", 3)
    monkeypatch.setattr(counted, "PENDING", 2)
    docs = spark.createDataFrame([(str(100 - i), t, "ab"[i % 2]) for i, t in enumerate(TEXTS * 3)], "id string, t string, profile string").coalesce(2)
    filled = docs.withColumn("t", F.coalesce("t", F.lit("")))
    questions = spark.createDataFrame([(7, "the host the tests"), (3, "BLE scan of 蓝牙"), (5, ""), (9, "zzz"), (4, "guide a b ring"), (6, "the host ble")], "question_id int, question string")
    limits = spark.createDataFrame([(q, 2 + q % 3) for q in (3, 4, 5, 6, 7, 9)], "question_id int, limit int")
    allowed = spark.createDataFrame([(7, "a"), (7, "b"), (3, "b"), (4, "a"), (9, "a")], "question_id int, profile string")
    listed = docs.where("id % 5 = 0").select(F.lit(6).alias("question_id"), "id")
    scope = scoping.Scope(docs.select("id", F.col("id").alias("document_id"), "profile"), allowed, listed, listed.limit(0))
    for groups, tokens in (((), X.latin_tokens), (X.TERM_GROUPS, X.tokenize)):
        asked = ranking.question_tokens(questions, tokens(F.col("question")))
        index = ranking.build_index(filled, "id", tokens(F.col("t")))
        rows = lambda df: sorted((r["question_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
        scored = ranking.bm25(asked, index, scope.pairs().withColumnRenamed("id", "chunk_id"))
        want = rows(ranking.top_k(scored.join(limits, "question_id"), F.col("limit")))
        got = counted.scoped_search(asked, limits, docs, "id", F.col("t"), scope, groups, block=2)
        assert rows(got) == want and {r[0] for r in want} >= {4, 6, 7}
    assert counted.scoped_search(asked.limit(0), limits, docs, "id", F.col("t"), scope).count() == 0


def test_best_items_shuffle_no_more_over_more_texts(spark, sf_dir, tmp_path):
    docs, moved = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for times in (1, 6):
        folder = tmp_path / str(times)
        copies = docs.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 1_000_000).drop("copy")
        copies.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        (folder / "benchmark.parquet").symlink_to(f"{sf_dir}/benchmark.parquet")
        moved.append(shuffled(spark, retrieval.bm25_topk, spark, str(folder)))
    assert 0 < moved[1] < 1.5 * moved[0]


def test_texts_are_embedded_from_counts(spark, monkeypatch):
    """Vectors are those of the tokens, and no row has a list of them; equal texts have equal vectors."""
    monkeypatch.setattr(counted, "TEXTS", 3)
    docs = spark.createDataFrame(list(enumerate((*TEXTS, "ﬁne ＢＬＥ", TEXTS[0]))), "id long, t string").coalesce(1)
    made = embed.with_hash_provider(docs, F.col("t"), 32)
    assert "regexp_extract_all" not in plan(made) and made.columns == ["id", "t", "values"]
    got = {r["id"]: r["values"] for r in made.collect()}
    tokens = docs.select("id", X.tokenize(X.nfkc(F.coalesce("t", F.lit("")))).alias("tokens")).collect()
    assert all(np.allclose(got[r["id"]], embed.embed_tokens(r["tokens"], 32), atol=1e-12) for r in tokens)
    assert got[0] == got[len(TEXTS) + 1] and got[4] == got[8]


def test_no_line_is_shuffled_for_what_contents_say(spark):
    """Lines come out of their page's row after all joins, titles that contents list and pages they do not included."""
    pages = [("d", 1, [rules.CONTENTS, "1.1 Alpha 2", "1.2 Beta 3", rules.TABLES, "表1-1 Listed 2"]), ("d", 2, ["1.1 Alpha", "表 1-1 Some", "a | 1 2", "text goes on."]), ("d", 3, ["1.2 Beta", "plain", "表 9-9 Other", "b | 3 4"]), ("e", 2, ["alone"])]
    df = spark.createDataFrame(pages, "document_id string, page_number int, lines array<string>")
    entries = session.materialized(pdf.contents_table(df))
    lines = pdf.classified_lines(df, entries)
    top = plan(lines).split("Join", 1)[0]
    assert "Generate posexplode" in top
    got = {(r["document_id"], r["page_number"], r["i"]): r for r in lines.collect()}
    assert len(got) == sum(len(p[2]) for p in pages)
    assert [r["canonical"] for r in (got["d", 2, 1], got["d", 3, 2], got["d", 3, 1])] == ["表1-1. Listed", "表9-9. Other", None]
    assert got["d", 1, 0]["listed"] and got["e", 2, 0]["listed"] is None and list(got["d", 3, 0]["base"]) == ["1.1 Alpha", "1.2 Beta"] and got["e", 2, 0]["base"] is None
