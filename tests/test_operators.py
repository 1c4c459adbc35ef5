"""Operators, sources, stored tables, conversations and streams on hand-written inputs."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loamspark.functions import embed, remote, text
from loamspark.functions import pdf_rules as rules
from loamspark.functions.embed import embed_tokens, vector_records
from loamspark.operators import answering, chunking, evaluation, models, pdf, postings, ranking, scoping, sessions
from loamspark.operators.blocks import Block, blocks_of_lines, blocks_of_paragraphs
from loamspark.operators.intent import analyzed
from loamspark.schemas import BLOCKS, CHUNKS, VECTORS, conform
from loamspark.sources import files, html
from loamspark.sources.store import Conflict, Store, collection_key, upserted
from loamspark.streaming import ingest

MARKDOWN = "# Top\nintro\n### Deep\na\n### Deeper\n```c\nint x;\n```\nafter\n# bad|title\nend"


def test_line_blocks_follow_headings_and_fences():
    got = [(b.role, b.section_path, b.line_start, b.line_end, b.text) for b in blocks_of_lines(MARKDOWN.splitlines(), "f.md")]
    assert got == [
        ("text", ["Top"], 2, 2, "intro"),
        ("text", ["Top", "Deep"], 4, 4, "a"),
        ("code", ["Top", "Deep", "Deeper"], 7, 8, "int x;"),
        ("text", ["Top", "Deep", "Deeper"], 9, 11, "after\n# bad|title\nend"),
    ]


def test_code_symbols_sizes_and_open_fences():
    code = ["int ble_start(void) {", "  return 1;", "}", "def main():", "  pass"]
    assert [(b.symbol_name, b.section_path) for b in blocks_of_lines(code, "a.c", role="code")] == [("ble_start", ["ble_start"]), ("main", ["main"])]
    long = list(blocks_of_lines(["~~~", *["x" * 700] * 5], "f"))
    assert [b.role for b in long] == ["code"] * 3 and long[-1].line_end == 6
    assert [b.line_end for b in blocks_of_lines(["a"] * 200, "f", max_lines=80)] == [80, 160, 200]
    assert list(blocks_of_lines([], "f")) == []


def test_paragraphs_are_packed_by_scope():
    paragraphs = [Block(t, section_path=p, paragraph_start=i, paragraph_end=i) for i, (t, p) in enumerate([("a", ["x"]), ("b", ["x"]), ("", ["x"]), ("c", ["y"]), ("d" * 1300, ["y"])])]
    assert [(b.text[:6], b.location_label) for b in blocks_of_paragraphs(paragraphs)] == [("a\n\nb", "段落 0-1"), ("c", "段落 3"), ("dddddd", "段落 4")]


PAGE = "<html><head><title> My  Page </title><script>x</script></head><body><nav>no</nav><article><h2>Head</h2><p>a <b>c</b> d<br>e<p>f</article><footer>foot</footer></body></html>"


def test_html_modes():
    assert html.main_content(PAGE) == ("My Page", "## Head\n\na c d\ne\n\nf")
    title, text = html.main_content(PAGE, "compat")
    assert title == "My Page" and "acd" in text and "foot" in text
    assert html.main_content(None) == ("", "")
    assert "```\nx  y\n```" in html.main_content("<main><pre>x  y</pre></main>")[1]


def test_page_blocks_are_addressed_by_heading(spark):
    pages = spark.createDataFrame([(1, "http://h/a", PAGE), (2, "http://h/b", None)], "page_id long, url string, html string")
    rows = html.page_blocks(html.extracted_pages(pages)).collect()
    assert [(r["document_id"], r["source_uri"], r["location_label"]) for r in rows] == [("1", "http://h/a#head", "Head")]


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body text</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "notes.md").write_text("# A\ntext")
    (tmp_path / "zh.txt").write_bytes("蓝牙开发\n第二行".encode("gb18030"))
    (tmp_path / "x.c").write_text("int main(void) {\n}")
    (tmp_path / "d.docx").write_bytes(word_file())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.exe").write_bytes(b"MZ")
    (tmp_path / ".hidden.md").write_text("h")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "y.md").write_text("y")
    found = files.read_files(spark, str(tmp_path))
    assert {r["filename"]: r["error"] for r in found.collect()}["x.exe"] == files.UNSUPPORTED
    listed = files.read_directory(spark, str(tmp_path))
    assert [r["filename"] for r in listed.collect()] == ["bad.docx", "d.docx", "notes.md", "x.c", "zh.txt"]
    got = {r["filename"]: r for r in files.extracted_files(listed).collect()}
    assert got["zh.txt"]["text"] == "蓝牙开发\n第二行" and got["zh.txt"]["encoding"] in ("gb18030", "gbk")
    assert got["d.docx"]["text"] == "Body text" and got["bad.docx"]["error"]
    blocks = {(r["text"], tuple(r["section_path"])) for r in files.blocks_of_files(listed).collect()}
    assert ("Body text", ("Title",)) in blocks and ("text", ("A",)) in blocks
    documents, chunks = chunking.build_chunks(files.file_documents(listed), files.blocks_of_files(listed))
    assert {r["title"]: r["doc_type"] for r in documents.collect()}["x"] == "source_code" and chunks.count() == documents.count() == 4


def test_decoding_prefers_the_plausible():
    assert files.decoded("plain".encode()) == ("plain", "utf-8")
    assert files.decoded("é".encode("latin-1"))[0] in ("é", "閼")  # one byte proves little
    assert files.decoded("﻿abc".encode())[0].strip("﻿") == "abc"


def test_short_texts_merge_and_code_gets_context(spark):
    rows = [(1, "text", "for example:"), (2, "code", "x = 1"), (3, "text", "y" * 60), (4, "text", "tiny"), (5, "text", "z" * 1790)]
    df = spark.createDataFrame([("d", s, k, t) for s, k, t in rows], "document_id string, seq int, block_type string, content string").withColumns(
        {"section_path": F.array(F.lit("s")), **{c: F.lit(None).cast("string") for c in ("source_uri", "context_before", "context_after")}, **{c: F.lit(None).cast("int") for c in ("page_number", "line_start", "line_end", "paragraph_start", "paragraph_end")}}
    )
    out = chunking.attach_code_context(df).orderBy("seq").collect()
    assert [r["seq"] for r in out] == [2, 3, 4, 5] and out[0]["context_before"] == "for example:" and out[0]["context_after"] == "y" * 60
    merged = chunking.merge_short(df).orderBy("seq").collect()
    assert [(r["seq"], len(r["content"])) for r in merged] == [(1, 12), (2, 5), (3, 66), (5, 1790)]


def test_labels_packing_and_given_blocks(spark):
    base = spark.createDataFrame([(3, None, None, None), (None, 5, None, None), (None, 5, 9, None), (None, None, None, 2), (None, None, None, None)], "page_number int, line_start int, line_end int, paragraph_start int")
    rows = base.selectExpr("*", "cast(null as int) paragraph_end", "cast(null as string) location_label", "cast(null as string) page_label", "'text' block_type", "'c' content")
    assert [r["location_label"] for r in chunking.finalized(rows).collect()] == ["第 3 页", "行 5", "行 5-9", "段落 2", None]
    packed = lambda t, **k: spark.range(1).select(chunking.packed_text(F.lit(t), **k)).first()[0]
    assert packed("a\n\nb") == ["a\n\nb"] and packed("") == []
    assert packed("aaaa. bbbb. cccc.", size=10, overlap=2) == ["aaaa.", "a.\nbbbb.", "b.\ncccc."]


def test_profiles_from_files_and_own_strategies(spark, tmp_path):
    """Files' fields are put over the built-in profiles by id; a registered strategy gets its documents' blocks."""
    (tmp_path / "web_article.yaml").write_text("title_keywords: [' Some  WORD ']\n")
    (tmp_path / "a.yaml").write_text("profile_id: spoken\nsource_formats: [web]\ntitle_keywords: [talk]\nchunk_strategy: aloud\n")
    (tmp_path / "b.yaml").write_text("- not a profile\n")
    (tmp_path / "c.txt").write_text("profile_id: ignored\n")
    profiles = chunking.load_profiles(spark, str(tmp_path))
    assert [p[0] for p in profiles] == [p[0] for p in chunking.PROFILES] + ["spoken"]
    assert dict((p[0], p[1:]) for p in profiles)["web_article"] == (("web",), ("some word",), "web_article")
    documents = spark.createDataFrame([(i, t, "f", "/p", None, k) for i, t, k in (("1", "a talk", "web"), ("2", "some word", "web"), ("3", "x", "web"), ("4", "x", "odd"))], "id string, title string, filename string, source_path string, source_url string, source_format string")
    found = {r["id"]: (r["profile_id"], r["chunk_strategy"]) for r in chunking.resolve_profile(documents, profiles).collect()}
    assert found == {"1": ("spoken", "aloud"), "2": ("web_article", "web_article"), "3": ("web_article", "web_article"), "4": ("general", "generic_text")}
    blocks = conform(spark.createDataFrame([(i, 0, "words that are long enough to stay alone as a chunk", "text") for i in "1234"], "document_id string, seq int, text string, role string"), BLOCKS)
    content = lambda: {r["document_id"]: r["content"] for r in chunking.build_chunks(documents, blocks, profiles)[1].collect()}
    plain = content()  # a strategy that nobody registered is the generic one
    assert len(plain) == 4 and len(set(plain.values())) == 1
    chunking.register_strategy("aloud", lambda rows: rows.withColumn("content", F.upper("content")))
    try:
        assert content() == plain | {"1": plain["1"].upper()}
    finally:
        del chunking.STRATEGIES["aloud"]


def shuffled_and_failing(answer, most):
    """A service that fails once for each request, and answers in another order."""
    seen = set()

    def call(inputs):
        assert len(inputs) <= most
        if (key := repr(inputs)) not in seen:
            seen.add(key)
            raise TimeoutError("once")
        return [(i, answer(x)) for i, x in reversed(list(enumerate(inputs)))]

    return call


def test_remote_models(spark, monkeypatch):
    """Requests are bounded, retried and put back in order, for embeddings, reranking and chat."""
    chunks = chunk_rows(spark, LIBRARY).repartition(1)
    service = remote.Remote(shuffled_and_failing(lambda t: [float(len(t)), 1.0], 2), inputs=2, pause_s=0)
    monkeypatch.setitem(embed.PROVIDERS, "own", remote.embedding_provider(service))
    made = {r["chunk_id"]: r for r in vector_records(chunks, 2, "own", "m").collect()}
    texts = {r[0]: r[1] for r in chunks.select("id", text.remote_input(text.weighted_text())).collect()}
    assert {k: v["values"] for k, v in made.items()} == {k: [float(len(t)), 1.0] for k, t in texts.items()} and made["a:0"]["provider"] == "own"
    with pytest.raises(Exception, match="has not 3 values"):
        vector_records(chunks, 3, "own", "m").collect()
    gaps = remote.Remote(lambda inputs: [(0, "x")], attempts=2, pause_s=0)
    with pytest.raises(ValueError):
        gaps.answers(["a", "b"])

    asked = spark.createDataFrame([(1, "wheel", "table_lookup", [("user", "old"), ("assistant", "newer"), ("user", "newest")]), (2, "host", "qa_fact", None)], "question_id int, question string, task_type string, history array<struct<role string, content string>>")
    found = spark.createDataFrame([(1, "b:0", 0.9), (1, "c:0", 0.5), (2, "a:0", 0.4), (2, "a:1", 0.4)], "question_id int, chunk_id string, score double")
    last = remote.Remote(shuffled_and_failing(lambda q: [{"index": i, "score": float(i) + ("wheel" in q["query"])} for i in range(len(q["documents"]))] + [{"index": 9, "score": 99.0}], 64), pause_s=0)
    order = answering.rerank(found, 2, models.remote_reranker(last, asked, chunks))
    assert {(r["question_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in order.collect()} == {(1, 1): ("c:0", 2.0), (1, 2): ("b:0", 1.0), (2, 1): ("a:1", 1.0), (2, 2): ("a:0", 0.0)}
    down = remote.Remote(shuffled_and_failing(lambda q: q, 64), attempts=1)
    assert {r["chunk_id"] for r in answering.rerank(found, 1, models.remote_reranker(down, asked, chunks)).collect()} == {"b:0", "a:0"}  # the order is kept

    cited = chunks.limit(0).selectExpr("1 as question_id", "1 as rank", "*", "'' as snippet")
    said = {r["question_id"]: r["messages"] for r in models.messages(cited, asked, 2).collect()}
    assert [m["role"] for m in said[1]] == ["system", "assistant", "user", "user"] and said[1][0]["content"].endswith(models.INSTRUCTIONS["table_lookup"])
    assert [m["role"] for m in said[2]] == ["system", "user"] and said[2][0]["content"] == models.SYSTEM and answering.NO_CONTEXT in said[2][1]["content"]
    answer = remote.Remote(shuffled_and_failing(lambda x: "" if len(x["messages"]) == 2 else x["messages"][-2]["content"], 64), pause_s=0)
    assert {r[0]: r[1] for r in models.chat(models.messages(cited, asked, 2), answer).collect()} == {1: "newest", 2: models.NO_ANSWER}


def chunk_rows(spark, rows):
    return conform(spark.createDataFrame(rows, "id string, document_id string, document_title string, chunk_index int, content string, block_type string, doc_type string, symbol_name string"), CHUNKS)


LIBRARY = [
    ("a:0", "a", "Guide A", 0, "the nimble host stack starts", "text", "guide", None),
    ("a:1", "a", "Guide A", 1, "void ble_start() { init }", "code", "source_code", "ble_start"),
    ("a:2", "a", "Guide A", 2, "void ble_stop() { }", "code", "source_code", "ble_stop"),
    ("b:0", "b", "Manual B", 0, "motor torque and speed of the wheel", "text", "other", None),
    ("c:0", "c", "All products", 0, "catalog of the wheel", "text", "catalog", None),
]


def test_scope_and_answers(spark):
    chunks = chunk_rows(spark, LIBRARY)
    documents = spark.createDataFrame([("a", "Guide A", "guide_a.md", "/in/guide_a.md"), ("b", "Manual B", "manual_b.md", "/in/manual_b.md"), ("c", "All products", "all.md", "/in/all.md")], "id string, title string, filename string, source_path string")
    asked = spark.createDataFrame([(1, "wheel speed"), (2, "function ble_start"), (3, "what does manual b say"), (4, "catalog of wheel"), (5, "蓝牙"), (6, "zzz")], "question_id int, question string")
    ready = analyzed(asked, 5)
    scope = scoping.question_scope(ready, chunks, scoping.named_documents(ready, documents)).pairs()
    by = {q: sorted(r["id"] for r in scope.where(F.col("question_id") == q).collect()) for q in range(1, 7)}
    assert by[1] == ["a:0", "a:1", "a:2", "b:0"] and by[2] == ["a:1"] and by[3] == ["b:0"] and by[4] == [r[0] for r in LIBRARY] and by[5] == ["a:0", "a:1", "a:2"]
    answers = answering.answerable(asked, documents, chunks, vector_records(chunks, 32), answering.Settings(top_k=2, dimension=32))
    found = answers.collect()
    best = {r["question_id"]: r for r in found if r["rank"] == 1}
    assert best[2]["chunk_id"] == "a:1" and best[2]["score"] == 0.99
    assert best[3]["chunk_id"] == "b:0"
    assert all(r["rank"] <= 2 for r in found)
    prompts = {r["question_id"]: r["prompt"] for r in answering.prompt(spark.createDataFrame([r for r in found if r["question_id"] != 6], answers.schema), asked).collect()}
    assert "[Manual B | " in prompts[3] and answering.NO_CONTEXT in prompts[6]


def test_pruned_search_equals_whole_search(spark, tmp_path):
    """Block-max search in two passes finds what scoring everything finds: stop words, ties, more asked than there is, a scope."""
    rng = random.Random(11)
    words = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(60)] + [f"r{i}" for i in range(300)]
    rows = [(i, [rng.choice(words) for _ in range(rng.choice([0, 3, 12, 40]))], i % 3) for i in range(900)]
    rows += [(900 + i, ["the", "r1", "of"], 0) for i in range(12)]  # ties
    chunks = spark.createDataFrame(rows, "id long, t array<string>, part int")
    index = ranking.build_index(chunks, "id", F.col("t"))
    asked = spark.createDataFrame([(1, "the", 2), (1, "of", 1), (1, "r1", 1), (2, "the", 1), (2, "of", 1), (3, "r7", 1), (3, "w5", 3), (3, "the", 1), (4, "zz", 1), (5, "w1", 1), (5, "w2", 1), (5, "of", 4)], "question_id int, token string, qtf long")
    made = postings.BlockIndex.of(index, block_chunks=50)
    made.write(str(tmp_path / "index"))
    read = postings.BlockIndex.read(spark, str(tmp_path / "index"))
    shown = lambda rows: sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"]) for r in rows.collect())
    for k in (3, 1000):
        want = shown(ranking.top_k(ranking.bm25(asked, index), k))
        assert shown(postings.pruned_topk(read.statistics(asked), read, k)) == want and len(want) > 2 * min(k, 10)
    scope = scoping.Scope(chunks.select("id", F.col("id").alias("document_id"), F.col("part").cast("string").alias("profile")), spark.createDataFrame([(1, "0"), (1, "2"), (3, "1"), (5, "1")], "question_id int, profile string"), spark.createDataFrame([(2, i) for i in range(0, 900, 7)], "question_id int, id long"), spark.createDataFrame([], "question_id int, id long"))
    pairs = scope.pairs().withColumnRenamed("id", "chunk_id")
    got = shown(postings.pruned_topk(answering.scoped_statistics(asked, made, scope), made, 5, scope.within))
    assert got == shown(ranking.top_k(ranking.bm25(asked, index, pairs), 5))


def test_cascade_matches_filters_one_after_another(spark):
    for presence in (0b1, 0b1010, 0b1100, 0b0110, 0b1000):
        combos = {c for c in range(4) if presence >> c & 1}
        for used in ((True, True), (True, False), (False, True)):
            want = combos
            for k, on in enumerate(used):
                kept = {c for c in want if c >> k & 1}
                want = kept if on and kept else want
            got = spark.range(1).select(scoping.cascade(F.lit(presence).cast("long"), 2, [F.lit(u) for u in used])).first()[0]
            assert {c for c in combos if got >> c & 1} == want


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, [])], "id int, t array<string>")
    index = ranking.build_index(chunks, "id", F.col("t"))
    asked = spark.createDataFrame([(7, "a", 2), (7, "zz", 1)], "question_id int, token string, qtf long")
    from math import log

    want = 2 * log(1 + (3 - 1 + 0.5) / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3)))
    (row,) = ranking.bm25(asked, index).collect()
    assert (row["chunk_id"], row["score"]) == (1, pytest.approx(want))
    scoped = ranking.bm25(asked, index, spark.createDataFrame([(7, 2)], "question_id int, chunk_id int"))
    assert scoped.count() == 0


def test_vector_search_edges(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0]), (6, [1.0, 0.0])], "chunk_id int, `values` array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, [0.5])], "question_id int, vector array<double>")
    got = ranking.vector_topk(queries, vectors, 2, block=2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1.0), (1, 6, 1.0), (3, 3, 0.5)]
    assert embed_tokens([], 8).tolist() == [0.0] * 8 and abs((embed_tokens(["a", "b", "a"], 8) ** 2).sum() - 1) < 1e-9


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "X", "alpha"), (1, 2, "Doc  A", "beta"), (2, 1, "Y", "gamma")], "question_id int, rank int, document_title string, content string")
    expected = spark.createDataFrame([(1, ["doc a"], ["Beta", "delta"]), (2, [], []), (3, ["q"], ["x"])], "question_id int, expected_documents array<string>, expected_terms array<string>")
    got = {r["question_id"]: r for r in evaluation.judged(results, expected).collect()}
    assert (got[1]["hit_at_1"], got[1]["hit_at_3"], got[1]["reciprocal_rank"], got[1]["term_coverage"]) == (False, True, 0.5, 0.5)
    assert got[3]["reciprocal_rank"] == 0 and got[2]["term_coverage"] == 0
    assert evaluation.summary(evaluation.judged(results, expected.limit(0))).first()["mrr"] == 0


def test_sessions(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    turns = spark.createDataFrame([("s", i, r, t, at) for i, (r, t) in enumerate([("system", "x"), ("user", "q1"), ("assistant", "a1"), ("user", " "), ("user", "q3")])], "session_id string, turn int, role string, content string, created_at timestamp")
    asked = spark.createDataFrame([("s", "now"), ("none", "now")], "session_id string, question string")
    assert {r[0]: r[2] for r in sessions.history_query(turns, asked).collect()} == {"s": "q1\nq3\nnow", "none": "now"}
    more = sessions.appended(turns, spark.createDataFrame([("s", "q4", "a4", at), ("t", "q", "a", at)], "session_id string, question string, answer string, created_at timestamp"))
    listed = {r["session_id"]: r for r in sessions.listed(more).collect()}
    assert listed["s"]["turn_count"] == 7 and listed["s"]["last_message"] == "a4" and listed["t"]["title"] == "q"
    assert [m["content"] for m in sessions.messages(more, 2).where("session_id = 's'").first()["messages"]] == ["q4", "a4"]
    assert sessions.deleted(more, "s").count() == 2 and sessions.seeded(more, turns).count() == more.count()


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"))
    assert store.scan("chunks").count() == 0 and store.import_json("chunks", str(tmp_path / "no.json")).count() == 0
    texts = [(f"d{i}", f"T{i}", f"f{i}.md", f"/in/f{i}.md", None, "markdown", f"# H{i}\nbody of number {i} with some more words in it to be long enough") for i in range(4)]
    df = spark.createDataFrame(texts, ingest.TEXTS)
    for k in range(2):
        df.where(F.col("id").isin(f"d{2 * k}", f"d{2 * k + 1}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "arriving"))
    ingest.start(store, ingest.text_stream(spark, str(tmp_path / "arriving")), str(tmp_path / "cp")).awaitTermination(300)
    batch = chunking.build_chunks(*ingest.prepared(df))[1]
    same = lambda c: sorted(map(tuple, c.select("id", "content", "location_label").collect()))
    assert same(store.scan("chunks")) == same(batch) and store.scan("vectors").count() == batch.count()
    assert ingest.ingest(store, df) == 0  # a replay changes nothing
    assert tuple(store.consistency().first()) == (4, 4, 0, 0, 0)
    assert store.find_by_path("/in/f1.md").first()["id"] == "d1"
    assert store.delete_document("d1") == 1 and store.delete_document("d1") == 0
    assert tuple(store.consistency().first()) == (3, 3, 0, 0, 0)
    twice = upserted(store.scan("vectors"), store.scan("vectors"))
    assert twice.count() == 3
    store.rebuild(store.scan("documents"), store.scan("chunks"), rebuild_vectors=False)
    assert store.scan("vectors").count() == 0 and store.health()["documents"] == 3


def vector_rows(spark, rows):
    """(chunk_id, collection_id, chunk_hash)"""
    return conform(spark.createDataFrame(rows, "chunk_id string, collection_id string, chunk_hash string"), VECTORS)


def test_changes_write_only_their_parts(spark, tmp_path):
    """An upsert rewrites the buckets of its keys, a collection's overwrite that collection; the rest is carried over."""
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    store.write_vectors(vector_rows(spark, [(f"d{i}:{k}", c, "old") for i in range(40) for k in range(3) for c in ("a", "b/ c=")]))
    before = store.version("vectors")
    store.upsert_vectors(vector_rows(spark, [("d7:0", "a", "new"), ("d7:9", "a", "new"), ("d7:9", "a", "new")]))
    after = store.version("vectors")
    assert len(before.parts) == 8 and len({*after.parts} - {*before.parts}) == 1 and len({*before.parts} - {*after.parts}) == 1
    rows = {(r.chunk_id, r.collection_id): r.chunk_hash for r in store.scan("vectors").collect()}
    assert len(rows) == 241 and [k for k, v in rows.items() if v == "new"] and rows["d7:0", "b/ c="] == "old" and rows["d7:9", "a"] == "new"
    store.write_vectors(vector_rows(spark, [("x:0", None, "only")]), "b/ c=")
    assert {p for p in store.version("vectors").parts if p in after.parts} == {p for p in after.parts if p.key.startswith(collection_key("a"))}
    assert store.list_vectors("b/ c=").count() == 1 and store.list_vectors("a").count() == 121
    assert store.scan("vectors", number=before.number).count() == 240  # versions stay readable
    assert store.vacuum("vectors", keep=1) == 0  # within the grace
    assert store.vacuum("vectors", keep=1, grace_s=-60) > 0 and store.versions("vectors") == [store.version("vectors").number]
    assert store.scan("vectors").count() == 122


def test_two_writers(spark, tmp_path):
    """Appends of two writers both stay; a change of replaced parts is refused and leaves the table as it is."""
    one, two = Store(spark, str(tmp_path / "s"), buckets=2), Store(spark, str(tmp_path / "s"), buckets=2)
    one.write_vectors(vector_rows(spark, [("d:0", "a", "0"), ("e:0", "b", "0")]))
    base = one.version("vectors")
    added = one._write("vectors", vector_rows(spark, [("f:0", "a", "1")]))
    two.append("vectors", vector_rows(spark, [("g:0", "b", "2")]))
    one.commit("vectors", base, (), added)  # overtaken, put on top
    assert sorted(r[0] for r in two.scan("vectors").select("chunk_id").collect()) == ["d:0", "e:0", "f:0", "g:0"]

    base = one.version("vectors")
    old = [p for p in base.parts if p.key.startswith(collection_key("b"))]
    added = one._write("vectors", vector_rows(spark, [("e:0", "b", "mine")]))
    two.upsert_vectors(vector_rows(spark, [("e:0", "b", "theirs"), ("g:0", "b", "theirs")]))
    with pytest.raises(Conflict):
        one.commit("vectors", base, old, added)
    assert {r.chunk_id: r.chunk_hash for r in one.scan("vectors").collect()} == {"d:0": "0", "e:0": "theirs", "f:0": "1", "g:0": "theirs"}
    step = ("stream", 3)
    one.append("vectors", vector_rows(spark, [("h:0", "a", "3")]), step)
    n = one.version("vectors").number
    two.append("vectors", vector_rows(spark, [("h:0", "a", "3")]), step)  # a replay
    assert one.version("vectors").number == n


def test_stream_passes_each_origin_once(spark, tmp_path):
    """Origins repeated inside a batch, in later batches, in later runs and in stored documents; null origins fall back to ids."""
    store = Store(spark, str(tmp_path / "s"))
    text = "# A\nwords enough to make a chunk of text {}"
    row = lambda i, p, u=None, t=None: (f"i{i}", f"T{i}", "f.md", p, u, "web", text.format(i) if t is None else t)
    write = lambda rows: spark.createDataFrame(rows, ingest.TEXTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.start(store, ingest.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(300)
    ingest.ingest(store, spark.createDataFrame([row(0, "/stored")], ingest.TEXTS))
    write([row(2, "/a"), row(1, "/a"), row(3, "/stored"), row(4, None, "http://x"), row(5, "/blank", t=" ")])
    write([row(6, "/a"), row(7, None), row(7, None), row(8, "/blank")])
    run()
    assert sorted(r[0] for r in store.scan("documents").select("id").collect()) == ["i0", "i1", "i4", "i7", "i8"]
    write([row(9, "/a"), row(10, "/new"), row(11, None, "http://x")])
    run()
    assert sorted(r[0] for r in store.scan("documents").select("id").collect()) == ["i0", "i1", "i10", "i4", "i7", "i8"]
    assert tuple(store.consistency().first())[2:] == (0, 0, 0)


def test_pdf_predicates(spark):
    x = F.col("x")
    one = lambda text, column: spark.createDataFrame([(text,)], "x string").select(column).first()[0]
    assert one("1.2 Power supply", rules.heading(x)) == "1.2 Power supply" and one("Table 1-2 x", rules.heading(x)) is None
    assert one("F = m * a + (b - c) = 0 (2-1)", rules.is_formula(x)) and not one("just words here", rules.is_formula(x))
    assert one("| a | a |", rules.is_repeated_row(x)) and not one("| a | b |", rules.is_repeated_row(x))
    assert tuple(one("2.1 Values 表 2-1 Limits", F.struct(rules.before_title(x), rules.table_title(x)))) == ("2.1 Values", "表 2-1 Limits")
    assert one("表 2.1O. x", rules.table_key(x)) == "2-10" and one("附录 B.2 x", rules.number_of(x)) == "B.2"
    assert one("a\n12 汽车理论 word\nSubmit Documentation Feedback", rules.without_noise(x)) == "a\nword"
    foot = "乐鑫信息科技 12 {} 系列芯片技术规格书 v1.2"
    for name in ("ESP32", "esp32", "Esp32-C3"):
        assert one(f"abc {foot.format(name)} def", rules.without_noise(x)) == "abc def" and one(foot.format(name), rules.without_noise(x)) == ""
    assert one("abc I 乐鑫信息科技 12 i esp32 v2 def", rules.without_noise(x)) == "abc def" == one("abc esp32 v2 乐鑫信息科技 7 def", rules.without_noise(x))
    assert one("3 x 7", rules.contents_title(x, F.lit("section"))) == "3 x 7" and one("表 1-1 T ..", rules.contents_title(x, F.lit("table"))) == "表1-1. T"


def test_table_rows_and_boxes():
    row = lambda kind, line, head: {"kind": kind, "line": line, "head": head}
    rows = [row("title", "表 1-1 T", False), row("plain", "参数 单位", True), *[row("plain", f"r{i} 1 2", False) for i in range(7)]]
    blocks = list(pdf.rows_to_blocks(rows, ["s"], 3))
    assert [b.text.split("\n")[:3] for b in blocks] == [["表 1-1 T", "参数 单位", "r0 1 2"], ["表 1-1 T", "参数 单位", "r5 1 2"]]
    assert pdf.ocr_lines([(0, 10, 5, 10, "a"), (60, 70, 6, 10, "b"), (0, 10, 40, 10, "c")]) == ["a b", "c"]
    assert pdf.markdown_paragraph(["one", "two-", "three"]) == "one two-three" and pdf.markdown_paragraph(["- a", "- b"]) == "- a\n- b"


CONTENTS = ["目录", "1 Intro 2", "1.1 Power 2", "1.2 Radio 3", "表格", "表 1-1 Limits 2"]


def test_pdf_pages(spark):
    sentence = "This sentence is long enough to be kept as a block of text on its own, since it has more than eighty characters."
    pages = [(1, CONTENTS)] + [(n, ["My running head", "1.1 Power", sentence, "表 1-1 Old name", "参数 单位", "volt 1 2", f"foot {n}"]) for n in (2, 3, 4)]
    df = spark.createDataFrame([("d", n, lines) for n, lines in pages], "document_id string, page_number int, lines array<string>")
    noise = {(r["place"], r["signature"]) for r in pdf.margin_noise(df).collect()}
    assert ("head", "Myrunninghead") in noise and ("foot", "foot#") in noise
    entries = pdf.contents_table(df)
    assert [(r["title"], r["target_page"], r["kind"]) for r in entries.orderBy("seq").collect()] == [("1 Intro", 2, "section"), ("1.1 Power", 2, "section"), ("1.2 Radio", 3, "section"), ("表1-1. Limits", 2, "table")]
    assert pdf.page_sections(entries).where("target_page = 2").first()["path"] == ["1 Intro"]
    assert {r["key"] for r in pdf.section_lookup(entries).collect()} == {"1", "1.1", "1.2"}
    titles = spark.createDataFrame([("d", 3, "表 1-1 Old name"), ("d", 9, "表 1-1 far")], "document_id string, page_number int, title string")
    assert sorted(r["canonical"] for r in pdf.canonical_titles(titles, entries).collect()) == ["表1-1. Limits", "表1-1. far"]
    blocks = pdf.pdf_blocks(df).orderBy("seq").collect()
    assert any(sentence in r["text"] for r in blocks) and not any("running head" in r["text"] for r in blocks)
    text = f"# One\n{sentence}\n\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |"
    route = pdf.markdown_pdf_blocks(spark.createDataFrame([("m", 1, text), ("n", 1, None)], "document_id string, page_number int, text string"))
    assert [(r["document_id"], r["role"], r["section_path"]) for r in route.orderBy("seq").collect()] == [("m", "text", []), ("m", "table", [])]


def test_tables_run_over_pages(spark):
    """A page that begins with rows goes on with the table before it; a lower heading ends it."""
    pages = [(1, ["第1章 概述", "表 1-1 Limits", "volt 1 2"]), (2, ["amp 3 4", "ohm 5 6", "1.2 Radio", "after"])]
    df = spark.createDataFrame([("d", n, lines) for n, lines in pages], "document_id string, page_number int, lines array<string>")
    rows = pdf.per_document(pdf.classified_lines(df, pdf.contents_table(df)), lambda rows: pdf.block_rows("d", pdf._content_blocks(rows)), pdf.BLOCKS, "page_number", "i")
    got = [(r["role"], r["page_number"], r["text"], r["section_path"]) for r in rows.orderBy("seq").collect()]
    assert got[0] == ("table", 1, "表1-1. Limits\nvolt 1 2", ["第1章 概述"])
    assert got[-1][0::3] == ("text", ["第1章 概述", "1.2 Radio"])


def test_replay_after_a_failure_at_each_write(spark, tmp_path, monkeypatch):
    """A batch killed after any write, replayed, leaves each document, chunk and vector once; null paths are no key."""
    texts = spark.createDataFrame([(f"i{k}", f"T{k}", "f.md", p, u, "web", f"# A\nwords of text {k}") for k, (p, u) in enumerate([("/a", None), (None, "http://a"), (None, "http://b"), (None, None), (None, "http://a")])], ingest.TEXTS)
    for step in ("append:chunks", "upsert_vectors", "append:documents", None):
        store = Store(spark, f"{tmp_path}/{step}")

        def broken(name, kept=None, step=step):
            def call(self, *args, **kwargs):
                out = kept(self, *args, **kwargs)
                if step == (f"{name}:{args[0]}" if name == "append" else name):
                    raise RuntimeError("killed")
                return out

            return call

        with monkeypatch.context() as patch:
            patch.setattr(Store, "append", broken("append", Store.append))
            patch.setattr(Store, "upsert_vectors", broken("upsert_vectors", Store.upsert_vectors))
            if step:
                with pytest.raises(RuntimeError):
                    ingest.ingest(store, texts)
            else:
                ingest.ingest(store, texts)
        ingest.ingest(store, texts)
        documents, chunks, vectors = (store.scan(t) for t in ("documents", "chunks", "vectors"))
        assert documents.count() == 4 and sorted(r[0] for r in documents.select("source_url").distinct().collect() if r[0]) == ["http://a", "http://b"]
        assert chunks.count() == chunks.select("id").distinct().count() == vectors.count() == vectors.select("chunk_id").distinct().count() == 4


def test_retrieval_eval_compares_terms_as_its_sql(spark, tmp_path):
    """Terms that hold a line end, which the folded contents do not."""
    from loamspark.plans import retrieval
    from tests.oracle_check import compare, connect

    texts = ["alpha\nbeta gamma delta", "epsilon zeta\teta theta", "Iota kappa lambda mu"]
    spark.createDataFrame([(i, f"{t} and the rest", "en", f"Src{i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = retrieval.retrieval_eval(spark, str(tmp_path)).toPandas()
    assert got["term_coverage_at_5"][0] == round((2 / 3 + 2 / 3 + 1) / 3, 6)
    con = connect("/root/testdata/sf0.001")
    for name in ("documents", "benchmark"):
        con.execute(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert compare(got, con.execute(retrieval.RETRIEVAL_EVAL).df()) == ""
