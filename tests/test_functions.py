"""Column functions on hand-written cases."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamspark.functions import embed
from loamspark.functions import metadata as M
from loamspark.functions import quality as Q
from loamspark.functions import text as X
from loamspark.operators import ranking
from loamspark.schemas import CHUNKS, conform


def one(spark, column, **values):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


def test_latin_tokens_are_doubled_and_stemmed(spark):
    got = one(spark, X.latin_tokens(F.col("t")), t="Running tests passed boxes is A/B®")
    assert got == ["running", "runn", "tests", "test", "passed", "pass", "boxes", "box", "is", "is", "a/b", "a/b"]


def test_cjk_and_expansions(spark):
    assert one(spark, X.cjk_tokens(F.col("t")), t="蓝牙x广") == ["蓝", "牙", "蓝牙", "广"]
    assert one(spark, X.expansions(F.col("t")), t="scanning") == ["scan", "scanning", "扫描"]
    assert one(spark, X.tokenize(F.col("t")), t="plain") == ["plain", "plain"]
    folded = spark.sql("select 'ＡＢ' as t").select(X.nfkc(F.col("t")).alias("t"))
    assert folded.select(X.latin_tokens(F.col("t"))).first()[0] == ["ab", "ab"]
    assert one(spark, F.size(X.tokenize(F.col("t"))), t="") == 0


def test_vectors(spark):
    df = spark.sql("select array(3D, 4D) a, array(0D, 0D) z, array(1D) s, cast(array() as array<double>) e")
    row = df.select(X.l2_normalize(F.col("a")), X.l2_normalize(F.col("z")), X.dot(F.col("a"), F.col("a")), X.dot(F.col("a"), F.col("s")), X.dot(F.col("e"), F.col("e"))).first()
    assert tuple(row) == ([0.6, 0.8], [0.0, 0.0], 25.0, 0.0, 0.0)


def test_cuts_and_names(spark):
    assert one(spark, X.snippet(F.col("t"), 5), t="  abcd efgh ") == "abcd..."
    assert one(spark, X.one_line(F.col("t"), 5), t="a\n\nb  cdef") == "a b c..."
    assert one(spark, X.session_title(F.col("t")), t="   ") == X.NEW_SESSION
    assert one(spark, X.slug(F.col("t")), t=" Héllo, World -- x ") == "héllo-world-x"
    assert one(spark, X.slug(F.col("t")), t="!!") == "section"
    assert one(spark, X.safe_filename(F.col("t")), t="/a/b c?.md") == "b_c_.md"
    assert one(spark, X.remote_input(F.col("t")), t=" ") == " "
    assert len(one(spark, X.remote_input(F.col("t")), t="x" * 9000)) == 5625 + 5 + 1855
    assert one(spark, X.sentences(F.col("t")), t="One. Two! 三。3.14") == ["One.", "Two!", "三。", "3.", "14"]
    assert one(spark, X.import_normalized(F.col("t")), t="Ａ\r\n\n\n\nb\x00 ") == "A\n\nb"
    assert one(spark, X.without_boilerplate(F.col("t")), t="Body © Copyright x Was this page helpful?") == "Body"
    assert one(spark, X.without_boilerplate(F.col("t")), t="Body © Copyright") == "Body © Copyright"
    assert one(spark, X.readability(F.col("t")), t="ab é") == pytest.approx(2 / 3)


def test_fingerprint_counts_nulls_as_empty_lines(spark):
    df = spark.createDataFrame([("a", None, None, None), ("a", [], "", "")], "content string, section_path array<string>, page_label string, location_label string")
    assert df.select(X.chunk_fingerprint()).distinct().count() == 1


@pytest.mark.parametrize(
    ("title", "level"),
    [("第三章 x", 1), ("第2节 y", 2), ("前言", 1), ("1.2.3 abc", 3), ("Chapter 4 x", 1), ("section 2", 2), ("plain", None), ("第 2 版 前言", 1)],
)
def test_heading_levels(spark, title, level):
    assert one(spark, Q.heading_level(F.col("t")), t=title) == level


def test_section_titles(spark):
    good = ["Overview", "1.2 a; b", "项目"]
    bad = ["", "x" * 81, "a|b", "include_dirs x", "if (x)", "foo(1)", "a; b", "12.3-4", "${x}"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.select(Q.is_section_title(F.col("t"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_section_path_is_rebuilt_by_levels(spark):
    clean = lambda *path: one(spark, Q.clean_section_path(F.col("p")), p=list(path))
    assert clean("Guide", "1 One", "1.1 Sub", "2 Two") == ["Guide", "2 Two"]
    assert clean("A", "A", "**B**") == ["A", "B"]
    assert clean("1 x", "1.2 y", "1.2.1 z", "1.3 w") == ["1 x", "1.3 w"]
    assert clean() == []


TABLE = "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n| 3 | z |"


def test_tables(spark):
    confidence = lambda t: one(spark, Q.table_confidence(F.col("t")), t=t)
    assert confidence(TABLE) == "high"
    assert confidence("| a | b |\n| 1 | x |") == "medium"
    assert confidence("| a | b |") == "low"
    assert confidence("| a |\n| b | c |\n| d | e | f |") == "low"
    assert confidence("| a | b |\n| 1 2 3 4 5 6 7 8 | x |") == "low"
    assert one(spark, Q.is_bad_table(F.col("t")), t="| Col1 | x |") is True
    assert one(spark, Q.is_bad_table(F.col("t")), t="|  |  |  |  |  |  |  |\n|  |  |  |  |  | a |  |") is True
    assert one(spark, Q.is_bad_table(F.col("t")), t="no bars") is False


def test_report_predicates(spark):
    issue = lambda t: one(spark, Q.section_issue(F.col("t")), t=t)
    assert [issue(x) for x in ("a|b", "page 12 x", "Figure 3 x", "see www.x.y", "12 汽车理论", "Fine")] == [
        "invalid_title_rule", "page_or_print_noise", "figure_or_table_caption", "url_in_section_path", "running_header_or_repeated_title", None,
    ]
    assert one(spark, Q.is_bad_start(F.col("t")), t="continued from the page that came before it") is True
    assert one(spark, Q.is_bad_start(F.col("t")), t="short") is False
    assert one(spark, Q.has_two_chapters(F.col("p")), p=["第一章 a", "第二章 b"]) is True


def test_metadata(spark):
    rows = [
        ("x_datasheet.pdf", "X", "pdf", "datasheet", "hardware", 2, False),
        ("main.c", "main", "code", "source_code", "project", 2, False),
        ("CMakeLists.txt", "b", "text", "build_config", "project", 2, False),
        ("README.md", "readme", "markdown", "project_doc", "project", 1, False),
        ("catalog.md", "t", "markdown", "catalog", "catalog", -2, True),
        ("n.txt", "ESP-IDF 编程指南 - ESP32", "text", "programming_guide_home", "software", -2, True),
        ("n.txt", "n", "text", "other", "general", 0, False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "f string, t string, k string")
    got = df.select(M.document_metadata(F.col("f"), F.col("t"), F.lit("/in/p"), F.lit(None).cast("string"), F.col("k"), F.lit(3)).alias("m")).select("m.doc_type", "m.content_domain", "m.retrieval_priority", "m.is_entrypoint").collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]
    assert one(spark, M.version(F.col("t")), t="docs v5.1.2 stable") == "v5.1.2"
    assert one(spark, M.version(F.col("t")), t="docs latest") == "latest"
    assert one(spark, M.language(F.col("t")), t="手册") == "zh-CN" and one(spark, M.language(F.col("t")), t="/en/x") == "en"
    assert one(spark, M.chip_family(F.col("t")), t="ESP32C61 board") == "esp32c61" and one(spark, M.chip_family(F.col("t")), t="esp32-c3") == "esp32"
    assert one(spark, F.array_sort(M.lookup_variants(F.col("t"))), t="/in/20240101120000_My File.PDF") == ["/in/20240101120000_my file", "/in/20240101120000_my file.pdf", "20240101120000_my file", "20240101120000_my file.pdf", "my file", "my file.pdf"]


def test_batches_of_embeddings_equal_single_ones():
    rows = [["b", "a", "b", "c" * 40], [], None, ["é", "a"], ["a"] * 1000]
    made = embed.embed_batch(pa.array(rows, type=pa.list_(pa.string())), 16)
    assert made.shape == (5, 16)
    for row, vector in zip(rows, made):
        assert (vector == embed.embed_tokens(row or [], 16)).all()
    assert embed.embed_batch(pa.array([], type=pa.list_(pa.string())), 16).shape == (0, 16)
    assert embed.embed_batch(pa.array([["a"]]), 0).shape == (1, 0)


def test_compatibility_forms_are_folded_before_tokens(spark):
    asked = spark.createDataFrame([(1, "ＡＰＩ ﬁle"), (2, None), (3, "")], "question_id int, question string")
    found = {r["token"] for r in ranking.question_tokens(asked).collect()}
    assert {"api", "file"} <= found
    chunks = conform(spark.createDataFrame([("c", "ＮｉｍＢＬＥ")], "id string, content string"), CHUNKS)
    assert "nimble" in {r["token"] for r in ranking.build_index(chunks).postings.collect()}


def test_latin_index_equals_index_of_tokens(spark):
    docs = spark.createDataFrame([(1, "Running services, running it's"), (2, ""), (3, "es s ing")], "id int, t string")
    one_by_one = ranking.build_index(docs, "id", X.latin_tokens(F.col("t")))
    made = ranking.build_latin_index(docs, "id", F.col("t"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(made.postings) == rows(one_by_one.postings)
    assert rows(made.lengths) == rows(one_by_one.lengths)
