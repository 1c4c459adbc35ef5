"""Queries of PDF lines: noise and cleaned forms, formula and heading scores, titles as the contents list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.functions import pdf_rules as rules
from loamspark.operators import pdf
from loamspark.plans import sql as S
from loamspark.plans.retrieval import table
from loamspark.plans.scoring import SPACE

#: What stands before and after the first words of a document, in turn: running feet, chapters, captions, formulas, imprints, plain text.
BEFORE = (
    "", "第3章 ", "2.1 ", "Chapter 4: ", "section 12 - ", "图 3-1 ", "Table 2.4 ", "12 ", "17 汽车理论 ", "**#4.2** ", "— 5.1 ", "F = m * a + (b - c) = 0 (2-1) ", "φ = α + β √ ∑ ∫ ",
    "3 MHz ", "乐鑫信息科技 12 ESP32 系列芯片技术规格书 v1.2 ", "abc esp32-C3 v2.1 乐鑫信息科技 7 ", "主 编 ", "ISBN 7-111 ", "http://x.org/ ", "前言", "7汽车 ",
)
AFTER = ("", " 17", " GoBack", " Submit Documentation Feedback", "; a, b, c.", " 前言", " = [x] {y} (3-2)")


def _line(text: Column, n: Column) -> Column:
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    return F.concat(turn(BEFORE), F.substring(F.coalesce(text, F.lit("")), F.lit(1), (n % 97).cast("int")), turn(AFTER))


def pdf_line_scores(spark, sf_dir):
    """Formula and heading score of a line of every document, and whether it is a formula."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _line(F.col("text"), F.col("doc_id")).alias("line"))
    title = rules.heading_title(F.col("line"))
    return rows.select("doc_id", F.round(rules.formula_score(F.col("line")), 6).alias("formula_score"), rules.is_formula(F.col("line")).alias("formula"), title.alias("title"), F.round(rules.heading_score(title), 6).alias("heading_score"))


def pdf_noise(spark, sf_dir):
    """Lines of every document between running heads and feet, cleaned."""
    n = F.col("doc_id")
    foot = "乐鑫信息科技 {} ESP32 技术参考手册 v{}"
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(x, F.when((i + n) % 3 == 0, F.concat(F.lit(" " + foot.format(1, 2) + " "), x)).otherwise(F.lit(""))))
    text = F.concat_ws("\n", F.lit(foot.format(4, "1.0").lower()), F.lit("Chapter 3 Radio"), F.lit("Espressif Systems 12"), _line(F.col("text"), n), F.array_join(lines, "\n"))
    out = rules.without_noise(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(out).cast("long").alias("n_chars"), F.sha2(out, 256).alias("text_sha256"))


def _one(sign: str) -> str:
    (pattern,) = rules.SIGNS[sign]
    return S.text(pattern)


def _says(column: str, *signs: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {S.text(p)})" for s in signs for p in rules.SIGNS[s]) + ")"


def _flat(text: str) -> str:
    return f"regexp_replace(regexp_replace(replace({text}, chr(61633), ''), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def _cut(text: str, sign: str, by: str = "") -> str:
    for p in rules.SIGNS[sign]:
        text = f"regexp_replace({text}, {S.text(p)}, '{by}', 'g')"
    return text


def _line_sql() -> str:
    turn = lambda values: f"[{', '.join(map(S.text, values))}][doc_id % {len(values)} + 1]"
    return f"{turn(BEFORE)} || substr(coalesce(text, ''), 1, CAST(doc_id % 97 AS INT)) || {turn(AFTER)}"


_CORE, _TOKEN = _one("formula core"), _one("formula token")
_TITLE = _flat(_cut(_cut(_cut(_flat("regexp_replace(line, '[*_`#]+', '', 'g')"), "leading dash"), "chapter with page", r"\1"), "number with page", r"\1"))


def _formula(flat: str) -> str:
    tokens, core = f"regexp_extract_all({flat}, {_TOKEN})", f"len(regexp_extract_all({flat}, {_CORE}))"
    signs = f"len(list_filter({tokens}, lambda t: {_says('t', 'formula sign')}))"
    numbered = _says(flat, "equation number")
    return f"""(CASE WHEN len({tokens}) = 0 OR {_says(flat, 'address')} OR ({core} = 0 AND NOT {numbered}) THEN 0
      ELSE {signs} / len({tokens}) + least({core} / 12, 0.5) + CASE WHEN {numbered} THEN 0.2 ELSE 0 END END)"""


PDF_LINE_SCORES = f"""
WITH l AS (SELECT doc_id, {_line_sql()} AS line FROM documents),
f AS (SELECT doc_id, {_flat('line')} AS flat, {_TITLE} AS t FROM l),
s AS (
  SELECT *, {_formula('flat')} AS score, {_formula('t')} AS t_score, len(regexp_extract_all(flat, '[一-鿿]')) / greatest(length(replace(flat, ' ', '')), 1) AS cjk,
         len(regexp_extract_all(flat, {_CORE})) AS core FROM f)
SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS formula_score,
       length(flat) >= 8 AND NOT {_says('flat', 'address')} AND NOT (length(flat) > 180 AND cjk > 0.2)
       AND ((cjk < 0.2 AND contains(flat, '=') AND score >= 0.7) OR (core >= 4 AND {_says('flat', 'relation')} AND NOT (cjk > 0.45 AND core < 8) AND score >= 1.0)) AS formula,
       t AS title,
       round(CAST(CASE WHEN t = '' THEN 0 ELSE greatest(0,
         CASE WHEN {_says('t', 'decimal heading')} THEN 0.55 ELSE 0 END + CASE WHEN {_says('t', 'chinese heading')} THEN 0.65 ELSE 0 END
         + CASE WHEN {_says('t', 'english heading')} THEN 0.55 ELSE 0 END + CASE WHEN length(t) <= 35 THEN 0.18 WHEN length(t) <= 60 THEN 0.08 ELSE 0 END
         + CASE WHEN {_says('t', 'heading word')} THEN 0.16 ELSE 0 END + CASE WHEN {_says('t', 'preface')} THEN 0.15 ELSE 0 END
         - CASE WHEN {_says('t', 'caption')} THEN 0.9 ELSE 0 END
         - CASE WHEN {_says('t', 'book head', 'imprint')} OR ({_says('t', 'numbered words')} AND NOT {_says('t', 'part of a book')}) THEN 0.9 ELSE 0 END
         - CASE WHEN t_score >= 0.55 THEN 0.75 ELSE 0 END - CASE WHEN {_says('t', 'address or imprint')} THEN 0.5 ELSE 0 END
         - CASE WHEN length(t) > 80 THEN 0.45 ELSE 0 END - CASE WHEN len(regexp_extract_all(t, {_one('comma')})) >= 2 THEN 0.35 ELSE 0 END) END AS DOUBLE), 6) AS heading_score
FROM s"""

_MARKDOWN = _flat(_cut(_flat("replace(replace(x, '_•_', '-'), '•', '-')"), "bookmark"))
_NOISE = _says("x", "running foot", "link or chapter")
PDF_NOISE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_line_sql()} AS line FROM documents),
l AS (
  SELECT doc_id, list_concat(['乐鑫信息科技 4 esp32 技术参考手册 v1.0', 'Chapter 3 Radio', 'Espressif Systems 12'], string_split_regex(line, '\\r\\n|[\\n\\r]'), flatten(list_transform(
         list_transform(string_split(text, chr(10)), lambda x, i: x || CASE WHEN (i - 1 + doc_id) % 3 = 0 THEN ' 乐鑫信息科技 1 ESP32 技术参考手册 v2 ' || x ELSE '' END), lambda x: string_split_regex(x, '\\r\\n|[\\n\\r]')))) AS ls FROM d),
a AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: {_MARKDOWN}), lambda x: x <> '' AND NOT {_NOISE}) AS ls FROM l),
b AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: {_flat(_cut(_cut('x', 'head inside'), 'foot inside', ' '))}), lambda x: x <> '' AND NOT {_NOISE}) AS ls FROM a),
o AS (SELECT doc_id, regexp_replace(array_to_string(ls, chr(10)), '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM b)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM o"""


def _book(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Titles of tables inside every source's pages, and contents entries that list some of them a page off or not at all."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    number = F.concat((n % 9 + 1).cast("string"), F.when(n % 2 == 0, "-").otherwise("."), (n % 40 + 1).cast("string"))
    words = F.regexp_replace(F.substring(F.coalesce("text", F.lit("x")), 1, 12), r"[^A-Za-z]+", "")
    titles = docs.select(F.col("source").alias("document_id"), (n % 50).cast("int").alias("page_number"), F.concat(F.lit("表 "), number, F.lit(" "), words).alias("title")).distinct()
    listed = docs.where(n % 3 != 0).select(
        F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("seq"), F.concat(F.lit("表"), number, F.lit(". "), words, F.lit(" listed")).alias("title"),
        (n % 50 + n % 4 - 1).cast("int").alias("target_page"), F.lit("table").alias("kind"),
    )
    return titles, listed


def canonical_titles(spark, sf_dir):
    """Table titles in the contents' wording: same number on this page, else on the one before, else on the one behind."""
    return pdf.canonical_titles(*_book(spark, sf_dir)).select("document_id", "page_number", "title", "canonical")


CANONICAL_TITLES = r"""
WITH d AS (
  SELECT source AS document_id, doc_id, doc_id % 50 AS page, (doc_id % 9 + 1) || CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '.' END || (doc_id % 40 + 1) AS num,
         (doc_id % 9 + 1) || '-' || (doc_id % 40 + 1) AS key, regexp_replace(substr(coalesce(text, 'x'), 1, 12), '[^A-Za-z]+', '', 'g') AS words FROM documents WHERE source IS NOT NULL),
t AS (SELECT DISTINCT document_id, page, key, num, words, '表 ' || num || ' ' || words AS title FROM d),
e AS (SELECT document_id, doc_id AS seq, key, '表' || num || '. ' || words || ' listed' AS listed, doc_id % 50 + doc_id % 4 - 1 AS target FROM d WHERE doc_id % 3 <> 0),
j AS (
  SELECT t.document_id, t.page, t.title, e.listed, row_number() OVER (PARTITION BY t.document_id, t.page, t.title
         ORDER BY CASE WHEN e.target = t.page THEN 0 WHEN e.target = t.page - 1 THEN 1 ELSE 2 END, e.seq) AS n
  FROM t JOIN e ON t.document_id = e.document_id AND t.key = e.key AND abs(t.page - e.target) <= 1)
SELECT t.document_id, CAST(t.page AS INT) AS page_number, t.title, coalesce(j.listed, trim('表' || num || '. ' || words)) AS canonical
FROM t LEFT JOIN (SELECT * FROM j WHERE n = 1) j ON t.document_id = j.document_id AND t.page = j.page AND t.title = j.title"""

QUERIES = {f.__name__: f for f in (pdf_line_scores, pdf_noise, canonical_titles)}
ORACLE_SQL = {"pdf_line_scores": PDF_LINE_SCORES, "pdf_noise": PDF_NOISE, "canonical_titles": CANONICAL_TITLES}
