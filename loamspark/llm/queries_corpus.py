"""Queries over ``documents`` for the operators that the corpus pipeline also uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import byte_bpe, decontamination, jaccard_join, line_runs, repetition_rules, simhash_vptree
from loamspark.llm.common import read_table


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_runs.dedup_lines(docs, runs_col="runs")
    return out.select(
        "doc_id",
        line_runs.count_lines(F.col("runs")).alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
s AS (
  SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS c,
         len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS w
  FROM l WHERE regexp_matches(line, '[\\p{L}\\p{N}]')),
p AS (
  SELECT *, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(w, 1) OVER d AS w2
  FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY c)),
win AS (
  SELECT doc_id, c, 1 AS len, line AS k FROM p WHERE w >= 10
  UNION ALL SELECT doc_id, c, 2, line || chr(10) || l2 FROM p WHERE l2 IS NOT NULL AND w + w2 >= 10
  UNION ALL SELECT doc_id, c, 3, line || chr(10) || l2 || chr(10) || l3 FROM p WHERE l3 IS NOT NULL),
later AS (
  SELECT doc_id, c, len FROM (SELECT *, row_number() OVER (PARTITION BY len, k ORDER BY doc_id, c) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, c + j AS c FROM later, (VALUES (0), (1), (2)) t(j) WHERE j < len),
worded AS (SELECT s.doc_id, s.ln, g.c IS NOT NULL AS gone FROM s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.c = g.c),
around AS (
  SELECT l.doc_id, l.ln, l.line,
         last_value(w.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
         first_value(w.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind
  FROM l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.ln = w.ln),
marked AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY ln), false) AS opens
  FROM (SELECT *, coalesce(before AND behind, false) AS gone FROM around)),
per AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
         coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN per USING (doc_id)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontamination.contamination_report(decontamination.decontaminate(docs, items))


OP6_SQL = """
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS k
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM dw, sizes WHERE len(ws) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM dwin d JOIN wins w ON d.n = w.n AND d.k = w.k),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = simhash_vptree.near_duplicates(docs)
    return found.select("doc_id", simhash_vptree.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules.repetition_rules(read_table(spark, sf_dir, "documents"))


def _cover(n: int) -> str:
    gram = ", ".join(["word", *[f"lead(word, {j}) OVER d" for j in range(1, n)]])
    return f"""
k{n} AS (
  SELECT doc_id, p, word, CASE WHEN lead(p, {n - 1}) OVER d IS NOT NULL THEN concat_ws(' ', {gram}) END AS gram
  FROM pos WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
g{n} AS (
  SELECT doc_id, word, max(CASE WHEN gram IS NOT NULL AND c > 1 THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM k{n})),
s{n} AS (SELECT doc_id, sum(hit) AS words, sum(hit * length(word)) AS chars FROM g{n} GROUP BY doc_id)"""


OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),{_cover(3)},{_cover(4)},{_cover(7)},{_cover(10)},
ln AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS r
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) FILTER (r > 1) AS n, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) FILTER (r > 1), 0) AS chars FROM ln GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines,
         coalesce(s3.words, 0) AS n_repeat_words, coalesce(dl.chars, 0) AS dup_line_chars,
         coalesce(s4.chars, 0) AS dup_chars_short, coalesce(s7.chars, 0) AS dup_chars_mid, coalesce(s10.chars, 0) AS dup_chars_long
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN s3 USING (doc_id) LEFT JOIN s4 USING (doc_id) LEFT JOIN s7 USING (doc_id) LEFT JOIN s10 USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(dup_line_chars AS BIGINT) AS dup_line_chars,
       CAST(dup_chars_short AS BIGINT) AS dup_chars_short, CAST(dup_chars_mid AS BIGINT) AS dup_chars_mid, CAST(dup_chars_long AS BIGINT) AS dup_chars_long,
       base_failed, NOT (base_failed OR 100 * dup_chars_short > 40 * word_chars OR 100 * dup_chars_mid > 30 * word_chars
                         OR 100 * dup_chars_long > 25 * word_chars OR 100 * dup_line_chars > 40 * word_chars) AS kept
FROM f
"""

def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * shared >= 90 * (sx.n + sy.n - shared)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


QUERIES = {
    "op3_byte_bpe": op3_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_jaccard_join": op11_jaccard_join,
}
ORACLE_SQL = {"op5_line_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_jaccard_join": OP11_SQL}
