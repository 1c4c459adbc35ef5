"""Queries of conversations, stored tables, chunk text, quality reports, pages and PDF structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import metadata, quality
from loamspark.functions import text as X
from loamspark.operators import chunking, evaluation, pdf, sessions
from loamspark.operators.blocks import line_blocks
from loamspark.schemas import CHUNKS, VECTORS, conform
from loamspark.sources import html, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- conversations ---------------------------------------------------------------------------


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id").withColumnRenamed("text", "content")


def session_summary(spark, sf_dir):
    return sessions.sessions(_turns(spark, sf_dir)).withColumnRenamed("session_id", "conv_id")


SESSION_SUMMARY = r"""
WITH t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM conversations),
f AS (SELECT conv_id, arg_min(flat, turn) AS q FROM t WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN q IS NULL OR q = '' THEN '新会话' WHEN length(q) > 30 THEN substr(q, 1, 30) || '...' ELSE q END AS title,
       count(*) AS turn_count, arg_max(substr(text, 1, 120), turn) AS last_message
FROM conversations c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id, q"""


def recent_messages(spark, sf_dir):
    out = sessions.messages(_turns(spark, sf_dir), 6)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return out.select(F.col("session_id").alias("conv_id"), F.size("messages").cast("long").alias("n"), F.sha2(said, 256).alias("messages_sha256"))


RECENT_MESSAGES = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_sha256 FROM r WHERE n <= 6 GROUP BY conv_id"""


def query_with_history(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    asked = turns.groupBy("session_id").agg(F.max("turn").alias("last")).select("session_id", F.concat(F.lit("turn "), F.col("last")).alias("question"))
    out = sessions.history_query(turns, asked, 2)
    return out.select(F.col("session_id").alias("conv_id"), F.sha2("query", 256).alias("query_sha256"))


QUERY_WITH_HISTORY = r"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user'),
h AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS recent FROM r WHERE n <= 2 AND regexp_matches(text, '\S') GROUP BY conv_id),
q AS (SELECT conv_id, 'turn ' || max(turn) AS question FROM conversations GROUP BY conv_id)
SELECT q.conv_id, sha256(CASE WHEN recent IS NULL THEN question ELSE recent || chr(10) || question END) AS query_sha256 FROM q LEFT JOIN h USING (conv_id)"""


# --- stored tables ------------------------------------------------------------------------------


def _stored_vectors(spark, sf_dir):
    """Vectors of all but every ninth document, some inactive, some of an older text, some of no document."""
    docs = table(spark, sf_dir, "documents")
    kept = docs.where("doc_id % 9 <> 0").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("old")), 256)).when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.sha2("text", 256)).alias("chunk_hash"),
        (F.col("doc_id") % 5 != 0).alias("is_active"),
    )
    orphans = docs.where("doc_id % 13 = 0").select(F.concat(F.lit("gone:"), "doc_id").alias("chunk_id"), F.lit("x").alias("chunk_hash"), F.lit(True).alias("is_active"))
    return kept.unionByName(orphans)


def consistency_check(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return store.consistency(chunks, _stored_vectors(spark, sf_dir), F.sha2("text", 256))


CONSISTENCY = """
WITH v AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'old') WHEN doc_id % 11 = 0 THEN '' ELSE sha256(text) END AS h, doc_id % 5 <> 0 AS a
  FROM documents WHERE doc_id % 9 <> 0
  UNION ALL SELECT 'gone:' || doc_id, 'x', true FROM documents WHERE doc_id % 13 = 0),
c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS now FROM documents)
SELECT (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM v) AS vectors,
       (SELECT count(*) FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM v WHERE a)) AS missing_vectors,
       (SELECT count(*) FROM v JOIN c USING (chunk_id) WHERE h <> '' AND h <> now) AS stale_vectors,
       (SELECT count(*) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM c)) AS orphan_vectors"""


def upsert_vectors(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    row = lambda df, tag: conform(df.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit(tag).alias("chunk_hash"), F.lit("c").alias("collection_id"), F.col("embedding").cast("array<double>").alias("values")), VECTORS)
    out = store.upserted(row(base.where("vec_id % 3 <> 0"), "old"), row(base.where("vec_id % 2 = 0"), "new"))
    return out.select("chunk_id", "chunk_hash", F.round(F.col("values")[0], 6).alias("first"))


UPSERT = """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS chunk_hash, round(CAST(embedding[1] AS DOUBLE), 6) AS first
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0"""


def delete_document(spark, sf_dir):
    vectors = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("collection_id"), "doc_id")
    return store.without_document(vectors, "src4", "en").groupBy("document_id", "collection_id").agg(F.count("*").alias("n"))


DELETE = "SELECT source AS document_id, lang AS collection_id, count(*) AS n FROM documents WHERE NOT (source = 'src4' AND lang = 'en') GROUP BY source, lang"


def dedupe_ingest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "source_url")
    stored = pages.where("page_id % 4 = 1").select("source_url")
    return store.not_stored(pages, stored, "source_url").select("page_id")


DEDUPE = "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 1)"


# --- chunk text -------------------------------------------------------------------------------------


def sentence_split(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("sentences_sha256"))


SENTENCES = r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([。！？；.!?;])\s*', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM p)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, chr(10))) AS sentences_sha256 FROM s"""


def chunk_pack(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunking.packed_chunks(texts).select("document_id", "chunk_index", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


#: Units are packed one by one, so the packer is a recursion over their numbers.
CHUNK_PACK = rf"""
WITH RECURSIVE c AS (
  SELECT doc_id, {_stripped("regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n{_BLANK}*\n'), lambda x: {_stripped('x')}), lambda x: x <> '') AS ps FROM c),
f AS (
  SELECT doc_id, flatten(list_transform(ps, lambda x: CASE WHEN length(x) <= 700 THEN [x] ELSE
         list_filter(list_transform(string_split(regexp_replace(x, '([。！？；.!?;]){_BLANK}*', '\1' || chr(1), 'g'), chr(1)), lambda y: {_stripped('y')}), lambda y: y <> '') END)) AS us FROM p),
u AS (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS i FROM f),
st AS (
  SELECT doc_id, i, unit AS cur, CAST(NULL AS VARCHAR) AS done FROM u WHERE i = 1
  UNION ALL
  SELECT st.doc_id, u.i, CASE WHEN length(cur) + 2 + length(unit) <= 700 THEN cur || chr(10) || chr(10) || unit ELSE {_stripped('right(cur, 120) || chr(10) || unit')} END,
         CASE WHEN length(cur) + 2 + length(unit) <= 700 THEN NULL ELSE cur END
  FROM st JOIN u ON u.doc_id = st.doc_id AND u.i = st.i + 1),
o AS (
  SELECT doc_id, i, {_stripped('done')} AS content FROM st WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, {_stripped('cur')} FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS top FROM st) WHERE i = top)
SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, length(content) AS n_chars, sha256(content) AS content_sha256 FROM o WHERE content <> ''"""

#: Each decision changes the next, so merging is a recursion over the rows: the last row kept, and a text carried into the next one.
MERGE_SHORT = rf"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
k AS (
  SELECT doc_id, seq, line, seq % 3 <> 1 AS txt, seq // 4 AS sec, lead(line) OVER d AS n_line, lead(seq % 3 <> 1) OVER d AS n_txt, lead(seq // 4) OVER d AS n_sec
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY seq)),
st AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS p_seq, CAST(NULL AS VARCHAR) AS p_text, CAST(NULL AS BIGINT) AS p_sec, false AS p_txt,
         CAST(NULL AS VARCHAR) AS carried, CAST(NULL AS BIGINT) AS o_seq, CAST(NULL AS VARCHAR) AS o_text FROM k WHERE seq = 0
  UNION ALL
  SELECT doc_id, seq, CASE WHEN act = 'keep' THEN seq ELSE p_seq END, CASE act WHEN 'keep' THEN c WHEN 'back' THEN {_stripped("p_text || chr(10) || chr(10) || c")} ELSE p_text END,
         CASE WHEN act = 'keep' THEN sec ELSE p_sec END, CASE WHEN act = 'keep' THEN txt ELSE p_txt END, CASE WHEN act = 'on' THEN c END,
         CASE WHEN act = 'keep' THEN p_seq END, CASE WHEN act = 'keep' THEN p_text END
  FROM (
    SELECT *, CASE WHEN NOT txt OR length(c) >= 50 THEN 'keep' WHEN p_txt AND p_sec = sec AND length(p_text) + length(c) <= 1800 THEN 'back'
                   WHEN coalesce(n_txt, false) AND n_sec = sec AND length(c) + length(n_line) <= 1800 THEN 'on' ELSE 'keep' END AS act
    FROM (SELECT k.*, p_seq, p_text, p_sec, p_txt, CASE WHEN carried IS NULL THEN line ELSE {_stripped("carried || chr(10) || chr(10) || line")} END AS c
          FROM st JOIN k ON k.doc_id = st.doc_id AND k.seq = st.seq + 1))),
o AS (
  SELECT doc_id, o_seq AS seq, o_text AS content FROM st WHERE o_seq IS NOT NULL
  UNION ALL SELECT doc_id, p_seq, p_text FROM (SELECT *, max(seq) OVER (PARTITION BY doc_id) AS top FROM st) WHERE seq = top AND p_seq IS NOT NULL)
SELECT doc_id, CAST(seq AS INT) AS seq, sha256(content) AS content_sha256 FROM o"""


def chunk_fingerprints(spark, sf_dir):
    columns = {"content": F.col("text"), "section_path": F.array("lang", "source"), "page_label": F.lit(None).cast("string"), "location_label": F.col("source")}
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_fingerprint(columns.__getitem__).alias("chunk_hash"))


FINGERPRINTS = "SELECT doc_id, sha256(text || chr(10) || lang || '|' || source || chr(10) || chr(10) || source) AS chunk_hash FROM documents"


def _line_rows(spark, sf_dir):
    """Lines of documents as blocks; every third is taken for code."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.select(
        F.col("doc_id").alias("document_id"), F.col("ln").alias("seq"), F.when(F.col("ln") % 3 == 1, "code").otherwise("text").alias("block_type"), F.col("line").alias("content"),
        F.array(F.floor(F.col("ln") / 4).cast("string")).alias("section_path"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("source_uri"),
        F.lit(None).cast("string").alias("context_before"), F.lit(None).cast("string").alias("context_after"),
    )


def context_attach(spark, sf_dir):
    out = chunking.attach_code_context(_line_rows(spark, sf_dir))
    return out.select(F.col("document_id").alias("doc_id"), "seq", F.sha2(F.coalesce("context_before", F.lit("-")), 256).alias("before"), F.sha2(F.coalesce("context_after", F.lit("-")), 256).alias("after"))


CONTEXT_ATTACH = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
k AS (SELECT *, seq % 3 = 1 AS code, seq // 4 AS sec FROM l),
w AS (SELECT *, lag(line) OVER d AS pl, lag(code) OVER d AS pc, lag(sec) OVER d AS ps, lead(line) OVER d AS nl, lead(code) OVER d AS nc, lead(sec) OVER d AS ns
      FROM k WINDOW d AS (PARTITION BY doc_id ORDER BY seq)),
c AS (SELECT *, code AND (length(line) < 120 OR regexp_matches(line, '\S')) AS short,
             trim(regexp_replace(substr(pl, 1, 500), '\s+', ' ', 'g')) AS pt, trim(regexp_replace(substr(nl, 1, 500), '\s+', ' ', 'g')) AS nt FROM w),
n AS (SELECT *, lag(short) OVER d AS p_short, lead(short) OVER d AS n_short, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS t FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY seq)),
x AS (SELECT *, NOT code AND t <> '' AND length(t) <= 100 AND regexp_matches(t, '(?:is in|implementation is in|content of|file is|following|below)\s*[\w./+-]*:?\s*$')
                AND ((p_short AND ps = sec) OR (n_short AND ns = sec)) AS dropped FROM n)
SELECT doc_id, seq, sha256(CASE WHEN short AND NOT pc AND ps = sec AND pt <> '' THEN pt ELSE '-' END) AS before,
       sha256(CASE WHEN short AND NOT nc AND ns = sec AND nt <> '' THEN nt ELSE '-' END) AS after FROM x WHERE NOT coalesce(dropped, false)"""


def page_regions(spark, sf_dir):
    rows = _line_rows(spark, sf_dir).select("document_id", "seq", F.floor(F.col("seq") / 5).cast("int").alias("page_number"), F.col("content").alias("text"), F.col("block_type").alias("role"))
    return chunking.document_blocks(rows).select(F.col("document_id").alias("doc_id"), "seq", "block_id", "order_on_page", "page_region")


PAGE_REGIONS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
p AS (SELECT doc_id, seq, seq // 5 AS page, row_number() OVER (PARTITION BY doc_id, seq // 5 ORDER BY seq) AS o, count(*) OVER (PARTITION BY doc_id, seq // 5) AS n FROM l)
SELECT doc_id, seq, 'block:' || page || ':' || o AS block_id, o AS order_on_page,
       CASE WHEN n = 1 THEN 'middle' WHEN (o - 1) / n < 0.33 THEN 'top' WHEN (o - 1) / n < 0.66 THEN 'middle' ELSE 'bottom' END AS page_region FROM p"""


def merge_short(spark, sf_dir):
    rows = _line_rows(spark, sf_dir).withColumns({c: F.lit(None).cast("int") for c in ("line_start", "line_end", "paragraph_start", "paragraph_end")})
    out = chunking.merge_short(rows)
    return out.select(F.col("document_id").alias("doc_id"), "seq", F.sha2("content", 256).alias("content_sha256"))


def neighbor_expand(spark, sf_dir):
    from loamspark.operators.answering import expanded_content

    rows = _line_rows(spark, sf_dir).select(F.concat_ws(":", "document_id", "seq").alias("id"), F.col("document_id").cast("string").alias("document_id"), F.col("seq").alias("chunk_index"), F.lit("code").alias("block_type"), F.lit("guide").alias("doc_type"), "content")
    scope = rows.where(F.col("chunk_index") % 5 != 0).select(F.lit(1).alias("question_id"), "id")
    within = lambda found: found.join(scope.withColumnRenamed("id", "chunk_id"), ["question_id", "chunk_id"], "left_semi")
    return expanded_content(scope, rows, within).select("id", F.sha2("expanded", 256).alias("expanded_sha256"))


NEIGHBORS = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
s AS (SELECT doc_id, seq, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l WHERE seq % 5 <> 0),
w AS (SELECT *, lag(seq) OVER d AS ps, lag(t) OVER d AS pt, lead(seq) OVER d AS ns, lead(t) OVER d AS nt FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY seq))
SELECT doc_id || ':' || seq AS id, sha256(CASE WHEN t = '' THEN '' ELSE concat_ws(chr(10) || chr(10), CASE WHEN ps = seq - 1 THEN nullif(pt, '') END, t, CASE WHEN ns = seq + 1 THEN nullif(nt, '') END) END) AS expanded_sha256
FROM w"""


# --- quality -------------------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return conform(
        docs.select(
            F.col("doc_id").cast("string").alias("id"), F.col("source").alias("document_id"), F.col("doc_id").cast("int").alias("chunk_index"), F.col("text").alias("content"),
            F.when(F.contains("text", F.lit("|")), "table").when(F.col("doc_id") % 10 == 3, "code").otherwise("text").alias("block_type"), F.array("lang", F.substring("text", 1, 60)).alias("section_path"),
        ),
        CHUNKS,
    )


def quality_report(spark, sf_dir):
    return evaluation.corpus_report(_chunks(spark, sf_dir)).select("chunks", F.round("median_length", 4).alias("median_length"), F.round("mean_length", 4).alias("mean_length"), "very_short", "short", "long", "bad_start", "table_chunks", "code_chunks")


_KIND = "CASE WHEN contains(text, '|') THEN 'table' WHEN doc_id % 10 = 3 THEN 'code' ELSE 'text' END"
_BAD = r"(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 30 AND regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[a-z，,。.；;：:）)]'))"
QUALITY_REPORT = f"""
SELECT count(*) AS chunks, round(median(length(text)), 4) AS median_length, round(avg(length(text)), 4) AS mean_length, count(*) FILTER (length(text) < 50) AS very_short,
       count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (length(text) > 2000) AS long, count(*) FILTER ({_KIND} = 'text' AND {_BAD}) AS bad_start,
       count(*) FILTER ({_KIND} = 'table') AS table_chunks, count(*) FILTER ({_KIND} = 'code') AS code_chunks
FROM documents"""


def per_source_report(spark, sf_dir):
    out = evaluation.document_report(_chunks(spark, sf_dir))
    return out.select(F.col("document_id").alias("source"), "chunks", F.round("median_length", 4).alias("median_length"), "short", F.array_join(F.transform(F.array_sort(F.map_entries("block_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("block_types"))


PER_SOURCE = f"""
WITH k AS (SELECT source, {_KIND} AS b, count(*) AS n FROM documents GROUP BY source, b)
SELECT source, count(*) AS chunks, round(median(length(text)), 4) AS median_length, count(*) FILTER (length(text) < 100) AS short,
       (SELECT string_agg(b || ':' || n, ',' ORDER BY b) FROM k WHERE k.source = d.source) AS block_types
FROM documents d GROUP BY source"""


def section_issue_counts(spark, sf_dir):
    return evaluation.section_issues(_chunks(spark, sf_dir))


def table_issue_counts(spark, sf_dir):
    return evaluation.table_issues(_chunks(spark, sf_dir))


def code_issue_counts(spark, sf_dir):
    return evaluation.code_issues(_chunks(spark, sf_dir))


def bad_start(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(quality.is_bad_start(F.col("text"))).select("doc_id")


BAD_START = f"SELECT doc_id FROM documents WHERE {_BAD}"


def examples_topn(spark, sf_dir):
    short = table(spark, sf_dir, "documents").where(F.length("text") < 400).select(F.col("source").alias("issue"), F.col("doc_id").alias("seq"), X.one_line(F.col("text"), 40).alias("detail"))
    return evaluation.first_examples(short, 3).select("issue", "seq", "detail", F.col("n").cast("long").alias("n"))


EXAMPLES = r"""
WITH s AS (SELECT source AS issue, doc_id AS seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents WHERE length(text) < 400),
r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY seq) AS n FROM s)
SELECT issue, seq, CASE WHEN length(t) > 40 THEN substr(t, 1, 40) || '...' ELSE t END AS detail, n FROM r WHERE n <= 3"""


def readability_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.readability(F.col("text")), 6).alias("readability"))


# --- pages and metadata -----------------------------------------------------------------------------------


def html_extract(spark, sf_dir):
    out = html.extracted_pages(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "title", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def html_extract_compat(spark, sf_dir):
    out = html.extracted_pages(table(spark, sf_dir, "pages"), "compat")
    return out.select(F.col("id").alias("page_id"), F.sha2("text", 256).alias("text_sha256"))


def web_blocks(spark, sf_dir):
    out = html.page_blocks(html.extracted_pages(table(spark, sf_dir, "pages")))
    return out.select(F.col("document_id").alias("page_id"), "seq", "source_uri", "location_label", F.length("text").alias("n_chars"))


def text_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = line_blocks(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("f.txt").alias("filename"), F.lit("f.txt").alias("source_uri"), F.lit("text").alias("role"), "text"))
    return out.select("document_id", "seq", "line_start", "line_end", F.sha2("text", 256).alias("text_sha256"))


def language_version(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", metadata.language(F.col("url")).alias("language"), metadata.version(F.col("url")).alias("version"), X.slug(F.col("url")).alias("slug"))


LANGUAGE_VERSION = r"""
WITH u AS (SELECT page_id, lower(url) AS l, regexp_extract(lower(url), '\bv\d+(?:\.\d+){1,2}\b') AS v FROM pages)
SELECT page_id, CASE WHEN contains(l, 'zh_cn') OR regexp_matches(l, '[\x{4e00}-\x{9fff}]') THEN 'zh-CN' WHEN contains(l, '_en.') OR contains(l, '/en/') OR contains(l, 'english') THEN 'en' END AS language,
       CASE WHEN v <> '' THEN v WHEN contains(l, 'stable') THEN 'stable' WHEN contains(l, 'latest') THEN 'latest' END AS version,
       trim(regexp_replace(regexp_replace(trim(l), '[^\p{L}\p{N}_\x{4e00}-\x{9fff}-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS slug FROM u"""


def profile_resolve(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind = F.element_at(F.array(*map(F.lit, ("web", "markdown", "code", "pdf", "docx"))), (F.col("page_id") % 5 + 1).cast("int"))
    title = F.when(F.col("page_id") % 3 == 0, F.lit("Chapter about ESP32")).otherwise("t")
    docs = pages.select("page_id", F.lit("f").alias("filename"), title.alias("title"), F.lit("p").alias("source_path"), F.lit("u").alias("source_url"), kind.alias("source_format"))
    return chunking.resolve_profile(docs).select("page_id", "profile_id", "chunk_strategy")


PROFILE_RESOLVE = """
WITH k AS (SELECT page_id, ['web', 'markdown', 'code', 'pdf', 'docx'][page_id % 5 + 1] AS f, page_id % 3 = 0 AS named FROM pages)
SELECT page_id,
       CASE WHEN f IN ('web', 'markdown') AND named THEN 'espidf' WHEN f = 'pdf' AND named THEN 'vehicle_textbook' WHEN f = 'web' THEN 'web_article' WHEN f = 'markdown' THEN 'markdown_guide'
            WHEN f = 'code' THEN 'source_code' WHEN f = 'pdf' THEN 'pdf_document' ELSE 'general' END AS profile_id,
       CASE WHEN f IN ('web', 'markdown') AND named THEN 'markdown_guide' WHEN f = 'web' THEN 'web_article' WHEN f = 'markdown' THEN 'markdown_guide' WHEN f = 'code' THEN 'source_code'
            WHEN f = 'pdf' THEN 'pdf_document' ELSE 'generic_text' END AS chunk_strategy FROM k"""


# --- PDF structure --------------------------------------------------------------------------------------------


def _pages_of_lines(spark, sf_dir):
    """Documents as paged text of six lines a page, under a running head and over a page number."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    paged = lines.groupBy("doc_id", "source", (F.floor(F.col("ln") / 6) + 1).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("rows"))
    body = F.transform("rows", lambda r: r["line"])
    framed = F.concat(F.array(F.concat(F.lit("Manual of "), "source")), body, F.array(F.concat(F.lit("Issue of May "), F.col("page_number").cast("string"))))
    return paged.select(F.col("doc_id").cast("string").alias("document_id"), "page_number", framed.alias("lines"))


def margin_noise(spark, sf_dir):
    found = pdf.margin_noise(_pages_of_lines(spark, sf_dir))
    return found.select(F.col("document_id").alias("doc_id"), "place", "signature")


MARGIN_NOISE = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents),
p AS (SELECT doc_id, source, ln // 6 + 1 AS page, list(line ORDER BY ln) AS ls FROM l GROUP BY doc_id, source, ln // 6),
f AS (SELECT doc_id, page, list_concat(['Manual of ' || source], ls, ['Issue of May ' || page]) AS ls FROM p),
c AS (
  SELECT doc_id, page, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM f),
x AS (SELECT doc_id, page, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM c),
s AS (
  SELECT *, replace(regexp_replace(regexp_replace(line, '第\s*\d+\s*页', ' ', 'g'), '\b\d{1,3}\b', '#', 'g'), ' ', '') AS signature
  FROM x WHERE NOT regexp_matches(line, '目录|表格|插图')),
places AS (
  SELECT doc_id, 'head' AS place, signature FROM s WHERE i < 2 AND length(signature) >= 4
  UNION ALL SELECT doc_id, 'foot', signature FROM s WHERE i >= n - 3 AND length(signature) >= 4),
total AS (SELECT doc_id, count(*) AS pages FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, place, signature
FROM places JOIN total USING (doc_id) GROUP BY doc_id, place, signature, pages
HAVING count(*) >= CASE WHEN pages < 20 THEN 3 ELSE greatest(3, pages // 10) END""".replace("\\\\", "\\")


def contents_entries(spark, sf_dir):
    """Contents pages made of the orders' numbers: sections, tables and figures, some over two lines."""
    lines = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 97).cast("string").alias("document_id"),
        F.col("o_orderkey").alias("k"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 5).cast("string"), F.lit(" "), F.lower("o_orderpriority"), F.lit(" "), (F.col("o_orderkey") % 900 + 1).cast("string")).alias("line"),
    )
    pages = lines.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda r: r["line"]).alias("ls"))
    pages = pages.select("document_id", F.lit(1).alias("page_number"), F.concat(F.array(F.lit(pdf.rules.CONTENTS)), "ls").alias("lines"))
    return pdf.contents_table(pages).select(F.col("document_id").alias("doc"), F.col("seq").cast("long").alias("seq"), "title", F.col("target_page").cast("long").alias("target_page"), F.array_join("path", "/").alias("path"), "kind")


CONTENTS_ENTRIES = """
WITH e AS (
  SELECT CAST(o_orderkey % 97 AS VARCHAR) AS doc, o_orderkey AS k, o_orderkey % 900 + 1 AS target_page,
         trim(o_orderkey || '.' || (o_orderkey % 5) || ' ' || lower(o_orderpriority)) AS title FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS seq, first_value(title) OVER (PARTITION BY doc ORDER BY k) AS top FROM e)
SELECT doc, seq, title, target_page, CASE WHEN seq = 0 THEN title ELSE top || '/' || title END AS path, 'section' AS kind FROM n"""


def pdf_block_parse(spark, sf_dir):
    out = pdf.pdf_blocks(_pages_of_lines(spark, sf_dir))
    return out.select("document_id", "seq", "role", "page_number", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = {
    "session_summary": SESSION_SUMMARY,
    "recent_messages": RECENT_MESSAGES,
    "query_with_history": QUERY_WITH_HISTORY,
    "consistency_check": CONSISTENCY,
    "upsert_vectors": UPSERT,
    "delete_document": DELETE,
    "dedupe_ingest": DEDUPE,
    "sentence_split": SENTENCES,
    "chunk_pack": CHUNK_PACK,
    "merge_short": MERGE_SHORT,
    "chunk_fingerprints": FINGERPRINTS,
    "context_attach": CONTEXT_ATTACH,
    "page_regions": PAGE_REGIONS,
    "neighbor_expand": NEIGHBORS,
    "quality_report": QUALITY_REPORT,
    "per_source_report": PER_SOURCE,
    "bad_start": BAD_START,
    "examples_topn": EXAMPLES,
    "language_version": LANGUAGE_VERSION,
    "profile_resolve": PROFILE_RESOLVE,
    "margin_noise": MARGIN_NOISE,
    "contents_entries": CONTENTS_ENTRIES,
}
QUERIES = {
    f.__name__: f
    for f in (
        session_summary, recent_messages, query_with_history, consistency_check, upsert_vectors, delete_document, dedupe_ingest, sentence_split, chunk_pack,
        chunk_fingerprints, context_attach, page_regions, merge_short, neighbor_expand, quality_report, per_source_report, section_issue_counts,
        table_issue_counts, code_issue_counts, bad_start, examples_topn, readability_scores, html_extract, html_extract_compat, web_blocks, text_blocks,
        language_version, profile_resolve, margin_noise, contents_entries, pdf_block_parse,
    )
}
