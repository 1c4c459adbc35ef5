"""Queries of whole answers: scope as a predicate, exact symbols, both legs with heuristics and tasks.

Documents are chunks of all kinds (``scoring``); questions are the inline ones, which hold
every trap, and all benchmark items; vectors are those of ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import text as X
from loamspark.operators import answering, ranking, scoping
from loamspark.operators.intent import HINT_IGNORED, SCOPE_BLUETOOTH, SCOPE_CATALOG, SCOPE_CODE, analyzed
from loamspark.plans import scoring
from loamspark.plans import sql as S
from loamspark.plans.questions import frame
from loamspark.plans.retrieval import TASK_ROUTE, table
from loamspark.schemas import CHUNKS, conform
from loamspark.session import materialized

TOP_K = 5
ITEM = 1000  # what is added to an item's id


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") + ITEM).cast("int").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))
    return frame(spark).unionByName(items)


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents, and one chunk of each."""
    title = F.concat(F.lit("manual_"), F.coalesce("source", F.lit("none")))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.concat(title, F.lit(".md")).alias("filename"), F.lit(None).cast("string").alias("source_path"))
    rows = scoring.rows(spark, sf_dir).withColumns({"id": F.col("doc_id").cast("string"), "document_id": F.col("doc_id").cast("string"), "chunk_index": F.lit(0)})
    return documents, conform(rows, CHUNKS)


def _scope(spark: SparkSession, sf_dir: str) -> scoping.Scope:
    documents, chunks = _library(spark, sf_dir)
    asked = materialized(analyzed(_questions(spark, sf_dir), TOP_K))
    return scoping.question_scope(asked, chunks, scoping.named_documents(asked, documents))


def scope_cascade(spark, sf_dir):
    """How many chunks each question searches, and which, from sums by profile."""
    scope = _scope(spark, sf_dir)
    sums = scope.sums({"n_chunks": F.lit(1), "ids": F.col("id").cast("long")})
    return sums.select("question_id", "n_chunks", "ids")


def exact_symbol_lookup(spark, sf_dir):
    """Chunks that define a symbol which the question names, for questions about code."""
    chunks = _library(spark, sf_dir)[1]
    return answering.exact_symbols(_scope(spark, sf_dir), chunks, TOP_K).select("question_id", "rank", F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def answers(spark, sf_dir):
    """Cited chunks of every question: scope, BM25 and vectors in it, fusion, heuristics, the cut, the task's order, exact symbols instead."""
    documents, chunks = _library(spark, sf_dir)
    chunks = materialized(chunks)
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.lit("default").alias("collection_id"), F.lit("hash").alias("provider"), F.lit("hash").alias("model"),
        F.size("embedding").alias("dimension"), F.lit(True).alias("is_active"), F.col("embedding").cast("array<double>").alias("values"),
    )
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = _questions(spark, sf_dir).withColumn("vec_id", F.col("question_id") % 400)
    asked = asked.join(own, "vec_id", "left").drop("vec_id")
    found = answering.answerable(asked, documents, chunks, vectors, answering.Settings(top_k=TOP_K, dimension=64), latin=F.col("content"))
    return found.select("question_id", "rank", F.col("chunk_id").cast("long").alias("doc_id"), "score")


_ASKED = f"(SELECT question_id, question FROM {S.ASKED} UNION ALL SELECT CAST(item_id + {ITEM} AS INT), coalesce(text, '') FROM benchmark) AS t"
_FOLDED = f"regexp_replace(replace(lower(regexp_replace(question, '^{scoring.SPACE}+|{scoring.SPACE}+$', '', 'g')), '\\', '/'), '{scoring.SPACE}+', ' ', 'g')"
_WORDS = r"list_distinct(list_filter(regexp_extract_all(question, '[\pL\pM\p{Nd}\p{Pc}]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{2,}')))"
_HINTS = f"list_distinct(list_transform(list_filter({_WORDS}, lambda w: contains(w, '_') OR regexp_matches(substr(w, 2), '[A-Z]') OR NOT lower(w) IN ({', '.join(map(S.text, HINT_IGNORED))})), lambda w: lower(w)))"


def _head(length: int, symbol: bool) -> str:
    parts = f"{'symbol_name, ' if symbol else ''}document_title, coalesce(array_to_string(section_path, ' > '), ''), substr(content, 1, {length})"
    return f"regexp_replace(replace(lower(concat_ws(' ', {parts})), '\\', '/'), '{scoring.SPACE}+', ' ', 'g')"


def _kept(name: str, before: str, flag: str, used: str) -> str:
    """A filter that holds only if something of the question passes it."""
    return f"{name} AS (SELECT * EXCLUDE (some_) FROM (SELECT *, bool_or({flag}) OVER (PARTITION BY question_id) AS some_ FROM {before}) WHERE NOT (({used}) AND some_) OR {flag})"


SCOPED = f"""
{TASK_ROUTE[: TASK_ROUTE.index('SELECT question_id, task_type, CASE')].rstrip().replace(f'FROM {S.ASKED}', f'FROM {_ASKED}')},
{scoring.ROWS},
qq AS (
  SELECT question_id, question, task_type, folded, hints, {S.any_of('folded', SCOPE_CATALOG)} AS wants_catalog, {S.any_of('folded', SCOPE_BLUETOOTH)} AS wants_bluetooth,
         {S.any_of('folded', SCOPE_CODE)} OR task_type = 'code_symbol_lookup' AS code,
         CASE task_type WHEN 'book_index' THEN ['toc', 'text'] WHEN 'table_lookup' THEN ['table', 'text'] WHEN 'code_symbol_lookup' THEN ['code', 'text'] ELSE [] END AS blocks
  FROM (SELECT question_id, question, {_FOLDED} AS folded, {_HINTS} AS hints FROM {_ASKED}) JOIN q USING (question_id)),
h AS (SELECT *, {_head(800, False)} AS head, {_head(1000, True)} AS hint_text FROM d),
f AS (
  SELECT doc_id, block_type, lower(coalesce(symbol_name, '')) AS symbol, hint_text, coalesce(doc_type IN ('catalog', 'product_catalog'), false) AS low, {S.any_of('head', SCOPE_BLUETOOTH)} AS b,
         coalesce(doc_type IN ({', '.join(map(S.text, ranking.CODE_TYPES))}), false) OR coalesce(block_type = 'code', false) OR coalesce(symbol_name, '') <> '' OR line_start IS NOT NULL
         OR {S.any_of('head', scoping.CODE_TEXT)} AS c FROM h),
nm AS (SELECT question_id, doc_id FROM qq JOIN documents ON contains(folded, 'manual_' || lower(coalesce(source, 'none')))),
s0 AS (
  SELECT question_id, task_type, hints, wants_bluetooth, code, blocks, doc_id, symbol, b, c, coalesce(list_contains(blocks, block_type), false) AS l, len(list_filter(hints, lambda x: contains(hint_text, x))) > 0 AS hinted
  FROM qq, f WHERE question_id NOT IN (SELECT question_id FROM nm) AND NOT wants_catalog AND NOT low),
{_kept('s1', 's0', 'b', "wants_bluetooth AND len(hints) = 0 AND task_type <> 'book_index'")},
{_kept('s2', 's1', 'l', 'len(blocks) > 0')},
{_kept('s3', 's2', 'c', 'code')},
{_kept('s4', 's3', 'hinted', 'code AND len(hints) > 0')},
sc AS (
  SELECT question_id, doc_id FROM s4 UNION ALL SELECT question_id, doc_id FROM nm
  UNION ALL SELECT question_id, doc_id FROM qq, f WHERE wants_catalog AND question_id NOT IN (SELECT question_id FROM nm)),
ex AS (
  SELECT question_id, doc_id, rank, 1.0 - rank * 0.01 AS score FROM (
    SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY document_title NULLS FIRST, symbol_name, CAST(doc_id AS VARCHAR)) AS rank
    FROM s4 JOIN d USING (doc_id) WHERE code AND symbol <> '' AND list_contains(hints, symbol)) WHERE rank <= {TOP_K})"""

SCOPE_CASCADE = f"{SCOPED} SELECT question_id, count(*) AS n_chunks, CAST(sum(doc_id) AS BIGINT) AS ids FROM sc GROUP BY question_id"
EXACT_SYMBOLS = f"{SCOPED} SELECT question_id, CAST(rank AS INT) AS rank, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM ex"

ANSWERS = f"""{SCOPED},
oq AS (SELECT * FROM qq WHERE question_id NOT IN (SELECT question_id FROM ex)),
os AS (SELECT sc.* FROM sc JOIN oq USING (question_id)),
lim AS (SELECT question_id, 8 * greatest(40, {TOP_K}, CASE WHEN task_type = 'book_index' THEN 50 ELSE 40 END) AS k FROM oq),
dt AS (SELECT doc_id, {S.latin('content')} AS ts FROM d),
postings AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM dt) GROUP BY token, doc_id),
placed AS (SELECT question_id, doc_id, len(ts) AS dl FROM os JOIN dt USING (doc_id)),
st AS (SELECT question_id, count(*) AS n, avg(dl) AS avgdl FROM placed GROUP BY question_id),
asked AS (SELECT question_id, token, count(*) AS qtf FROM (SELECT question_id, unnest({S.tokens('question', 'e')}) AS token FROM (SELECT question_id, question, {S.expansions('question')} AS e FROM oq)) GROUP BY question_id, token),
hit AS (SELECT question_id, doc_id, token, qtf, tf, dl FROM postings JOIN asked USING (token) JOIN placed USING (question_id, doc_id)),
dfs AS (SELECT question_id, token, count(*) AS df FROM hit GROUP BY question_id, token),
b0 AS (SELECT question_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN 1 ELSE dl END) / greatest(avgdl, 1.0)))), 9) AS score
       FROM hit JOIN dfs USING (question_id, token) JOIN st USING (question_id) GROUP BY question_id, doc_id),
lex AS (SELECT question_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS n FROM b0 WHERE score > 0) JOIN lim USING (question_id) WHERE n <= k),
v0 AS (
  SELECT os.question_id, os.doc_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
  FROM os JOIN embeddings v ON v.vec_id = os.doc_id JOIN embeddings a ON a.vec_id = os.question_id % 400),
sem AS (SELECT question_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS n FROM v0 WHERE score > 0) JOIN lim USING (question_id) WHERE n <= k),
ln_ AS (SELECT question_id, doc_id, round(score / max(score) OVER (PARTITION BY question_id), 9) AS bm25 FROM lex),
sn_ AS (SELECT question_id, doc_id, round(score / max(score) OVER (PARTITION BY question_id), 9) AS vector FROM sem),
fu AS (SELECT question_id, doc_id, round(0.55 * coalesce(bm25, 0) + 0.45 * coalesce(vector, 0), 9) AS score FROM ln_ FULL JOIN sn_ USING (question_id, doc_id)),
wt AS (SELECT d.*, {scoring.WEIGHTED} AS weighted FROM d),
adj AS ({scoring.adjust_sql('oq', 'wt')}),
pref AS ({scoring.preference_sql('oq')}),
tot AS (SELECT question_id, doc_id, round(score + adjustment, 9) AS score FROM fu JOIN adj USING (question_id, doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS first_rank FROM tot WHERE score > 0),
lifted AS (SELECT question_id, doc_id, first_rank, round(CASE WHEN task_type = 'qa_fact' THEN score ELSE score + preference END, 9) AS score FROM best JOIN oq USING (question_id) JOIN pref USING (question_id, doc_id) WHERE first_rank <= {TOP_K}),
res AS (
  SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_rank) AS rank, score FROM lifted
  UNION ALL SELECT question_id, doc_id, rank, score FROM ex)
SELECT question_id, CAST(rank AS INT) AS rank, doc_id, round(CAST(score AS DOUBLE), 4) AS score FROM res"""

QUERIES = {f.__name__: f for f in (scope_cascade, exact_symbol_lookup, answers)}
ORACLE_SQL = {"scope_cascade": SCOPE_CASCADE, "exact_symbol_lookup": EXACT_SYMBOLS, "answers": ANSWERS}
