"""From questions to citations and prompts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.functions.embed import with_hash_provider
from loamspark.functions.text import TERM_GROUPS, dot, lowered, nfkc, snippet, strip, weighted_text
from loamspark.operators import counted, ranking
from loamspark.operators.intent import analyzed
from loamspark.operators.postings import BlockIndex, pruned_topk
from loamspark.operators.ranking import CODE_TYPES
from loamspark.operators.scoping import Scope, Symbols, is_code_chunk, named_documents, question_scope
from loamspark.session import materialized, sent_whole

CITATION = (
    "document_id", "document_title", "chunk_index", "block_id", "block_type", "symbol_name", "doc_type", "chip_family", "section_path",
    "page_number", "page_label", "line_start", "line_end", "paragraph_start", "paragraph_end", "source_uri", "location_label",
    "context_before", "context_after", "parent_block_id", "order_on_page", "page_region", "role_confidence", "extraction_confidence",
    "table_parse_confidence",
)
#: Instructions of the answer, by task, and the parts of a prompt.
NO_CONTEXT = "没有检索到相关资料。"
PROMPT_HEAD, PROMPT_CONTEXT, PROMPT_QUESTION = "请基于下面检索到的资料回答问题。\n\n", "资料：\n", "\n\n问题："


@dataclass(frozen=True)
class Settings:
    """Defaults of a search."""

    top_k: int = 5
    candidate_limit: int = 40
    dimension: int = 384
    collection_id: str = "default"
    provider: str = "hash"
    model: str = "hash"
    bm25_weight: float = 0.55
    vector_weight: float = 0.45
    history_window: int = 4
    stats: str = "scoped"


def task_preference(plan: Column, c=F.col) -> Column:
    """What a task adds to a chunk's score."""
    add = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))
    depth = F.size(F.coalesce(c("section_path"), F.array().cast("array<string>")))
    table, toc = c("block_type") == "table", c("block_type") == "toc"
    some = lambda name: F.coalesce(c(name), F.lit("")) != ""
    return (
        F.when(~plan["prefer_tables"], F.lit(0.0)).when(table, F.lit(0.35)).otherwise(add(c("table_parse_confidence") == "low", -0.05))
        + F.when(~plan["prefer_toc"], F.lit(0.0)).when(toc, F.lit(0.40)).otherwise(add((depth > 0) & (depth <= 2), 0.08))
        + add(plan["prefer_code"] & is_code_chunk(c), 0.25)
        + add(plan["require_page_numbers"] & c("page_number").isNotNull(), 0.08)
        + add(plan["require_locations"] & (some("location_label") | (depth > 0) | some("source_uri")), 0.06)
    )


def query_text(question: Column, recent: Column) -> Column:
    """Recent user turns and the question, blanks dropped, a line each."""
    parts = F.concat(F.coalesce(recent, F.array().cast("array<string>")), F.array(question))
    return F.array_join(F.filter(parts, lambda p: strip(p) != ""), "\n")


def expanded_content(results: DataFrame, chunks: DataFrame, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(question_id, id, expanded): results (question_id, id), code with its neighbours of the same kind that the question searches too.

    Neighbours are looked up by document and index for the results alone.
    """
    kinds = chunks.select("id", "document_id", "chunk_index", "block_type", "doc_type", strip(F.col("content")).alias("content"))
    rows = results.select("question_id", "id").join(kinds, "id")
    alone = ~F.coalesce(F.col("doc_type").isin(*CODE_TYPES), F.lit(False)) & ~F.coalesce(F.col("block_type") == "code", F.lit(False))
    wanted = rows.where(~alone & (F.col("content") != "")).select("question_id", F.col("id").alias("of"), "document_id", "block_type", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"), "chunk_index")
    beside = wanted.withColumn("chunk_index", (F.col("chunk_index") + F.col("step")).cast(chunks.schema["chunk_index"].dataType)).join(
        kinds.select("document_id", "chunk_index", "block_type", F.col("id").alias("chunk_id"), F.col("content").alias("text")), ["document_id", "chunk_index", "block_type"]
    )
    side = lambda step: F.first(F.when(F.col("step") == step, F.nullif(F.col("text"), F.lit(""))), ignorenulls=True)
    sides = within(beside.select("question_id", "chunk_id", "of", "step", "text")).groupBy("question_id", "of").agg(side(-1).alias("before"), side(1).alias("after")).withColumnRenamed("of", "id")
    merged = F.concat_ws("\n\n", "before", F.nullif(F.col("content"), F.lit("")), "after")
    return rows.join(sides, ["question_id", "id"], "left").select("question_id", "id", F.when(alone | (F.col("content") == ""), F.col("content")).otherwise(merged).alias("expanded"))


def scoped_statistics(asked: DataFrame, index: BlockIndex, scope: Scope) -> DataFrame:
    """``asked`` (question_id, token, qtf) with df, n and avgdl of the chunks that each question searches."""
    sizes = scope.sums({"n": F.lit(1), "total": F.col("dl")}, index.lengths.withColumnRenamed("chunk_id", "id"))
    tokens = asked.select("token").distinct()
    posted = index.blocks.join(tokens, "token", "left_semi").select("token", F.explode("entries.chunk_id").alias("id"))
    by_profile = posted.join(scope.chunks, "id").groupBy("token", "profile").agg(F.count("*").alias("df"))
    whole = by_profile.join(scope.allowed, "profile").join(asked.select("question_id", "token"), ["question_id", "token"]).select("question_id", "token", "df")
    single = posted.join(scope.listed, "id").join(asked.select("question_id", "token"), ["question_id", "token"]).groupBy("question_id", "token").agg(F.count("*").alias("df"))
    df = whole.unionByName(single).groupBy("question_id", "token").agg(F.sum("df").alias("df"))
    return asked.join(df, ["question_id", "token"]).join(sizes, "question_id").select("question_id", "token", "qtf", "df", "n", (F.col("total") / F.col("n")).alias("avgdl"))


def candidates(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None, scope: Scope, settings: Settings = Settings(), index: BlockIndex | None = None, latin: Column | None = None
) -> DataFrame:
    """(question_id, chunk_id, bm25, vector, score): both legs over-fetched, normalised, fused and adjusted.

    Questions with a column ``vector`` bring their own; else they are embedded as the hash
    provider does. Without an ``index``, texts are scored in the tasks that read them: weighted
    texts, or the Latin tokens of ``latin``.
    """
    asked = materialized(ranking.question_tokens(questions.select("question_id", F.col("query").alias("question"))))
    limit = F.greatest(8 * F.greatest(F.lit(settings.candidate_limit), F.lit(settings.top_k), F.col("plan.candidate_limit")), F.lit(30))
    limits = questions.select("question_id", limit.alias("limit"))
    scoped = settings.stats == "scoped"
    if index is None:
        text, groups = (nfkc(weighted_text()), TERM_GROUPS) if latin is None else (latin, ())
        best = counted.scoped_search(asked, limits, chunks, "id", text, scope, groups, scoped)
    else:
        index = index.narrowed(asked)
        known = scoped_statistics(asked, index, scope) if scoped else index.statistics(asked)
        best = pruned_topk(known.join(limits, "question_id"), index, F.col("limit"), scope.within)
    lexical = best.select("question_id", "chunk_id", "score")
    if vectors is None:
        semantic = lexical.limit(0)
    else:
        chosen = ranking.select_vectors(vectors, settings.provider, settings.model, settings.dimension, settings.collection_id)
        own = "vector" in questions.columns
        embedded = questions.select("question_id", "vector") if own else with_hash_provider(questions.select("question_id", "query"), F.col("query"), settings.dimension, "vector").drop("query")
        semantic = vector_leg(embedded, chosen, scope, limits)
    fused = materialized(ranking.fuse(lexical, semantic, settings.bm25_weight, settings.vector_weight))
    # What the rules look for is found once for each candidate chunk, and once for each question.
    once = chunks.join(fused.select(F.col("chunk_id").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "chunk_id")
    once = once.withColumns({"__text": lowered(weighted_text(), True), "__title": lowered(F.coalesce("document_title", F.lit("")), True)})
    said = materialized(once.select(*[c for c in once.columns if c not in ("content", "context_before", "context_after")], ranking.sought("text", F.col("__text")).alias("__said"), ranking.sought("title", F.col("__title")).alias("__titled")))
    folded = questions.select("question_id", "question", "intent").withColumn("__low", lowered(F.col("question"), True))
    asking = materialized(folded.withColumn("__asked", ranking.sought("asked", F.col("question"), F.col("__low"))))
    full = fused.join(said, "chunk_id").join(sent_whole(asking)(asking), "question_id")
    heuristic = ranking.adjustment(F.col("intent"), F.col("__asked"), F.col("__text"), F.col("__said"), F.col("__titled"))
    total = F.round(F.col("score") + heuristic, ranking.DIGITS)
    return full.select("question_id", "chunk_id", "bm25", "vector", total.alias("score")).where("score > 0")


def vector_leg(embedded: DataFrame, vectors: DataFrame, scope: Scope, limits: DataFrame) -> DataFrame:
    """The best dot products above zero of each question among the chunks it searches.

    Questions that search whole profiles are matched block-wise, each profile's vectors with
    its own questions' matrix; those with a list of chunks by a join.
    """
    most = limits.agg(F.max("limit")).first()[0] or 1
    placed = vectors.select("chunk_id", "values").join(scope.chunks.select(F.col("id").alias("chunk_id"), "profile"), "chunk_id")
    whole = ranking.vector_topk(embedded.join(scope.allowed.select("question_id").distinct(), "question_id", "left_semi"), placed, most, allowed=scope.allowed)
    reach = vectors.select("chunk_id", "values").join(scope.listed.withColumnRenamed("id", "chunk_id"), "chunk_id").join(embedded, "question_id")
    single = reach.select("question_id", "chunk_id", F.round(dot(F.col("values"), F.col("vector")), ranking.DIGITS).alias("score")).where("score > 0")
    return ranking.top_k(whole.unionByName(single).join(limits, "question_id"), F.col("limit")).select("question_id", "chunk_id", "score")


def answerable(
    questions: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, settings: Settings = Settings(),
    index: BlockIndex | None = None, symbols: Symbols | None = None, latin: Column | None = None,
) -> DataFrame:
    """Citations of each question (question_id, question, optional ``recent`` user turns and ``vector``): rank, columns of CITATION, snippet, content, score.

    Scope, both legs, fusion and heuristics, the cut to top_k, task rescoring of what is
    left, and neighbour expansion; questions that name a symbol of the scoped code get the
    chunks of that symbol instead. ``index`` and ``symbols`` are made at ingestion; without an
    index texts are searched as they are read, ``latin`` or the weighted ones.
    """
    recent = F.col("recent") if "recent" in questions.columns else F.lit(None).cast("array<string>")
    own = [c for c in ("vector",) if c in questions.columns]
    # Read many times below; without a cut every join would plan it anew.
    asked = materialized(analyzed(questions.select("question_id", "question", query_text(F.col("question"), recent).alias("query"), *own), settings.top_k))
    scope = question_scope(asked, chunks, named_documents(asked, documents), symbols)
    exact = exact_symbols(scope, chunks, settings.top_k)

    answered = exact.select("question_id").distinct()
    open_questions = materialized(asked.join(answered, "question_id", "left_anti"))
    found = materialized(candidates(open_questions, chunks, vectors, scope.without(answered), settings, index, latin))
    best = ranking.top_k(found, settings.top_k).select("question_id", "chunk_id", "rank", "score")
    full = best.join(chunks, best["chunk_id"] == chunks["id"]).join(asked.select("question_id", "plan"), "question_id")
    lifted = F.when(F.col("plan.task_type") == "qa_fact", F.col("score")).otherwise(F.col("score") + task_preference(F.col("plan")))
    again = W.partitionBy("question_id").orderBy(F.desc("lifted"), "rank")
    ranked = full.select("question_id", "chunk_id", "rank", F.round(lifted, ranking.DIGITS).alias("lifted")).withColumn("new_rank", F.row_number().over(again))
    ranked = ranked.select("question_id", "chunk_id", F.col("new_rank").alias("rank"), F.col("lifted").alias("score"))

    results = materialized(exact.unionByName(ranked))
    expanded = expanded_content(results.withColumnRenamed("chunk_id", "id"), chunks, scope.within).withColumnRenamed("id", "chunk_id")
    return (
        results.join(expanded, ["question_id", "chunk_id"])
        .join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")
        .select("question_id", "rank", "chunk_id", *CITATION, snippet(F.col("content")).alias("snippet"), F.col("expanded").alias("content"), F.round("score", 4).alias("score"))
    )


def exact_symbols(scope: Scope, chunks: DataFrame, k: int) -> DataFrame:
    """(question_id, chunk_id, rank, score): the chunks that define a symbol the question names, in order of title, symbol and place."""
    keys = chunks.select(F.col("id").alias("chunk_id"), "document_title", "symbol_name", "chunk_index")
    order = W.partitionBy("question_id").orderBy("document_title", "symbol_name", "chunk_index", "chunk_id")
    named = scope.exact.withColumnRenamed("id", "chunk_id").join(keys, "chunk_id")
    cut = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cut.select("question_id", "chunk_id", "rank", (1.0 - F.col("rank") * 0.01).alias("score"))


def prompt(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, prompt): numbered context in order of rank, then the question."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    path = F.nullif(F.array_join("section_path", " > "), F.lit(""))
    label = F.when(F.col("location_label").eqNullSafe(path) | F.col("location_label").eqNullSafe(F.col("page_label")), None).otherwise(blank("location_label"))
    where = F.concat_ws(" | ", path, blank("page_label"), label, blank("source_uri"))
    where = F.when(where == "", F.concat(F.lit("片段 "), F.col("chunk_index"))).otherwise(where)
    text = F.concat(F.lit("["), F.col("document_title"), F.lit(" | "), where, F.lit("]\n"), F.coalesce(blank("content"), F.col("snippet")))
    blocks = citations.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("blocks"))
    context = F.coalesce(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), F.lit(NO_CONTEXT))
    joined = questions.select("question_id", "question").join(blocks, "question_id", "left")
    return joined.select("question_id", F.concat(F.lit(PROMPT_HEAD), F.lit(PROMPT_CONTEXT), context, F.lit(PROMPT_QUESTION), "question").alias("prompt"))


def rerank(candidates_: DataFrame, k: int, reranker=None) -> DataFrame:
    """The reranker's order cut to k; without one, or if it fails at run time, the order of the input.

    Its answer is computed here, as a failing service would not show in a plan; errors in
    building the plan are the caller's and are raised.
    """
    if reranker is not None:
        answer = ranking.top_k(reranker(candidates_), k)
        try:
            return materialized(answer)
        except (PySparkException, Py4JJavaError) as e:
            logging.getLogger(__name__).warning("reranker failed, order kept: %s", str(e)[:200])
    return ranking.top_k(candidates_, k)


def rerank_by_positions(candidates_: DataFrame, response: DataFrame, k: int) -> DataFrame:
    """A service's answer (question_id, index, score) joined to the candidates by position; others are dropped."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    placed = candidates_.withColumn("index", F.row_number().over(order) - 1).drop("score")
    return ranking.top_k(placed.join(response, ["question_id", "index"]), k)


def remote_documents() -> Column:
    """What a remote reranker reads of a candidate: its weighted text, cut."""
    return F.substring(weighted_text(), 1, 6000)


def folded_terms(terms: Column) -> Column:
    return F.transform(terms, lowered)
