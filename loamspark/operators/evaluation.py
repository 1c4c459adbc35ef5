"""Retrieval metrics and the corpus quality report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.functions import pdf_rules as rules
from loamspark.functions.quality import (
    cells,
    has_two_chapters,
    is_bad_start,
    is_bad_table,
    is_packed,
    is_section_title,
    is_separator_row,
    pipes,
    section_issue,
    table_confidence,
)
from loamspark.functions.text import STRINGS, compact, folded, let, one_line


def judged(results: DataFrame, expected: DataFrame, top: int = 5, named: Callable[[Column], Column] = folded, said: Callable[[Column], Column] = folded) -> DataFrame:
    """Per question: hits at 1, 3 and 5, reciprocal rank, share of terms found.

    results: question_id, rank, document_title, content; expected: question_id,
    expected_documents, expected_terms. Questions without results count as misses.
    ``named`` folds titles and terms before they are compared, ``said`` the joined contents.
    """
    wanted = expected.select("question_id", F.transform("expected_documents", named).alias("titles"), F.coalesce("expected_terms", F.array().cast(STRINGS)).alias("terms"))
    joined = wanted.join(results, "question_id", "left")
    hit = F.array_contains("titles", named(F.col("document_title")))
    row = F.when((F.col("rank") <= top) & F.col("content").isNotNull(), F.struct("rank", "content"))
    per = joined.groupBy("question_id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.first("terms").alias("terms"),
        F.array_sort(F.collect_list(row)).alias("rows"),
    )
    text = said(F.array_join(F.transform("rows", lambda r: r["content"]), "\n"))
    found = F.size(F.filter("terms", lambda t: F.contains(text, named(t))))
    at = lambda k: F.coalesce(F.col("first_hit") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return per.select(
        "question_id", at(1), at(3), at(5), F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.try_divide(found, F.size("terms")), F.lit(0.0)).alias("term_coverage")
    )


def summary(per_question: DataFrame) -> DataFrame:
    """Means over all questions; zero on none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_question.agg(
        F.count("*").alias("questions"),
        *[mean(F.col(f"hit_at_{k}").cast("double")).alias(f"hit_at_{k}") for k in (1, 3, 5)],
        mean(F.col("reciprocal_rank")).alias("mrr"),
        mean(F.col("term_coverage")).alias("term_coverage_at_5"),
    )


def corpus_report(chunks: DataFrame) -> DataFrame:
    """One row of counts, lengths and rates over all chunks."""
    n = F.length(F.coalesce("content", F.lit("")))
    start = (F.col("block_type") == "text") & is_bad_start(F.col("content"))
    kinds = [F.count_if(F.col("block_type") == k).alias(f"{k}_chunks") for k in ("text", "table", "toc", "code", "formula")]
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.median(n), F.lit(0.0)).alias("median_length"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_length"),
        F.count_if(n < 50).alias("very_short"),
        F.count_if(n < 100).alias("short"),
        F.count_if(n > 2000).alias("long"),
        F.count_if(start).alias("bad_start"),
        *kinds,
    ).withColumn("bad_start_rate", F.coalesce(F.try_divide(F.col("bad_start"), F.col("chunks")), F.lit(0.0)))


def document_report(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per document: chunks, median length, short ones, and counts by kind as a map. Documents without chunks stay if given."""
    n = F.length(F.coalesce("content", F.lit("")))
    kinds = chunks.groupBy("document_id", "block_type").agg(F.count("*").alias("k"))
    maps = kinds.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "k")))).alias("block_types"))
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.median(n).alias("median_length"), F.count_if(n < 100).alias("short")).join(maps, "document_id")
    if documents is None:
        return per
    return documents.select(F.col("id").alias("document_id")).join(per, "document_id", "left").na.fill(0, ["chunks", "short"])


def section_issues(chunks: DataFrame) -> DataFrame:
    """issue, parts, chunks: defects of section paths."""
    parts = chunks.select("id", F.explode("section_path").alias("part")).withColumn("issue", section_issue(F.col("part"))).where("issue is not null")
    return parts.groupBy("issue").agg(F.count("*").alias("parts"), F.count_distinct("id").alias("chunks"))


def table_issues(chunks: DataFrame) -> DataFrame:
    """issue, chunks: defects of tables, and their confidences as issues of the form confidence:x."""
    text = F.col("content")
    rows = F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda r: F.contains(r, F.lit("|")) & ~is_separator_row(r))
    named = F.array(
        F.when(is_bad_table(text), "bad_table_filter_match"),
        F.when(F.size(F.array_distinct(F.transform(rows, pipes))) > 2, "inconsistent_column_count"),
        F.when(F.exists(cells(rows), is_packed), "packed_multi_value_cells"),
        F.concat(F.lit("confidence:"), F.coalesce("table_parse_confidence", table_confidence(text))),
    )
    found = chunks.where("block_type = 'table'").select(F.explode(F.filter(named, lambda x: x.isNotNull())).alias("issue"))
    return found.groupBy("issue").agg(F.count("*").alias("chunks"))


def code_issues(chunks: DataFrame) -> DataFrame:
    """One row: code chunks of a single line, short ones, and ones without text beside them."""
    around = W.partitionBy("document_id").orderBy("chunk_index")
    apart = []
    for move, step in ((F.lag, -1), (F.lead, 1)):
        near = move("chunk_index").over(around) == F.col("chunk_index") + step
        apart.append(~F.coalesce(near, F.lit(False)) | (move("block_type").over(around) == "code"))
    rows = chunks.withColumn("alone", reduce(lambda a, b: a & b, apart)).where("block_type = 'code'")
    lines = F.size(F.filter(F.split("content", r"\r\n|[\n\r]", -1), lambda x: F.trim(x) != ""))
    return rows.agg(F.count_if(lines == 1).alias("single_line"), F.count_if(F.length("content") < 100).alias("short"), F.count_if(F.coalesce("alone", F.lit(False))).alias("without_text_beside"))


def first_examples(issues: DataFrame, limit: int = 12, key: str = "issue", order: str = "seq") -> DataFrame:
    """The first rows of each key; the report's examples, so the limit is the feature."""
    return issues.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("n") <= limit)


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """id, document_id, chunk_index, issue, detail: every defect of every chunk that the report names."""
    text, path = F.col("content"), F.coalesce("section_path", F.array().cast(STRINGS))
    plain = F.col("block_type") == "text"
    flags = F.array(
        F.when(F.length(text) < 100, F.struct(F.lit("short_chunks_lt_100").alias("issue"), F.concat(F.lit("len="), F.length(text)).alias("detail"))),
        F.when(plain & rules.is_formula(text), F.struct(F.lit("formula_leakage_in_text").alias("issue"), one_line(text).alias("detail"))),
        F.when(plain & is_bad_start(text), F.struct(F.lit("bad_start_chunks").alias("issue"), F.lit("starts like a continuation").alias("detail"))),
        F.when(has_two_chapters(path), F.struct(F.lit("section_path:chapter_transition_error").alias("issue"), F.array_join(path, " > ").alias("detail"))),
    )
    paths = F.transform(F.filter(path, lambda p: section_issue(p).isNotNull()), lambda p: F.struct(F.concat(F.lit("section_path:"), section_issue(p)).alias("issue"), p.alias("detail")))
    found = F.concat(F.filter(flags, lambda x: x.isNotNull()), paths)
    return chunks.select("id", "document_id", "chunk_index", F.explode(found).alias("x")).select("id", "document_id", "chunk_index", "x.issue", "x.detail")


#: Fixed value: from here on a line is nearly a heading.
LEAST_CANDIDATE = 0.35


def heading_candidate(text: Column, path: Column) -> Column:
    """A line among the first three that is nearly a heading and not in the path."""

    known = F.array_join(F.coalesce(path, F.array().cast(STRINGS)), "\n")
    lines = F.filter(F.transform(F.slice(rules.split_lines(text), 1, 3), compact), lambda x: x != "")
    score = lambda x: rules.heading_score(rules.heading_title(x))
    nearly = F.filter(lines, lambda x: ~F.contains(known, x) & let(score(x), lambda n: (n >= LEAST_CANDIDATE) & (n < rules.HEADING_SCORE)))
    return let(F.get(nearly, 0), lambda x: F.when(is_section_title(x), x))


def formula_scores(texts: DataFrame, text_col: str) -> DataFrame:
    return texts.withColumn("formula_score", rules.formula_score(F.coalesce(text_col, F.lit(""))))


def write_report(path: str, **frames: DataFrame) -> None:
    """Each part of a report as JSON lines in a folder of its own."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def report_markdown(rows: dict[str, list[dict]]) -> str:
    """A report's small parts as Markdown tables."""
    parts = []
    for name, items in rows.items():
        parts.append(f"## {name}\n")
        if items:
            heads = list(items[0])
            parts += ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads)]
            parts += ["| " + " | ".join(str(i.get(h, "")) for h in heads) + " |" for i in items]
        parts.append("")
    return "\n".join(parts)
