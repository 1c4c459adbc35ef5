"""Retrieval: inverted index, BM25, exact vector search, fusion, task rescoring.

Everything is set-oriented over many questions; ``question_id`` is a key throughout and
nothing is collected but a bounded block of query vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loamspark.functions.text import LATIN_TOKEN, contains_any, lowered, weighted_text, with_tokens
from loamspark.session import materialized, sent_whole

K1, B = 1.5, 0.75
#: Scores are rounded so that equal texts tie whatever the order in which parts are summed.
DIGITS = 9
BM25_WEIGHT, VECTOR_WEIGHT = 0.55, 0.45


@dataclass(frozen=True)
class InvertedIndex:
    """postings(token, chunk_id, tf), lengths(chunk_id, dl)."""

    postings: DataFrame
    lengths: DataFrame

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Postings dealt and sorted by token, so that a scan prunes row groups."""
        self.postings.repartitionByRange("token").sortWithinPartitions("token", "chunk_id").write.mode(mode).parquet(f"{path}/postings")
        self.lengths.write.mode(mode).parquet(f"{path}/lengths")

    @staticmethod
    def read(spark, path: str) -> InvertedIndex:
        return InvertedIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def build_index(chunks: DataFrame, id_col: str = "id", tokens: Column | None = None) -> InvertedIndex:
    """Term frequencies and lengths; repeated tokens count. Without ``tokens``, those of the weighted text, folded."""
    if tokens is None:
        texts = chunks.select(F.col(id_col).alias("chunk_id"), weighted_text().alias("text"))
        per = with_tokens(texts, F.col("text")).select("chunk_id", "tokens")
    else:
        per = chunks.select(F.col(id_col).alias("chunk_id"), tokens.alias("tokens"))
    postings = per.select("chunk_id", F.explode("tokens").alias("token")).groupBy("token", "chunk_id").agg(F.count("*").alias("tf"))
    return InvertedIndex(postings, per.select("chunk_id", F.size("tokens").cast("long").alias("dl")))


def build_latin_index(chunks: DataFrame, id_col: str, text: Column) -> InvertedIndex:
    """``build_index`` of the Latin tokens of a text, counted in the task that reads it.

    Lengths count matches and hold no tokens.
    """
    from loamspark.operators.counted import postings

    lengths = chunks.select(F.col(id_col).alias("chunk_id"), (2 * F.regexp_count(lowered(text), F.lit(LATIN_TOKEN))).cast("long").alias("dl"))
    return InvertedIndex(postings(chunks, id_col, text), lengths)


def narrowed(index: InvertedIndex, asked: DataFrame) -> InvertedIndex:
    """The index with the postings of asked tokens only, both tables computed once and kept in the checkpoint folder."""
    tokens = materialized(asked.select("token").distinct())
    found = index.postings.join(sent_whole(tokens)(tokens), "token", "left_semi")
    return InvertedIndex(materialized(found), materialized(index.lengths))


def document_frequency(index: InvertedIndex) -> DataFrame:
    return index.postings.groupBy("token").agg(F.count("*").alias("df"))


def corpus_statistics(index: InvertedIndex) -> DataFrame:
    return index.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def question_tokens(questions: DataFrame, tokens: Column | None = None) -> DataFrame:
    """question_id, token, qtf: multiplicity counts. Without ``tokens``, those of the question, folded."""
    if tokens is None:
        questions, tokens = with_tokens(questions.select("question_id", "question"), F.col("question")), F.col("tokens")
    return questions.select("question_id", F.explode(tokens).alias("token")).groupBy("question_id", "token").agg(F.count("*").alias("qtf"))


def term_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    length = F.when(dl == 0, F.lit(1)).otherwise(dl)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(avgdl, F.lit(1.0))))


def bm25(asked: DataFrame, index: InvertedIndex, scope: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, score > 0, for question tokens (question_id, token, qtf).

    With ``scope`` (question_id, chunk_id) frequencies and lengths are those of the scoped
    chunks of each question; without, those of the whole index. Only postings of asked
    tokens move: the asked side is small and joins first.
    """
    if scope is None:
        df = document_frequency(index).join(asked.select("token").distinct(), "token", "left_semi")
        hits = index.postings.join(asked, "token").join(df, "token").join(index.lengths, "chunk_id").crossJoin(F.broadcast(corpus_statistics(index)))
    else:
        placed = scope.join(index.lengths, "chunk_id")
        stats = placed.groupBy("question_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        found = index.postings.join(asked, "token").join(placed, ["question_id", "chunk_id"])
        df = found.groupBy("question_id", "token").agg(F.count("*").alias("df"))
        hits = found.join(df, ["question_id", "token"]).join(stats, "question_id")
    weight = F.col("qtf") * term_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return hits.groupBy("question_id", "chunk_id").agg(F.round(F.sum(weight), DIGITS).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int | Column, tie: str = "chunk_id") -> DataFrame:
    """The k best of each question, ties by ``tie``, with their rank. Cut before the shuffle by Spark."""
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def select_vectors(
    vectors: DataFrame,
    provider: str | None = None,
    model: str | None = None,
    dimension: int | None = None,
    collection_id: str | None = None,
    active_only: bool = True,
    document_ids: list[str] | None = None,
    chunk_ids: list[str] | None = None,
) -> DataFrame:
    """Vectors of one specification; an empty list or None does not filter."""
    wanted = {"provider": provider, "model": model, "dimension": dimension, "collection_id": collection_id}
    for name, value in wanted.items():
        if value is not None:
            vectors = vectors.where(F.col(name) == value)
    if active_only:
        vectors = vectors.where("is_active")
    for name, values in (("document_id", document_ids), ("chunk_id", chunk_ids)):
        if values:
            vectors = vectors.where(F.col(name).isin(*values))
    return vectors


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "chunk_id", values: str = "values", block: int = 1024, allowed: DataFrame | None = None) -> DataFrame:
    """question_id, chunk_id, score > 0: the k largest dot products of each query (question_id, vector).

    With ``allowed`` (question_id, profile), vectors have a column ``profile`` and meet the
    queries that have theirs.

    Exact. Queries go out in blocks of a bounded number; each batch of vectors is one
    matrix product, and only its own k best of each query move on to the final cut.
    Vectors of another length score nothing, as do empty ones.
    """
    asked = queries.select("question_id", F.col("vector").cast("array<double>")).orderBy("question_id")
    total = asked.count()
    found = None
    question_type = queries.schema["question_id"].dataType
    for start in range(0, max(total, 1), block):
        rows = asked.offset(start).limit(block).collect()
        asking = {r[0] for r in rows}
        profiles: dict | None = None
        if allowed is not None:  # a block's questions times few profiles
            profiles = {}
            for q, p in allowed.where(F.col("question_id").isin(*asking)).distinct().collect() if asking else ():
                profiles.setdefault(p, set()).add(q)
        part = _block_topk(vectors, [(r[0], r[1]) for r in rows if r[1]], k, id_col, values, question_type, profiles)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k).drop("rank")


def _block_topk(vectors: DataFrame, queries: list[tuple], k: int, id_col: str, values: str, question_type: T.DataType, profiles: dict | None = None) -> DataFrame:
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("question_id", question_type), T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType())])
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(v) for _, v in queries}:
        own = [(q, v) for q, v in queries if len(v) == size]
        by_size[size] = ([q for q, _ in own], np.array([v for _, v in own], dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_type(question_type)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = np.array(pc.fill_null(pc.list_value_length(column), -1))
            for size, (names, matrix) in by_size.items():
                at = np.flatnonzero(lengths == size)
                if not len(at):
                    continue
                picked = column.take(pa.array(at))
                table = np.asarray(pc.list_flatten(picked).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), size)
                scores = np.round(table @ matrix.T, DIGITS)
                groups = [profiles.get(p, ()) for p in batch.column(2).take(pa.array(at)).to_pylist()] if profiles is not None else None
                for j, name in enumerate(names):
                    own = scores[:, j]
                    kept = np.flatnonzero(own > 0 if groups is None else (own > 0) & np.fromiter((name in g for g in groups), dtype=bool, count=len(groups)))
                    if len(kept) > k:  # all that tie with the k-th stay for the final cut
                        kept = kept[own[kept] >= np.partition(own[kept], len(kept) - k)[len(kept) - k]]
                    if len(kept):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(kept), type=out), ids.take(pa.array(at[kept])), pa.array(own[kept])], names=["question_id", "chunk_id", "score"]
                        )

    extra = ["profile"] if profiles is not None else []
    return vectors.select(id_col, F.col(values).cast("array<double>"), *extra).mapInArrow(run, schema)


def max_normalized(scored: DataFrame) -> DataFrame:
    """Scores divided by the question's largest, over this list only."""
    best = scored.groupBy("question_id").agg(F.max("score").alias("best"))
    return scored.join(best, "question_id").where("best > 0").withColumn("score", F.round(F.col("score") / F.col("best"), DIGITS)).drop("best")


def fuse(lexical: DataFrame, semantic: DataFrame, bm25_weight: float = BM25_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """question_id, chunk_id, bm25, vector, score: each leg normalised first, what one lacks is 0."""
    left = max_normalized(lexical).select("question_id", "chunk_id", F.col("score").alias("bm25"))
    right = max_normalized(semantic).select("question_id", "chunk_id", F.col("score").alias("vector"))
    both = left.join(right, ["question_id", "chunk_id"], "full_outer").na.fill(0.0, ["bm25", "vector"])
    return both.withColumn("score", F.round(bm25_weight * F.col("bm25") + vector_weight * F.col("vector"), DIGITS))


#: Rules of the heuristic adjustment (terms).
SOFTWARE_ASKED = ("主机栈", "主机堆栈", "协议栈", "host stack", "host api", "nimble", "bluedroid", "开发", "指南", "api")
SOFTWARE_TEXT = ("nimble", "bluedroid", "host", "stack", "api reference", "programming sequence")
SOFTWARE_GUIDES = ("programming guide", "编程指南", "api", "menuconfig")
BLE_ONLY = ("只支持 ble", "仅支持 ble", "纯 ble", "纯ble", "ble-only", "ble only", "only ble")
CLASSIC = ("经典蓝牙", "传统蓝牙", "br/edr", "classic bluetooth")
CONFIG_TEXT = ("sdkconfig", "menuconfig", "kconfig", "cmakelists", "idf_component_register", "component", "partition", "config")
SYMBOL_TEXT = ("app_main", "init", "start", "handler", "task", "callback", "config", "setup", "ble")
BLUETOOTH_TEXT = ("bluetooth", "ble", "nimble", "bluedroid", "gatt", "gap", "spp", "a2dp", "蓝牙", "低功耗蓝牙", "经典蓝牙")
EXAMPLE_TEXT = ("example", "examples", "示例", "教程", "gatt", "gap", "notify", "service", "characteristic", "write", "read")
EXCHANGE_TEXT = ("gatt", "gap", "notify", "indicate", "read", "write", "service", "characteristic", "blufi", "spp", "扫描", "广播", "连接")
SETUP_ASKED = ("软件组件", "开发环境", "需要哪些软件", "what you need", "prerequisites")
SETUP_TEXT = ("get started", "what you need", "toolchain", "python", "git")
FORMULA_ASKED = ("公式", "方程", "计算", "推导", "equation", "formula", "calculate", "derive")
TABLE_ASKED = ("数值", "系数", "效率", "对应", "table", "coefficient", "value", "efficiency")
CODE_TYPES = ("source_code", "build_config", "project_config", "project_doc")


ARCHITECTURE = ("概述", "overview", "架构")
#: Terms that the rules look for, by side.
SOUGHT = {
    "asked": (SOFTWARE_ASKED, BLE_ONLY, CLASSIC, SETUP_ASKED, FORMULA_ASKED, TABLE_ASKED),
    "text": (
        SOFTWARE_TEXT, SOFTWARE_GUIDES, ("技术规格书",), ("nimble",), ("bluedroid",), ("classic",), CONFIG_TEXT, BLUETOOTH_TEXT, EXAMPLE_TEXT, ("gatt",), EXCHANGE_TEXT, SETUP_TEXT, ("component requirements",),
    ),
    "title": (("datasheet",), ARCHITECTURE, SETUP_TEXT, ("build system",)),
}


def sought(side: str, *texts: Column) -> Column:
    """Which of a side's terms occur in any of its texts, found once for a question or chunk and not for each pair."""
    return F.struct(*[reduce(or_, [contains_any(t, terms) for t in texts]).alias(f"s{i}") for i, terms in enumerate(SOUGHT[side])])


def adjustment(intent: Column, asked: Column, text: Column, said: Column, titled: Column, c=F.col, unicode: bool = False) -> Column:
    """The heuristic part of a chunk's score for a question; additive rules, whose weights are fixed values.

    ``asked`` is ``sought`` in the question as it is and in lower case, ``said`` in the
    weighted text and ``titled`` in the title, both in lower case; ``text`` is that weighted
    text. They are named often, so they should be columns and not expressions.
    """
    kind, domain, block, symbol = c("doc_type"), c("content_domain"), c("block_type"), F.coalesce(c("symbol_name"), F.lit(""))
    asks = lambda terms: asked[f"s{SOUGHT['asked'].index(terms)}"]
    says = lambda terms: said[f"s{SOUGHT['text'].index(tuple(terms))}"]
    names = lambda terms: titled[f"s{SOUGHT['title'].index(tuple(terms))}"]
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    add = lambda condition, value, other=0.0: F.when(yes(condition), F.lit(value)).otherwise(F.lit(other))
    hints = intent["identifier_hints"]
    exact = F.exists(hints, lambda h: F.lower(h) == lowered(symbol, unicode))
    inside = F.exists(hints, lambda h: F.contains(text, F.lower(h)))
    paged = c("page_number").isNotNull()
    path = F.size(F.coalesce(c("section_path"), F.array().cast("array<string>"))) > 0
    rules = [
        add(asks(SOFTWARE_ASKED) & says(SOFTWARE_TEXT), 0.16),
        add(asks(SOFTWARE_ASKED) & says(SOFTWARE_GUIDES), 0.08),
        add(asks(SOFTWARE_ASKED) & (names(["datasheet"]) | says(["技术规格书"])), -0.18),
        add(asks(BLE_ONLY) & says(["nimble"]), 0.18),
        add(asks(BLE_ONLY) & says(["bluedroid"]) & says(["classic"]), -0.06),
        add(asks(CLASSIC) & says(["bluedroid"]), 0.16),
        add(asks(CLASSIC) & says(["nimble"]), -0.04),
        add(F.array_contains(intent["preferred_doc_types"], kind), 0.18),
        add(F.array_contains(intent["discouraged_doc_types"], kind), -0.18),
        F.when(~intent["prefer_code"], F.lit(0.0)).when(yes(kind.isin(*CODE_TYPES)), F.lit(0.24)).when(yes(kind.isin("guide", "api_reference")), F.lit(0.03)).otherwise(F.lit(-0.16)),
        add(intent["prefer_project"] & (domain == "project"), 0.18),
        add(~intent["prefer_code"] & (domain == "project"), -0.36),
        add(intent["prefer_build_config"] & says(CONFIG_TEXT), 0.18),
        F.when(~intent["prefer_symbol_lookup"], F.lit(0.0))
        .when(symbol != "", F.lit(0.16) + add(contains_any(lowered(symbol, unicode), SYMBOL_TEXT), 0.04))
        .otherwise(add(block == "code", 0.04)),
        add(intent["prefer_symbol_lookup"] & (kind == "project_doc"), -0.10),
        F.when(F.size(hints) == 0, F.lit(0.0)).when(exact, F.lit(0.42)).when(inside, F.lit(0.16)).otherwise(add(kind.isin("source_code", "build_config", "project_config"), -0.06)),
        F.when(~intent["prefer_bluetooth"], F.lit(0.0)).otherwise(add(says(BLUETOOTH_TEXT), 0.20, -0.46)),
        F.when(yes(F.coalesce(c("chip_family"), F.lit("")) == "") | (F.size(intent["preferred_chip_families"]) == 0), F.lit(0.0)).otherwise(
            add(F.array_contains(intent["preferred_chip_families"], c("chip_family")), 0.12, -0.06)
        ),
        add(intent["prefer_pdf"] & paged, 0.12),
        F.when(~intent["prefer_pdf"], F.lit(0.0)).when(yes(kind.isin("datasheet", "trm", "hardware_design", "schematic")), F.lit(0.14)).otherwise(
            add(kind.isin("programming_guide_home", "product_catalog", "catalog"), -0.22)
        ),
        add(intent["prefer_locations"] & (yes(F.coalesce(c("source_uri"), F.lit("")) != "") | path), 0.10),
        add(intent["prefer_locations"] & paged, 0.04),
        add(intent["prefer_examples"] & says(EXAMPLE_TEXT), 0.16),
        add(intent["prefer_examples"] & names(ARCHITECTURE) & ~says(["gatt"]), -0.08),
        F.when(~intent["prefer_interactive_comm"], F.lit(0.0)).otherwise(add(says(EXCHANGE_TEXT), 0.14, -0.16)),
        add(asks(SETUP_ASKED) & (names(SETUP_TEXT) | says(SETUP_TEXT)), 0.70),
        add(asks(SETUP_ASKED) & (names(["build system"]) | says(["component requirements"])), -0.55),
        add(asks(SETUP_ASKED) & (block == "code"), -0.25),
        add(c("is_entrypoint") & ~intent["allow_entrypoints"], -0.16),
        F.when(~yes(block == "formula"), F.lit(0.0)).otherwise(add(asks(FORMULA_ASKED), 0.08, -0.24)),
        F.when(~yes((block == "table") & (c("table_parse_confidence") == "low")), F.lit(0.0)).otherwise(add(asks(TABLE_ASKED), -0.10, -0.04)),
        F.coalesce(c("retrieval_priority"), F.lit(0)) * 0.03,
    ]
    total = F.lit(0.0)
    for rule in rules:
        total = total + rule
    return total
