"""Incremental ingestion: a stream of files or rows into the stored tables.

A stream keeps the origins (address, else path, else id) that it has seen as state, one
value each in the state store, which begins with those of the stored documents; so a
micro-batch costs what it holds, whatever is stored. Its writes carry the number of the
batch, which the manifests remember: a batch that is replayed after a failure at any point
completes what is missing and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loamspark.operators.blocks import line_blocks
from loamspark.operators.chunking import build_chunks
from loamspark.schemas import names, struct
from loamspark.session import materialized
from loamspark.sources.store import Store, origin

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TEXTS = "id string, title string, filename string, source_path string, source_url string, source_format string, text string"


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of texts as they arrive."""
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def prepared(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and blocks of rows of TEXTS."""
    documents = texts.select(
        "id", "title", "filename", "source_path", F.lit("file").alias("source_type"), "source_url", "source_format", F.lit("utf-8").alias("encoding"), F.lit(None).cast("int").alias("page_count"), F.current_timestamp().alias("created_at")
    )
    role = F.when(F.col("source_format") == "code", "code").otherwise("text")
    blocks = line_blocks(texts.select(F.col("id").alias("document_id"), "filename", F.col("filename").alias("source_uri"), role.alias("role"), "text"))
    return documents, blocks


def first_of_each(texts: DataFrame) -> DataFrame:
    """One row of each origin, that with the smallest id, so that a replay takes the same."""
    order = W.partitionBy(origin()).orderBy("id", "title", "text")
    return texts.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def ingest(store: Store, texts: DataFrame) -> int:
    """Documents of ``texts`` that are not stored yet, with chunks and vectors; how many."""
    # Checkpoints, not caches: a cache that read the stored documents is made anew, and then
    # empty, as soon as these documents are appended.
    return _added(store, materialized(store.new_only(first_of_each(texts))))


def _added(store: Store, new: DataFrame, step: tuple[str, int] | None = None) -> int:
    documents, chunks = map(materialized, build_chunks(*prepared(new)))
    n = documents.count()
    if n:
        store.add_documents(documents, chunks, step=step)
    return n


class FirstOfOrigin(StatefulProcessor):
    """Lets one row of each origin pass, of a batch that with the smallest id, and remembers the origin."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for frame in rows:
            both = frame if best is None else pd.concat([best, frame])
            best = both.sort_values(["id", "title", "text"], na_position="first", kind="stable").head(1)
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best[names(TEXTS)]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def new_origins(stream: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the stream with an origin that neither ``stored`` nor an earlier batch has; blank texts make no document and are left out."""
    known = stored.select(origin().alias("origin_")).distinct().groupBy("origin_")
    filled = stream.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("origin_", origin())
    return filled.groupBy("origin_").transformWithStateInPandas(FirstOfOrigin(), struct(TEXTS), "Append", "None", known)


def start(store: Store, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch once; the state of origins lives in the checkpoint."""
    store.spark.conf.set(STATE_STORE, ROCKS_DB)  # the only one that keeps values of this kind

    def write(batch: DataFrame, number: int) -> None:
        _added(store, materialized(batch), (checkpoint, number))

    writer = new_origins(stream, store.scan("documents")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
