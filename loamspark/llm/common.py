"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in a local session without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loamspark-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = checkpoint_folder(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly the two columns an operator needs, so that clashing extras cannot matter."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Characters that a Python worker holds as texts at a time, one text at least.
CHUNK_CHARS = 4_000_000


def text_runs(texts: pa.Array, chunk_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch as lists of at most ``chunk_chars`` characters (one text at least), each with its first position."""
    lengths = [0 if v is None else v for v in pc.utf8_length(texts).to_pylist()]
    start = 0
    while start < len(lengths):
        stop, chars = start, 0
        while stop < len(lengths) and (stop == start or chars + lengths[stop] <= chunk_chars):
            chars += lengths[stop]
            stop += 1
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    schema: T.StructType,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """doc_id plus what ``make()(texts)`` returns, Arrow batch by Arrow batch.

    ``make`` is called once per task and returns the function to apply. Texts are handed
    over in runs of at most ``chunk_chars`` characters (one text at least), which bounds
    the memory of a worker whatever the batch size.
    """
    narrow = keyed_text(df, id_col, text_col)
    id_type = narrow.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        apply = make()
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        names = ["doc_id", *[f.name for f in schema.fields]]
        for batch in batches:
            for start, texts in text_runs(batch.column(1), chunk_chars):
                got = apply(texts)
                arrays = [pa.array(got[f.name], type=t) for f, t in zip(schema.fields, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *arrays], names=names)

    return narrow.mapInArrow(run, out)


def filter_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str | None]], list[bool]]],
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``df`` with all their columns for which the function says True; memory is bounded as in ``map_texts``."""
    position = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for start, texts in text_runs(batch.column(position)):
                yield batch.slice(start, len(texts)).filter(pa.array(keep(texts), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def spread_join(rows: DataFrame, known: DataFrame, key: str, by: str, parts: int = 64) -> DataFrame:
    """``rows`` with the one row of ``known`` for their ``key``; rows without one go.

    The rows of one key are dealt to ``parts`` tasks by a hash of ``by``: each (key, deal)
    looks its row up once, so neither side has more than ``parts`` rows of a key in a task
    that also holds the rows.
    """
    deal = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    dealt = rows.withColumn("deal_", deal)
    looked = dealt.select(key, "deal_").distinct().join(known, key)
    return dealt.join(looked, [key, "deal_"]).drop("deal_")


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as text, null as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
