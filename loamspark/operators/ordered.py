"""Small machines over rows in order, one document at a time, many documents a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamspark.schemas import struct

#: Rows of an Arrow batch that goes back to Spark, and rows that are Python values at a time.
BATCH_ROWS, READ_ROWS = 2048, 256


def records(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches as dicts, a bounded number at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, READ_ROWS):
            yield from batch.slice(start, READ_ROWS).to_pylist()


def batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def per_document(rows: DataFrame, machine: Callable[[list[dict]], list[dict]], schema: str | T.StructType, *order: str) -> DataFrame:
    """``machine`` over each document's rows in order, as a list of dicts each.

    Rows are dealt by document and sorted, and documents follow each other in a task's
    batches: a frame for each document would cost more than most documents' work.
    """
    out = struct(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = groupby(records(batches), key=lambda r: r["document_id"])
        return batched((made for _, group in documents for made in machine(list(group))), arrow)

    return rows.repartition("document_id").sortWithinPartitions("document_id", *order).mapInArrow(run, out)


def per_row(rows: DataFrame, machine: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """``machine`` over each row, which makes any number of rows of it."""
    arrow = to_arrow_schema(struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((made for row in records(batches) for made in machine(row)), arrow)

    return rows.mapInArrow(run, struct(schema))
