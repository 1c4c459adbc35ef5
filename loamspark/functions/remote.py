"""Connectors of remote models: bounded requests out of Arrow batches, retried, answers put back in order.

A call is a function that workers can load: it takes a list of inputs and returns (index,
answer) pairs in any order, as services do. Nothing goes through the driver; a request that
fails in every attempt fails its task, which Spark tries elsewhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loamspark.functions.text import remote_input

#: Inputs of a request; some services take fewer.
MOST_INPUTS, FEW_INPUTS = 64, 10


@dataclass(frozen=True)
class Remote:
    """A service: ``call`` of at most ``inputs`` at a time, tried ``attempts`` times with growing pauses."""

    call: Callable[[list], Iterable[tuple[int, object]]]
    inputs: int = MOST_INPUTS
    attempts: int = 3
    pause_s: float = 0.5

    def answers(self, inputs: list) -> list:
        """One answer for each input, in its order."""
        out = []
        for start in range(0, len(inputs), self.inputs):
            out += self._request(inputs[start : start + self.inputs])
        return out

    def _request(self, inputs: list) -> list:
        for attempt in range(self.attempts):
            try:
                found = dict(self.call(inputs))
                if sorted(found) != list(range(len(inputs))):
                    raise ValueError(f"answers to {sorted(found)} of {len(inputs)} inputs")
                return [found[i] for i in range(len(inputs))]
            except Exception:  # noqa: BLE001  whatever a service's client raises
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause_s * 2**attempt)
        return []


def with_answers(rows: DataFrame, inputs: Column, remote: Remote, name: str, kind: T.DataType) -> DataFrame:
    """``rows`` with the answers to a column of inputs; texts, or structs that arrive as dictionaries."""
    kept = rows.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, remote.inputs):  # an answer is passed on as soon as it is there
                part = batch.slice(start, remote.inputs)
                found = remote.answers(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, to_arrow_type(kind))], names=schema.names)

    return kept.withColumn("__input", inputs).mapInArrow(run, schema)


def embedding_provider(remote: Remote) -> Callable[[DataFrame, Column, int], DataFrame]:
    """A provider for ``embed.PROVIDERS``; vectors of another length than asked for are an error."""

    def provide(rows: DataFrame, text: Column, dimension: int, name: str = "values") -> DataFrame:
        made = with_answers(rows, remote_input(text), remote, name, T.ArrayType(T.DoubleType()))
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dimension} values but "), F.size(name).cast("string")))
        return made.withColumn(name, F.when(F.size(name) == dimension, F.col(name)).otherwise(wrong.cast("array<double>")))

    return provide
