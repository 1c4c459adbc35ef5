"""Session plumbing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A union of tables that were kept after adaptive planning may have sides of other sizes than
#: planned; Spark must not pair their partitions.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def materialized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder that the session names; one of our own only in a local session without one."""
    df.sparkSession.conf.set(UNION_PARTITIONING, "false")
    _shared_folder(df)
    return df.checkpoint(eager=True)


def _shared_folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loamspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``materialized`` for tables of texts: compressed files beside the checkpoints, which hold rows as they are in memory."""
    path = f"{_shared_folder(df)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the side of questions up to which it goes to every task whole.
SENT_ROWS = 200_000


def sent_whole(kept: DataFrame):
    """What marks tables no longer than ``kept``, which is cheap to count, to be broadcast; nothing is marked if it is long.

    A checkpoint keeps the estimates of the plan it cut, so Spark alone would shuffle the
    large side of a join with a few questions.
    """
    return F.broadcast if kept.limit(SENT_ROWS + 1).count() <= SENT_ROWS else lambda df: df
