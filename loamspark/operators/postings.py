"""Block-max postings and exact top-k search that leaves most blocks of common tokens unread.

A token's postings are dealt to blocks by a hash of the chunk, so those of a stop word are
many rows in many tasks. A block knows its number of entries, its largest tf and smallest
length, which bound what any chunk in it can add to a score.

Search takes two passes. The first scores the rarest tokens of each question; the k-th best
of these partial scores is a threshold that the k-th best whole score reaches as well. Tokens
whose bounds together stay below it (the common ones) cannot bring a chunk into the result by
themselves. The second pass opens only blocks of the other tokens that can reach the
threshold, drops chunks that cannot, and looks up common tokens for what is left, in their
own blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.operators import ranking
from loamspark.session import materialized, sent_whole

#: Chunks that share a block number, on average.
BLOCK_CHUNKS = 512
#: Sums in another order differ by less; scores this near to the threshold count as reaching it.
MARGIN = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    """blocks(token, block, n, max_tf, min_dl, entries(chunk_id, tf, dl)), lengths(chunk_id, dl)."""

    blocks: DataFrame
    lengths: DataFrame
    n_blocks: int

    @staticmethod
    def of(index: ranking.InvertedIndex, block_chunks: int = BLOCK_CHUNKS) -> BlockIndex:
        """Blocks of an index, whose lengths are read once for their number."""
        lengths = materialized(index.lengths)
        n_blocks = max(1, -(-lengths.count() // block_chunks))
        entry = F.struct("chunk_id", "tf", "dl")
        blocks = (
            index.postings.join(lengths, "chunk_id")
            .groupBy("token", _block(F.col("chunk_id"), n_blocks).alias("block"))
            .agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(entry).alias("entries"))
        )
        return BlockIndex(blocks, lengths, n_blocks)

    def narrowed(self, asked: DataFrame) -> BlockIndex:
        """The blocks of asked tokens, read once and kept."""
        tokens = materialized(asked.select("token").distinct())
        return replace(self, blocks=materialized(self.blocks.join(sent_whole(tokens)(tokens), "token", "left_semi")))

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Blocks dealt and sorted by token, so that a scan prunes row groups."""
        self.blocks.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.mode(mode).parquet(f"{path}/blocks")
        self.lengths.withColumn("n_blocks", F.lit(self.n_blocks)).write.mode(mode).parquet(f"{path}/lengths")

    @staticmethod
    def read(spark, path: str) -> BlockIndex:
        lengths = spark.read.parquet(f"{path}/lengths")
        first = lengths.select("n_blocks").first()
        return BlockIndex(spark.read.parquet(f"{path}/blocks"), lengths.drop("n_blocks"), first[0] if first else 1)

    def statistics(self, asked: DataFrame) -> DataFrame:
        """``asked`` (question_id, token, qtf) with df of the token, n and avgdl of all chunks; tokens of no chunk go."""
        df = self.blocks.groupBy("token").agg(F.sum("n").alias("df"))
        return asked.join(df, "token").crossJoin(F.broadcast(self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))))


def _block(chunk_id: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(n_blocks)).cast("int")


def _weight(tf: str, dl: str) -> Column:
    return F.col("qtf") * ranking.term_weight(F.col(tf), F.col(dl), F.col("df"), F.col("n"), F.col("avgdl"))


def pruned_topk(asked: DataFrame, index: BlockIndex, k: int | Column, within: Callable[[DataFrame], DataFrame] = lambda rows: rows, seeds: int = 4) -> DataFrame:
    """question_id, chunk_id, score, rank: the k best of ``ranking.bm25``, ties by chunk_id.

    ``asked``: question_id, token, qtf, df, n, avgdl, and k if it is a column; the index is
    read several times, so it should be stored or ``narrowed``. ``within``
    keeps those rows (question_id, chunk_id, ...) that a question searches; df may be of
    the scope.
    """
    asked = materialized(asked.withColumn("k", F.lit(k) if isinstance(k, int) else k).where("df > 0"))
    sent = sent_whole(asked)  # tables below with a row for each asked token, so that blocks stay where they are read
    blocks = index.blocks.join(sent(asked.select("token").distinct()), "token", "left_semi").withColumnRenamed("n", "size")
    heads = blocks.select("token", "block", "size", "max_tf", "min_dl")
    # What one token can add at most, over all of its blocks.
    bounds = heads.join(sent(asked), "token").groupBy(*asked.columns).agg(F.max(_weight("max_tf", "min_dl")).alias("most"), F.sum("size").alias("listed"))

    rare = W.partitionBy("question_id").orderBy("listed", "token")
    seeded = bounds.withColumn("before", F.coalesce(F.sum("listed").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < seeds * F.col("k"))
    first = _opened(blocks.join(sent(seeded), "token"), within).groupBy("question_id", "chunk_id", "k").agg(F.sum("weight").alias("score"))
    best = W.partitionBy("question_id").orderBy(F.desc("score"))
    floor = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == F.col("k")).select("question_id", (F.col("score") - MARGIN).alias("floor"))

    poor = W.partitionBy("question_id").orderBy("most", "token")
    ranked = bounds.join(floor, "question_id", "left").na.fill(0.0, ["floor"])
    parted = materialized(
        ranked.withColumns({"upto": F.sum("most").over(poor), "all": F.sum("most").over(W.partitionBy("question_id"))})
        .withColumn("common", F.col("upto") < F.col("floor"))
        .withColumn("rest", F.coalesce(F.max(F.when(F.col("common"), F.col("upto"))).over(W.partitionBy("question_id")), F.lit(0.0)))
    )
    # A block is opened where its own bound with those of all other tokens reaches the threshold.
    leading = blocks.join(sent(parted.where("not common")), "token").where(_weight("max_tf", "min_dl") + F.col("all") - F.col("most") >= F.col("floor"))
    some = _opened(leading, within).groupBy("question_id", "chunk_id").agg(F.sum("weight").alias("weight"))
    limits = parted.groupBy("question_id").agg(F.first("rest").alias("rest"), F.first("floor").alias("floor"), F.first("k").alias("k"))
    left = materialized(some.join(limits, "question_id").where(F.col("weight") + F.col("rest") >= F.col("floor")).select("question_id", "chunk_id", "weight", "k"))

    looked = left.select("question_id", "chunk_id", _block(F.col("chunk_id"), index.n_blocks).alias("block"))
    wanted = looked.join(sent(parted.where("common").drop("k")), "question_id")
    read = blocks.join(wanted.select("token", "block").distinct(), ["token", "block"], "left_semi").select("token", F.explode("entries").alias("e")).select("token", "e.*")
    added = read.join(wanted, ["token", "chunk_id"]).select("question_id", "chunk_id", _weight("tf", "dl").alias("weight"))
    total = left.select("question_id", "chunk_id", "weight").unionByName(added).groupBy("question_id", "chunk_id").agg(F.round(F.sum("weight"), ranking.DIGITS).alias("score"))
    return ranking.top_k(total.where("score > 0").join(limits.select("question_id", "k"), "question_id"), F.col("k")).drop("k")


def _opened(found: DataFrame, within: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(question_id, chunk_id, k, weight): entries of blocks met by asked tokens, those that the question searches."""
    entries = found.select("question_id", "k", "qtf", "df", "n", "avgdl", F.explode("entries").alias("e")).select("*", "e.*").drop("e")
    return within(entries.select("question_id", "chunk_id", "k", _weight("tf", "dl").alias("weight")))
