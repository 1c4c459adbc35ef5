"""Merkle fixity audit of WARC archives.

A record has an archive, the byte offset and length it has in it, and a digest. Leaves of
an archive's tree are byte ranges of ``base`` bytes, each hashing the records that begin in
it in order of offset; a node above hashes ``fanout`` neighbouring ranges. Ranges are cut
by offset, not by count, so no order over a whole archive is needed: a group is bounded by
the records that fit ``base`` bytes, whatever the archive's size.

Two replicas are compared from the roots down. Only children of nodes that differ are
joined at the next level, and only records of leaf ranges that differ are compared. Every
level is checkpointed once, each a ``fanout``-th of the one below, so nothing is hashed twice.

Records of differing ranges that both replicas have are dropped. Of what is left, equal
(archive, length, digest) at other offsets are ``moved`` (a lost or cut record shifts all
that follow it), different records at one offset are ``corrupt``; the rest is ``missing`` or
``extra``. Several records that could pair do so in order of offset, one with one.

Defined cases: a null archive is the empty name, a null length -1, a null digest empty. A
record without an offset (null or negative) gets a place below zero by its hash, so any
number of them is spread over ranges; its offset is given as -1. Repeated rows count once.
An empty replica lacks every record; two empty ones agree. Columns other than the four of
``RECORD`` do not matter, whatever their names. Payloads of any length are hashed in the
JVM row by row; ``read_warc`` holds one archive, of 2 GB at most, in a task at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.llm.common import checkpointed

#: Places below zero that records without an offset are spread over.
UNPLACED = 1 << 36
RECORD = "archive string, offset long, length long, digest string"


def page_records(pages: DataFrame, per_archive: int = 4096) -> DataFrame:
    """archive, page_id, url, payload: pages as WARC response records, ``per_archive`` ids an archive."""
    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        F.lit("\r\n\r\n"),
    )
    number = F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("string")
    return pages.select(
        F.concat(F.lit("part-"), number, F.lit(".warc")).alias("archive"),
        "page_id",
        "url",
        F.concat(header, F.coalesce("html", F.lit("")), F.lit("\r\n\r\n")).alias("payload"),
    )


def digested(records: DataFrame) -> DataFrame:
    """Payloads replaced by their byte length and SHA-256."""
    return records.select("archive", "page_id", "url", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("digest"))


def with_offsets(index: DataFrame) -> DataFrame:
    """Offsets of records written one after another by page_id, url and digest."""
    order = W.partitionBy("archive").orderBy("page_id", "url", "digest").rowsBetween(W.unboundedPreceding, 0)
    return index.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or with one gzip member a record: archive, offset, length, digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, at, size, hashlib.sha256(data).hexdigest()) for at, size, data in warc_members(bytes(content))]
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, RECORD)


STEP = 1 << 16


def _inflated(content: memoryview, at: int) -> tuple[int, bytes] | None:
    """Stored length and bytes of the gzip member that begins at ``at``; None if it is damaged or cut."""
    inflate, parts, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and end < len(content):
            parts.append(inflate.decompress(content[end : end + STEP]))
            end = min(end + STEP, len(content))
    except zlib.error:
        return None
    return (end - at - len(inflate.unused_data), b"".join(parts)) if inflate.eof else None


def _stated(content: bytes, at: int) -> int | None:
    """Length of the plain record that begins at ``at``, by its header; None if it has none or is cut."""
    head = content.find(b"\r\n\r\n", at)
    if head < 0 or not content.startswith(b"WARC/", at):
        return None
    fields = [x.split(b":", 1) for x in content[at:head].split(b"\r\n")[1:] if b":" in x]
    length = next((v.strip() for k, v in fields if k.strip().lower() == b"content-length"), b"")
    size = head + 8 + int(length) - at if length.isdigit() else None
    return size if size is not None and at + size <= len(content) and content.startswith(b"\r\n\r\n", at + size - 4) else None


def _next_record(content: bytes, at: int) -> int:
    """Where the next record begins after a damaged one: a member that inflates to a header, or a header."""
    while at < len(content):
        packed, plain = content.find(b"\x1f\x8b\x08", at), content.find(b"WARC/", at)
        found = [x for x in (packed, plain) if x >= 0]
        if not found:
            break
        at = min(found)
        if at == plain:
            return at
        try:
            if zlib.decompressobj(31).decompress(content[at : at + 512], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(content)


def warc_members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, stored length and bytes of each record, in time linear in the content.

    A damaged or cut record is given as the raw bytes up to the next one that can be read.
    """
    at, view = 0, memoryview(content)
    while at < len(content):
        member = _inflated(view, at) if content.startswith(b"\x1f\x8b", at) else None
        size = member[0] if member else _stated(content, at)
        if size is None:
            size = _next_record(content, at + 1) - at
        yield at, size, member[1] if member else content[at : at + size]
        at += size


def _clean(records: DataFrame) -> DataFrame:
    """archive, at, length, digest of distinct records; ``at`` is the offset or a place below zero."""
    named = records.select(
        F.coalesce("archive", F.lit("")).alias("archive"),
        F.col("offset").cast("long").alias("offset"),
        F.coalesce(F.col("length").cast("long"), F.lit(-1)).alias("length"),
        F.coalesce("digest", F.lit("")).alias("digest"),
    )
    unplaced = -1 - F.pmod(F.xxhash64("length", "digest"), F.lit(UNPLACED))
    return named.select("archive", F.when(F.col("offset") >= 0, F.col("offset")).otherwise(unplaced).alias("at"), "length", "digest").distinct()


def leaf_ranges(records: DataFrame, base: int) -> DataFrame:
    """archive, node, hash of each range of ``base`` bytes in which records begin."""
    entry = F.struct("at", "length", "digest")
    written = lambda r: F.concat_ws(":", r["at"].cast("string"), r["length"].cast("string"), r["digest"])
    return (
        records.groupBy("archive", F.floor(F.col("at") / base).alias("node"))
        .agg(F.array_sort(F.collect_list(entry)).alias("r"))
        .select("archive", "node", F.sha2(F.array_join(F.transform("r", written), "\n"), 256).alias("hash"))
    )


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above: each node hashes the numbers and hashes of its children in order."""
    written = lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])
    return (
        nodes.groupBy("archive", F.floor(F.col("node") / fanout).alias("parent"))
        .agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
        .select("archive", F.col("parent").alias("node"), F.sha2(F.array_join(F.transform("c", written), "\n"), 256).alias("hash"))
    )


def merkle_levels(records: DataFrame, base: int, fanout: int, height: int) -> list[DataFrame]:
    """Levels from the leaf ranges to the roots, each checkpointed."""
    levels = [checkpointed(leaf_ranges(records, base))]
    for _ in range(height):
        levels.append(checkpointed(parents(levels[-1], fanout)))
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.withColumnRenamed("hash", "l").join(right.withColumnRenamed("hash", "r"), ["archive", "node"], "full_outer")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node")


def roots(records: DataFrame, base: int = 1 << 18, fanout: int = 16) -> DataFrame:
    """archive, node, hash at the height at which every archive has one node (two with unplaced records)."""
    clean = checkpointed(_clean(records))
    return merkle_levels(clean, base, fanout, _height(clean, base, fanout))[-1]


def _height(records: DataFrame, base: int, fanout: int) -> int:
    """Levels above the leaves until a side of zero is one node."""
    span = records.agg(F.max(F.greatest(F.col("at") + 1, -F.col("at")))).first()[0]
    height = 0
    while span is not None and span > base * fanout**height:
        height += 1
    return height


def _paired(left: DataFrame, right: DataFrame, keys: list[str], status: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of rows with equal keys, one with one in order; and what is left of both sides."""
    order = W.partitionBy(*keys).orderBy("at", "length", "digest")
    side = lambda x, name: x.select(*keys, F.row_number().over(order).alias("n"), F.struct("at", "length", "digest").alias(name))
    both = checkpointed(side(left, "l").join(side(right, "r"), [*keys, "n"], "full_outer").select("archive", "l", "r"))
    paired = both.where("l is not null and r is not null").select("archive", "l", F.lit(status).alias("status"), "r")
    return paired, both.where("r is null").select("archive", "l.*"), both.where("l is null").select("archive", "r.*")


def audit(primary: DataFrame, replica: DataFrame, base: int = 1 << 18, fanout: int = 16) -> DataFrame:
    """archive, offset, found_offset, status (moved, corrupt, missing, extra), lengths and digests of every record that differs.

    ``offset`` is where the primary has the record, for an extra one where the replica has it.
    """
    left, right = checkpointed(_clean(primary)), checkpointed(_clean(replica))
    height = max(_height(left, base, fanout), _height(right, base, fanout))
    a, b = merkle_levels(left, base, fanout, height), merkle_levels(right, base, fanout, height)
    suspects = _differing(a[-1], b[-1])
    for level in range(height - 1, -1, -1):
        above = suspects.withColumnRenamed("node", "up")
        below = [
            x.join(above, (x["archive"] == above["archive"]) & (F.floor(x["node"] / fanout) == above["up"]), "left_semi")
            for x in (a[level], b[level])
        ]
        suspects = checkpointed(_differing(*below))
    spans = suspects.withColumnRenamed("node", "up")
    old, new = [x.join(spans, (x["archive"] == spans["archive"]) & (F.floor(x["at"] / base) == spans["up"]), "left_semi") for x in (left, right)]
    every = ["archive", "at", "length", "digest"]
    old, new = old.join(new, every, "left_anti"), new.join(old, every, "left_anti")
    moved, old, new = _paired(old, new, ["archive", "length", "digest"], "moved")
    corrupt, old, new = _paired(old, new, ["archive", "at"], "corrupt")
    row, none = F.struct("at", "length", "digest"), F.lit(None).cast("struct<at:long,length:long,digest:string>")
    missing = old.select("archive", row.alias("l"), F.lit("missing").alias("status"), none.alias("r"))
    extra = new.select("archive", none.alias("l"), F.lit("extra").alias("status"), row.alias("r"))
    shown = lambda c: F.when(c < 0, F.lit(-1)).otherwise(c).cast("long")
    return moved.unionByName(corrupt).unionByName(missing).unionByName(extra).select(
        "archive", shown(F.coalesce("l.at", "r.at")).alias("offset"), shown(F.col("r.at")).alias("found_offset"), "status",
        F.col("l.length").alias("expected_length"), F.col("r.length").alias("found_length"), F.col("l.digest").alias("expected"), F.col("r.digest").alias("found"),
    )
