"""Cascading erasure: sorted Parquet files of linked tables, and their rewrite without the victims of an erasure request.

Writing. A table's rows are ranked by an RDD ``sortBy`` over composite tuples (the checksum
of the owner, then every column, nulls first) and ``zipWithIndex``; runs of consecutive
ranks travel as Arrow batches, and a custom partitioner sends each file number to one
pyarrow writer, which streams row groups of ``GROUP_ROWS``. While writing, a file's task
states which links (master, client or sale ids) its rows hold.

Erasure. Links and victims meet in cogrouped RDDs, level by level: masters in files of
clients; the clients erased there in files of clicks and sales; the sales erased there in
files of sale lines. A cogrouped key has the numbers of the files that hold it, never its
rows, so a client or sale with any share of all rows is a short list. The files that hold
victims are read row group by row group and written anew without them.

Lost tasks. Every file is written under a name of its own outside the folder and moved to
its place when it is whole; a rewritten file has another name than the one it replaces,
which stays until all levels are done. What writers return is kept as Parquet in a folder
beside (``...-work``), so no writing stage runs again for later reads, and one that is
repeated while it runs moves the same content to the same names.

Defined cases: null owners sort under the empty text and are no victims; null ids are
erased with their row and link nothing. Where rows of ``sales`` share a sale_id, lines
sort under the smallest of their clients, and go if any of these sales goes. A client_id
in several rows of ``clients`` goes only in the rows with a victim master, but its clicks
and sales go. Repeated rows are kept, in any order, which cannot be told. NaN sorts last, and
counts 0 cents, as infinities do; -0.0 sorts before 0.0. An empty table makes no file; without any master there is
no victim. Texts of any length are whole. Columns of atomic types are written as they are, whatever
their names; nested ones raise an error.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.common import checkpoint_folder, checkpointed, crc32_text

#: Files of a table: 1 + rows // FILES consecutive rows each.
FILES = 150
#: Rows of a sort task, of a writing task (one file at least), of a travelling batch, of a written row group.
SORT_ROWS, WRITE_ROWS, BATCH_ROWS, GROUP_ROWS = 40_000, 25_000, 4096, 65_536
_RECORD = "keys array<long>, place int, file_no long, n_rows long, n_erased long, cents long, ids_sha256 string, path string"


@dataclass(frozen=True)
class Linked:
    """A table in the cascade: ``key`` is the column that victims are found by, ``passes_on`` the one that links further."""

    name: str
    value: str
    key: str
    passes_on: str | None


CLIENTS = Linked("clients", "balance", "master_id", "client_id")
CLICKS = Linked("clicks", "value", "client_id", None)
SALES = Linked("sales", "total", "client_id", "sale_id")
SALE_LINES = Linked("sale_lines", "amount", "sale_id", None)
#: The tables, and the levels of the cascade as their places.
CASCADE = (CLIENTS, CLICKS, SALES, SALE_LINES)
LEVELS = ((0,), (1, 2), (3,))


@dataclass(frozen=True)
class Layout:
    """Where and how the files of a table are written; goes to the workers."""

    table: Linked
    place: int
    schema: pa.Schema
    folder: str
    work: str
    rows: int

    @property
    def per_file(self) -> int:
        return 1 + self.rows // FILES

    @property
    def files(self) -> int:
        return -(-self.rows // self.per_file)

    def path(self, file_no: int, rewritten: bool = False) -> str:
        return f"{self.folder}/{self.table.name}/part-{file_no:05d}{'-rewritten' if rewritten else ''}.parquet"


def is_victim_master(master_id: int) -> bool:
    """The request's own rule: the checksum of the decimal id is divisible by 100."""
    return zlib.crc32(str(master_id).encode()) % 100 == 0


# Rows between Spark, Arrow and comparable tuples.


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "body": [sink.getvalue().to_pybytes()]})


def _batches(body: bytes) -> list[pa.RecordBatch]:
    return pa.ipc.open_stream(body).read_all().to_batches()


#: Stands for null where numbers are compared, below all of them.
NULL = float("-inf")


def _comparable(column: pa.Array) -> list:
    """Values that compare as the column's, nulls first, NaN last: times and floats as whole numbers, texts behind a mark."""
    kind = column.type
    if pa.types.is_timestamp(kind) or pa.types.is_time64(kind):
        column = column.cast(pa.int64())
    elif pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    elif pa.types.is_floating(kind):
        bits = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        column = pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)), mask=column.is_null().to_numpy(zero_copy_only=False))
    elif _texts(kind):
        mark = pa.scalar("1" if not pa.types.is_binary(kind) else b"1", kind)
        blank = pa.scalar("" if not pa.types.is_binary(kind) else b"", kind)
        return pc.fill_null(pc.binary_join_element_wise(mark, column, blank), blank).to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)):
        return [NULL if v is None else v for v in column.to_pylist()]
    # By way of numpy, some ten times faster than value by value.
    values = (pc.fill_null(column, False if pa.types.is_boolean(column.type) else 0) if column.null_count else column).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist() if column.null_count else ():
        values[i] = NULL
    return values


def _texts(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """What ``_comparable`` was made from."""
    if _texts(kind):
        if pa.types.is_binary(kind):
            return pa.array([v[1:] if v else None for v in values], kind)
        marked = pa.array(values, kind)
        return pc.if_else(pc.equal(marked, ""), pa.scalar(None, kind), pc.utf8_slice_codeunits(marked, 1))
    if NULL in values:
        values = [None if v == NULL else v for v in values]
    if pa.types.is_floating(kind):
        held = pa.array(values, pa.int64())
        bits = pc.fill_null(held, 0).to_numpy(zero_copy_only=False)
        return pa.array((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64), mask=held.is_null().to_numpy(zero_copy_only=False)).cast(kind)
    whole = pa.int64() if pa.types.is_timestamp(kind) or pa.types.is_time64(kind) else pa.int32() if pa.types.is_date32(kind) else kind
    return pa.array(values, type=whole).cast(kind)


def _tuples(body: bytes) -> Iterator[tuple]:
    """(checksum, value, value, ...), comparable."""
    for batch in _batches(body):
        yield from zip(*map(_comparable, batch.columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))[1:]
    return pa.RecordBatch.from_arrays([_column(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(ranked: Iterator[tuple[tuple, int]], layout: Layout) -> Iterator[tuple[tuple, bytes]]:
    """Consecutive rows of one file as ((place, file number, first rank), Arrow batch)."""
    while held := list(islice(ranked, BATCH_ROWS)):
        first = held[0][1]
        rows = [row for row, _ in held]
        start = 0
        while start < len(rows):
            file_no = (first + start) // layout.per_file
            stop = min(len(rows), (file_no + 1) * layout.per_file - first)
            batch, sink = _batch(rows[start:stop], layout.schema), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield (layout.place, file_no, first + start), sink.getvalue().to_pybytes()
            start = stop


# Writers.


class FileWriter:
    """One Parquet file in row groups, with its sums; it takes its place when it is whole."""

    def __init__(self, layout: Layout, path: str) -> None:
        self.layout, self.path = layout, path
        self.fs, self.target = pafs.FileSystem.from_uri(path)
        _, folder = pafs.FileSystem.from_uri(f"{layout.work}/unfinished")
        self.fs.create_dir(folder)
        self.temporary = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.out, self.held, self.n_held = None, [], 0
        self.n_rows = self.cents = 0
        self.digest = hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        names = batch.schema.names
        ids = batch.column(0)
        text = ",".join(map(str, ids.to_numpy(zero_copy_only=False).tolist()) if not ids.null_count else ("" if i is None else str(i) for i in ids.to_pylist()))
        self.digest.update((("," if self.n_rows else "") + text).encode())
        x = batch.column(names.index(self.layout.table.value)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore"):
            cents = np.floor(100 * x + 0.5)
        cents = cents[np.isfinite(cents)]
        small = np.abs(cents) < 1 << 40  # sums of these are exact in 64 bits
        self.cents += int(cents[small].astype(np.int64).sum()) + sum(map(int, cents[~small].tolist()))
        self.n_rows += batch.num_rows
        self.held.append(batch)
        self.n_held += batch.num_rows
        if self.n_held >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.out is None:
            self.out = pq.ParquetWriter(self.temporary, self.layout.schema, filesystem=self.fs)
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held, self.layout.schema).combine_chunks(), row_group_size=GROUP_ROWS)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        """Nothing is left behind by a file without rows."""
        if not self.n_rows:
            return
        self._flush()
        self.out.close()
        self.fs.create_dir(self.target.rpartition("/")[0])
        self.fs.move(self.temporary, self.target)

    def record(self, file_no: int, n_erased: int) -> tuple:
        return (None, self.layout.place, file_no, self.n_rows, n_erased, self.cents, self.digest.hexdigest(), self.path if self.n_rows else None)


def _link_keys(batches: list[pa.RecordBatch], name: str) -> list[int]:
    at = batches[0].schema.names.index(name)
    return pc.unique(pa.chunked_array([b.column(at) for b in batches])).drop_null().to_pylist()


def _write(runs: Iterator[tuple[tuple, bytes]], layouts: list[Layout]) -> Iterator[tuple]:
    """Sorted runs of a file to its writer; yields links and the file's record."""
    writer, at = None, None
    for (place, file_no, _), body in runs:
        if (place, file_no) != at:
            if writer is not None:
                writer.close()
                yield writer.record(at[1], 0)
            at = (place, file_no)
            writer = FileWriter(layouts[place], layouts[place].path(file_no))
        batches = _batches(body)
        for batch in batches:
            writer.add(batch)
        yield (_link_keys(batches, layouts[place].table.key), place, file_no, None, None, None, None, None)
    if writer is not None:
        writer.close()
        yield writer.record(at[1], 0)


def _rewrite(victims: Iterator[tuple[tuple[int, int], int]], layouts: list[Layout]) -> Iterator[tuple]:
    """Files with victim keys anew from their survivors; yields what else goes and the file's record.

    A task holds the victim keys of its file, a share of the file's rows, beside one row group.
    """
    keys: dict[tuple[int, int], list[int]] = {}
    for at, key in victims:
        keys.setdefault(at, []).append(key)
    for (place, file_no), found in sorted(keys.items()):
        layout, gone = layouts[place], pa.array(sorted(set(found)), pa.int64())
        names = layout.schema.names
        writer, n_erased = FileWriter(layout, layout.path(file_no, rewritten=True)), 0
        fs, old = pafs.FileSystem.from_uri(layout.path(file_no))
        with fs.open_input_file(old) as source:
            for batch in pq.ParquetFile(source).iter_batches(GROUP_ROWS):
                batch = batch.cast(layout.schema)
                hit = pc.is_in(batch.column(names.index(layout.table.key)).cast(pa.int64()), gone)
                erased = batch.filter(hit)
                n_erased += erased.num_rows
                writer.add(batch.filter(pc.invert(hit)))
                if layout.table.passes_on and erased.num_rows:
                    yield (_link_keys([erased], layout.table.passes_on), place, file_no, None, None, None, None, None)
        writer.close()
        yield writer.record(file_no, n_erased)


class Files:
    """The custom partitioner: all file numbers of the tables in a row, dealt to ``parts`` tasks, a file to one of them."""

    def __init__(self, layouts: list[Layout]) -> None:
        self.start, self.count = {}, 0
        for layout in layouts:
            self.start[layout.place] = self.count
            self.count += layout.files
        self.parts = max(1, min(self.count, -(-sum(x.rows for x in layouts) // WRITE_ROWS)))

    def __call__(self, key: tuple) -> int:
        return (self.start[key[0]] + key[1]) * self.parts // self.count


def _ranked(rows: DataFrame, layout: Layout) -> RDD:
    """Batches with a checksum column in front as ((place, file number, first rank), batch) in the order of all rows."""
    ordered = rows.select("body").rdd.flatMap(lambda r: _tuples(r[0])).sortBy(lambda row: row, numPartitions=max(1, -(-layout.rows // SORT_ROWS)))
    return ordered.zipWithIndex().mapPartitions(lambda ranked: _runs(ranked, layout))


def _kept(rdd: RDD, spark: SparkSession, path: str) -> DataFrame:
    """Run a writing stage once and keep what it returns."""
    spark.createDataFrame(rdd, _RECORD, verifySchema=False).write.parquet(path)
    return spark.read.parquet(path)


def busiest_master(clients: DataFrame, clicks: DataFrame) -> int | None:
    """The master whose clients together have most clicks; of equal ones the smallest."""
    owned = clients.where("master_id IS NOT NULL").select("client_id", "master_id").distinct()
    counts = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    sums = owned.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    first = sums.orderBy(F.desc("n"), "master_id").first()
    return first and first["master_id"]


def sort_keys(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the checksum of each row's owner in front, all columns named by their places."""
    out = {t.name: tables[t.name].select(crc32_text(F.col("client_id")).alias("crc"), *_placed(tables[t.name])) for t in (CLIENTS, CLICKS, SALES)}
    owner = tables["sales"].where("sale_id IS NOT NULL").groupBy(F.col("sale_id").alias("sale_")).agg(F.min("client_id").alias("owner_"))
    lines = tables["sale_lines"]
    joined = lines.join(owner, lines["sale_id"] == owner["sale_"], "left")
    return out | {"sale_lines": joined.select(crc32_text(owner["owner_"]).alias("crc"), *_placed(lines))}


def _placed(df: DataFrame) -> list:
    return [df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(df.columns)]


def _links(kept: DataFrame) -> DataFrame:
    """(key, place, file_no), repeated where row groups of a file repeat it."""
    return kept.select(F.explode("keys").alias("key"), "place", "file_no")


def _hits(links: DataFrame, victims: RDD, parts: int) -> RDD:
    """((place, file number), key) of each victim key in each file that holds it."""
    held = links.select("key", "place", "file_no").distinct().rdd.map(lambda r: (r[0], (r[1], r[2])))
    met = held.cogroup(victims.map(lambda key: (key, None)), parts)
    return met.flatMap(lambda kv: [(at, kv[0]) for at in kv[1][0]] if len(kv[1][1]) else [])


def erase(
    spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None, is_victim: Callable[[int], bool] = is_victim_master, with_busiest: bool = True
) -> DataFrame:
    """Write the four tables of ``CASCADE`` as sorted files in a new folder, then erase the victims from them.

    One row for each final file: table_name, file_no, n_rows, n_erased, cents, rewritten,
    ids_sha256 (of the first column), columns and path.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    folder = folder or f"{checkpoint_folder(spark)}/erasure-{uuid.uuid4().hex}"
    work = f"{folder}-work"
    keyed, layouts, packed = sort_keys(tables), [], []
    for place, table in enumerate(CASCADE):
        fields = [(f.name, to_arrow_type(f.dataType)) for f in tables[table.name].schema.fields]
        if any(pa.types.is_nested(kind) for _, kind in fields):
            raise ValueError(f"{table.name} has nested columns")
        body = checkpointed(keyed[table.name].mapInArrow(_packed, "rows long, body binary"))
        layouts.append(Layout(table, place, pa.schema(fields), folder, work, body.agg(F.sum("rows")).first()[0] or 0))
        packed.append(body)
    files = Files(layouts)
    runs = spark.sparkContext.union([_ranked(body, layout) for body, layout in zip(packed, layouts, strict=True)])
    sorted_runs = runs.repartitionAndSortWithinPartitions(files.parts, files)
    written = _kept(sorted_runs.mapPartitions(lambda it: _write(it, layouts)), spark, f"{work}/written")

    links = _links(written)
    busiest = busiest_master(tables["clients"], tables["clicks"]) if with_busiest else None
    masters = links.where(F.col("place") == 0).select("key").distinct().rdd.map(lambda r: r[0])
    victims = masters.filter(lambda m: m == busiest or is_victim(m))
    levels = []
    for n, places in enumerate(LEVELS):
        files = Files([layouts[p] for p in places])
        hits = _hits(links.where(F.col("place").isin(*places)), victims, files.parts)
        level = _kept(hits.partitionBy(files.parts, files).mapPartitions(lambda it: _rewrite(it, layouts)), spark, f"{work}/level-{n}")
        victims = _links(level).select("key").distinct().rdd.map(lambda r: r[0])
        levels.append(level.where("keys IS NULL").drop("keys"))
    rewritten = levels[0].unionByName(levels[1]).unionByName(levels[2])

    # File numbers are bounded by the layout, so the replaced files are removed by the driver.
    for place, file_no in sorted((r["place"], r["file_no"]) for r in rewritten.select("place", "file_no").collect()):
        fs, old = pafs.FileSystem.from_uri(layouts[place].path(file_no))
        if fs.get_file_info(old).type != pafs.FileType.NotFound:
            fs.delete_file(old)
    stayed = written.where("keys IS NULL").drop("keys").join(rewritten.select("place", "file_no"), ["place", "file_no"], "left_anti")
    final = stayed.withColumn("rewritten", F.lit(False)).unionByName(rewritten.where("n_rows > 0").withColumn("rewritten", F.lit(True)))
    said = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("place") + 1)
    return final.select(
        said([x.table.name for x in layouts]).alias("table_name"), "file_no", "n_rows", "n_erased", "cents", "rewritten",
        "ids_sha256", said([",".join(x.schema.names) for x in layouts]).alias("columns"), "path",
    )
