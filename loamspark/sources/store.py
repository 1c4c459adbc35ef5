"""Stored tables: a log of manifests over parts, append, overwrite, upsert, delete, consistency.

A table is a folder of data and of numbered manifests. A part is a folder of Parquet files
with the rows of one key: a bucket of documents, for vectors of one collection as well. A
manifest lists the parts of one version, so a change writes the parts it touches and
carries the others over: an upsert of a few vectors rewrites their buckets, an overwrite of
a collection that collection, an append nothing.

A version is put in place by one rename that fails if the version exists. A writer that was
overtaken takes the newer manifest and puts its own change on top, unless parts that it
replaced are no longer there: then ``Conflict`` is raised and nothing is changed. Readers see
a whole version, the old or the new. ``vacuum`` drops versions beyond the last few and data
that no version names.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.functions.embed import vector_records
from loamspark.functions.text import chunk_fingerprint
from loamspark.schemas import CHUNKS, DOCUMENTS, TURNS, VECTORS, conform, struct

TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "vectors": VECTORS, "turns": TURNS}
#: The column whose value, without a chunk number, deals rows to buckets.
DEALT_BY = {"documents": "id", "chunks": "document_id", "vectors": "chunk_id", "turns": "session_id"}
BUCKETS = 16
MANIFEST = "manifest-"
#: Data that no version names is kept for so many seconds, as a writer may be about to commit it.
GRACE_S = 86_400


class Conflict(OSError):
    """Another writer replaced parts that this change replaces too."""


@dataclass(frozen=True)
class Part:
    """A folder of data under the table's, and the key of its rows."""

    key: str
    path: str


@dataclass(frozen=True)
class Version:
    """A manifest; ``done`` has the last step that each repeated writer (a stream) has committed."""

    number: int
    parts: tuple[Part, ...] = ()
    done: dict[str, int] = field(default_factory=dict)

    def has(self, step: tuple[str, int] | None) -> bool:
        return step is not None and self.done.get(step[0], -1) >= step[1]


def collection_key(collection_id: str | None) -> str:
    """What the keys of a collection begin with; safe in a path whatever the name."""
    return hashlib.md5(f"={collection_id}".encode() if collection_id is not None else b"").hexdigest()[:12]


def part_key(table: str, buckets: int = BUCKETS) -> Column:
    """The key of a row."""
    owner = F.regexp_replace(F.coalesce(DEALT_BY[table], F.lit("")), r":\d+$", "")
    bucket = F.lpad(F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("string"), 4, "0")
    if table != "vectors":
        return bucket
    named = F.md5(F.coalesce(F.concat(F.lit("="), "collection_id"), F.lit("")).cast("binary"))
    return F.concat(F.substring(named, 1, 12), F.lit("-"), bucket)


class Store:
    """Tables under one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm_path

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with their times of change in milliseconds."""
        fs, at = self._fs(folder)
        return sorted((x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self, table: str) -> list[int]:
        return [int(n.removeprefix(MANIFEST)) for n, _ in self._names(f"{self.root}/{table}") if n.startswith(MANIFEST)]

    def version(self, table: str, number: int | None = None) -> Version:
        """One version, the latest if no number is given; an empty one before the first."""
        if number is None:
            known = self.versions(table)
            if not known:
                return Version(-1)
            number = known[-1]
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{table}/{MANIFEST}{number:012d}").collect())
        held = json.loads(text)
        return Version(number, tuple(Part(**p) for p in held["parts"]), held["done"])

    def scan(self, table: str, keys: Iterable[str] | None = None, number: int | None = None) -> DataFrame:
        """A version's rows, the latest's if no number is given; ``keys`` are those that keys must begin with. A missing table is empty."""
        wanted = None if keys is None else tuple(keys)
        return self._read(table, [p for p in self.version(table, number).parts if wanted is None or p.key.startswith(wanted)])

    def _read(self, table: str, parts: Iterable[Part]) -> DataFrame:
        schema = struct(TABLES[table])
        paths = [f"{self.root}/{table}/{p.path}" for p in parts]
        return conform(self.spark.read.schema(schema).parquet(*paths), TABLES[table]) if paths else self.spark.createDataFrame([], schema)

    def _write(self, table: str, rows: DataFrame) -> tuple[Part, ...]:
        """New parts, not yet in any version."""
        folder = f"data-{uuid.uuid4().hex}"
        keyed = conform(rows, TABLES[table]).withColumn("key_", part_key(table, self.buckets))
        keyed.repartition("key_").write.partitionBy("key_").parquet(f"{self.root}/{table}/{folder}")
        return tuple(Part(n.removeprefix("key_="), f"{folder}/{n}") for n, _ in self._names(f"{self.root}/{table}/{folder}") if n.startswith("key_="))

    def commit(self, table: str, base: Version, removed: Iterable[Part], added: Iterable[Part], step: tuple[str, int] | None = None) -> Version:
        """The version after ``base``, or after a newer one that still has the removed parts; nothing if it has the step already."""
        removed, added = frozenset(removed), tuple(added)
        while not base.has(step):
            if not removed <= frozenset(base.parts):
                raise Conflict(f"parts of {table} were replaced by another writer")
            fresh = Version(base.number + 1, (*[p for p in base.parts if p not in removed], *added), base.done | ({step[0]: step[1]} if step else {}))
            if self._put(table, fresh):
                return fresh
            base = self.version(table)
        return base

    def _put(self, table: str, fresh: Version) -> bool:
        """Whether the manifest took its place; False if the version exists."""
        fs, draft = self._fs(f"{self.root}/{table}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"parts": [asdict(p) for p in fresh.parts], "done": fresh.done}).encode()))
        stream.close()
        _, target = self._fs(f"{self.root}/{table}/{MANIFEST}{fresh.number:012d}")
        gateway, hadoop = self.spark.sparkContext._gateway, self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.NONE  # an existing target is an error
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def overwrite(self, table: str, rows: DataFrame) -> Version:
        """A version of these rows alone."""
        base = self.version(table)
        return self.commit(table, base, base.parts, self._write(table, rows))

    def append(self, table: str, rows: DataFrame, step: tuple[str, int] | None = None) -> Version:
        """A version with these rows as well; the table is made if it is missing. A (writer, number) ``step`` is written once."""
        base = self.version(table)
        return base if base.has(step) else self.commit(table, base, (), self._write(table, rows), step)

    def replace_keys(self, table: str, keys: Iterable[str], change, prefix: bool = False) -> Version:
        """``change`` (rows to rows) applied to the parts of these keys, or of keys that begin with them; other parts stay."""
        base, wanted = self.version(table), tuple(keys)
        old = [p for p in base.parts if (p.key.startswith(wanted) if prefix else p.key in wanted)]
        return self.commit(table, base, old, self._write(table, change(self._read(table, old))))

    def vacuum(self, table: str, keep: int = 2, grace_s: float = GRACE_S) -> int:
        """Versions but the last ``keep`` go, then data that none of these names and that is older than the grace; how many folders went."""
        known = self.versions(table)
        fs = self._fs(self.root)[0]
        for number in known[: -max(keep, 1)]:
            fs.delete(self._fs(f"{self.root}/{table}/{MANIFEST}{number:012d}")[1], False)
        used = {p.path.split("/")[0]: set() for n in known[-max(keep, 1) :] for p in self.version(table, n).parts}
        for n in known[-max(keep, 1) :]:
            for p in self.version(table, n).parts:
                used[p.path.split("/")[0]].add(p.path)
        gone, limit = 0, (time.time() - grace_s) * 1000
        for folder, changed in self._names(f"{self.root}/{table}"):
            if not folder.startswith("data-") or changed > limit:
                continue
            inner = [f"{folder}/{n}" for n, _ in self._names(f"{self.root}/{table}/{folder}") if n.startswith("key_=")]
            for path in [folder] if folder not in used else [p for p in inner if p not in used[folder]]:
                fs.delete(self._fs(f"{self.root}/{table}/{path}")[1], True)
                gone += 1
        return gone

    def import_json(self, table: str, path: str) -> DataFrame:
        """Rows of a JSON array file in the declared schema; a missing file is empty."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], struct(TABLES[table]))
        return conform(self.spark.read.schema(struct(TABLES[table])).option("multiLine", True).json(path), TABLES[table])

    def list_vectors(self, collection_id: str | None = None, active_only: bool = False) -> DataFrame:
        """Vectors, of one collection from its parts alone."""
        rows = self.scan("vectors", None if collection_id is None else [collection_key(collection_id)])
        if collection_id is not None:
            rows = rows.where(F.col("collection_id") == collection_id)
        return rows.where("is_active") if active_only else rows

    def add_documents(self, documents: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, step: tuple[str, int] | None = None) -> None:
        """Documents, their chunks and vectors; vectors are made if not given.

        Documents come last, since they say what is stored: a call that fails before leaves
        chunks and vectors that its repetition does not write again; it knows them by the
        step that the manifests name or, without one, by their ids.
        """
        self.append("chunks", chunks if step else chunks.join(self.scan("chunks").select("id"), "id", "left_anti"), step)
        self.upsert_vectors(vectors if vectors is not None else vector_records(chunks))
        self.append("documents", documents, step)

    def rebuild(self, documents: DataFrame, chunks: DataFrame, rebuild_vectors: bool = True) -> None:
        """All tables anew; without ``rebuild_vectors`` the vectors of every collection are cleared."""
        self.overwrite("documents", documents)
        self.overwrite("chunks", chunks)
        self.overwrite("vectors", vector_records(chunks) if rebuild_vectors else self.scan("vectors").limit(0))

    def write_vectors(self, rows: DataFrame, collection_id: str | None = None) -> None:
        """Overwrite one collection, or all of them."""
        if collection_id is None:
            self.overwrite("vectors", rows)
        else:
            own = conform(rows, VECTORS).withColumn("collection_id", F.lit(collection_id))
            self.replace_keys("vectors", [collection_key(collection_id)], lambda _: own, prefix=True)

    def upsert_vectors(self, rows: DataFrame, collection_id: str | None = None) -> None:
        """Replace by (collection_id, chunk_id), in the parts that hold these keys."""
        rows = conform(rows, VECTORS)
        if collection_id is not None:
            rows = rows.withColumn("collection_id", F.lit(collection_id))
        keys = [r[0] for r in rows.select(part_key("vectors", self.buckets)).distinct().collect()]  # collections times buckets at most
        if keys:
            self.replace_keys("vectors", keys, lambda stored: upserted(stored, rows))

    def delete_document(self, document_id: str, collection_id: str | None = None) -> int:
        """Document, chunks and vectors (of one collection, if named) go; the number of documents that went."""
        named = self.spark.range(1).select(*[F.lit(document_id).alias(c) for c in ("id", "document_id")])
        (key,) = named.select(part_key("documents", self.buckets)).first()
        gone = self.scan("documents", [key]).where(F.col("id") == document_id).count()
        if gone:
            self.replace_keys("documents", [key], lambda rows: rows.where(F.col("id") != document_id))
            self.replace_keys("chunks", [key], lambda rows: rows.where(F.col("document_id") != document_id))
        hit = self.list_vectors(collection_id).where(F.col("document_id") == document_id)
        keys = [r[0] for r in hit.select(part_key("vectors", self.buckets)).distinct().collect()]
        if keys:
            self.replace_keys("vectors", keys, lambda rows: without_document(rows, document_id, collection_id))
        return gone

    def find_by_url(self, url: str) -> DataFrame:
        return self.scan("documents").where(F.col("source_url") == url).orderBy("created_at", "id").limit(1)

    def find_by_path(self, path: str) -> DataFrame:
        return self.scan("documents").where(F.col("source_path") == path).orderBy("created_at", "id").limit(1)

    def new_only(self, rows: DataFrame, key: str | None = None) -> DataFrame:
        """Rows whose origin, or whose ``key``, no stored document has."""
        documents = self.scan("documents")
        if key is not None:
            return not_stored(rows, documents, key)
        return not_stored(rows.withColumn("origin_", origin()), documents.withColumn("origin_", origin()), "origin_").drop("origin_")

    def consistency(self, collection_id: str | None = None) -> DataFrame:
        return consistency(self.scan("chunks"), self.list_vectors(collection_id))

    def health(self) -> dict[str, object]:
        return {"root": self.root, **{t: self.scan(t).count() for t in TABLES}}


def upserted(stored: DataFrame, rows: DataFrame, collection_id: str | None = None) -> DataFrame:
    """Stored rows less those that are replaced, and the last row given for each key."""
    if collection_id is not None:
        rows = rows.withColumn("collection_id", F.lit(collection_id))
    latest = W.partitionBy("collection_id", "chunk_id").orderBy(F.desc_nulls_last("created_at"), F.desc("chunk_hash"))
    new = rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    return stored.join(new.select("collection_id", "chunk_id"), ["collection_id", "chunk_id"], "left_anti").select(new.columns).unionByName(new)


def without_document(vectors: DataFrame, document_id: str, collection_id: str | None = None) -> DataFrame:
    hit = F.col("document_id") == document_id
    if collection_id is not None:
        hit = hit & (F.col("collection_id") == collection_id)
    return vectors.where(~F.coalesce(hit, F.lit(False)))


def origin():
    """Where a document comes from: its address, else its path, else its id."""
    return F.coalesce("source_url", "source_path", "id")


def not_stored(rows: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    return rows.join(documents.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def consistency(chunks: DataFrame, vectors: DataFrame, fingerprint=None) -> DataFrame:
    """One row: chunks, vectors, and how many are missing, stale and orphan."""
    current = chunks.select(F.col("id").alias("chunk_id"), (chunk_fingerprint() if fingerprint is None else fingerprint).alias("now"))
    active = vectors.where("is_active").select("chunk_id").distinct()
    missing = current.join(active, "chunk_id", "left_anti").agg(F.count("*").alias("missing_vectors"))
    matched = vectors.select("chunk_id", "chunk_hash").join(current.withColumn("there", F.lit(True)), "chunk_id", "left")
    stale = F.col("there") & (F.coalesce("chunk_hash", F.lit("")) != "") & (F.col("chunk_hash") != F.col("now"))
    found = matched.agg(F.count("*").alias("vectors"), F.count_if(stale).alias("stale_vectors"), F.count_if(F.col("there").isNull()).alias("orphan_vectors"))
    total = chunks.agg(F.count("*").alias("chunks"))
    return total.crossJoin(found).crossJoin(missing).select("chunks", "vectors", "missing_vectors", "stale_vectors", "orphan_vectors")


