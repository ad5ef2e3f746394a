"""Stored documents and chunks as versions of Parquet tables.

A change writes a new version of what it touches and then adds a pointer, a small
file whose name has the number of the change: readers see the table before or after, never
between, a path that is being read is never overwritten, and of two writers at once one fails. Chunks are partitioned
by a bucket of the document id; buckets that a change doesn't touch keep their files.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STATUSES, checked_store


#: Pointer files begin so and end with the number of the change; the last one counts.
POINTER = "current-"


class ConcurrentChange(RuntimeError):
    """Two writers changed a table at once; the later one has to repeat its change."""


class Table:
    """A table of ``buckets`` parts by ``key``, of which each change replaces those that it touches."""

    def __init__(self, spark: SparkSession, root: str, kb: str, name: str, key: str, schema: str, buckets: int = 64) -> None:
        self.spark, self.key, self.schema, self.buckets = spark, key, schema, buckets
        self.root = f"{root.rstrip('/')}/{checked_store(kb)}/{name}"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _current(self) -> tuple[int, dict[str, str]]:
        """Number of the last change, and the path of each bucket that has rows."""
        path, fs = self._fs()
        if not fs.exists(path):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        last = max((int(n[len(POINTER) : -5]) for n in names if n.startswith(POINTER) and n.endswith(".json")), default=0)
        if not last:
            return 0, {}
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{POINTER}{last:012d}.json"))
        try:
            return last, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def parts(self) -> dict[str, str]:
        """Path of each bucket that has rows."""
        return self._current()[1]

    def _switch(self, parts: dict[str, str], after: int) -> None:
        """Makes ``parts`` the table, as the change that follows ``after``; an error if another writer has made one."""
        path, fs = self._fs()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        fresh, to = hadoop.Path(f"{self.root}/.{uuid.uuid4().hex}"), hadoop.Path(f"{self.root}/{POINTER}{after + 1:012d}.json")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        context = hadoop.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # without OVERWRITE a rename onto a file that is there fails
            context.rename(fs.makeQualified(fresh), fs.makeQualified(to), self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            fs.delete(fresh, False)
            raise ConcurrentChange(f"another writer has changed {self.root}; read it again and repeat") from None

    def read(self) -> DataFrame:
        paths = sorted(self.parts().values())
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def replace(self, keys: DataFrame, rows: DataFrame | None) -> None:
        """Deletes all rows of ``keys`` and adds ``rows``, in one switch."""
        last, parts = self._current()
        gone = keys.select(self.key).distinct()
        if rows is not None:
            gone = gone.unionByName(rows.select(self.key)).distinct()
        touched = [r[0] for r in gone.select(self._bucket().alias("b")).distinct().collect()]
        old = [parts[str(b)] for b in touched if str(b) in parts]
        kept = self.spark.read.schema(self.schema).parquet(*old).join(gone, self.key, "left_anti") if old else self.spark.createDataFrame([], self.schema)
        if rows is not None:
            kept = kept.select(*rows.columns).unionByName(rows) if old else rows
        version = f"{self.root}/{uuid.uuid4().hex}"
        kept.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(version)
        _, fs = self._fs()
        written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(version)) if s.isDirectory()}
        for b in map(str, touched):
            parts.pop(b, None)
            if b in written:
                parts[b] = f"{version}/_bucket={b}"
        self._switch(parts, last)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows, each in place of those with its key."""
        self.replace(rows, rows)

    def delete(self, keys: DataFrame) -> None:
        self.replace(keys, None)

    def truncate(self) -> None:
        self._switch({}, self._current()[0])

    def count(self) -> int:
        return self.read().count()


def status_of(events: DataFrame) -> DataFrame:
    """(document_id, status, error) by the latest event (document_id, at, status, error); later states win ties."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return events.groupBy("document_id").agg(F.max_by(F.struct("status", "error"), F.struct("at", rank)).alias("s")).select("document_id", "s.status", "s.error")


def admitted(uploads: DataFrame, extensions: list[str], limit: int = 50 * 1024 * 1024) -> DataFrame:
    """Uploads (name, size, secret_level, clearance) with original_name, without any folders, and the reason of a rejection or null."""
    base = F.regexp_extract(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), r"[^/]*$", 0)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    reason = F.when(~ext.isin(*extensions), "extension").when(F.col("secret_level") > F.col("clearance"), "clearance").when(F.col("size") > limit, "size")
    return uploads.withColumns({"original_name": base, "rejected": reason})


def reloaded(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents, of which the listed live ones have a new version, pending and without an error."""
    hit = F.col("_hit").isNotNull() & ~F.col("is_deleted")
    marked = documents.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.withColumns({"version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")), "status": F.when(hit, "pending").otherwise(F.col("status")), "error": F.when(~hit, F.col("error"))}).drop("_hit")
