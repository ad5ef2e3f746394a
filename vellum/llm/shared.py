"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset, a temporary one if they are one process, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellum-"))
    return context.getCheckpointDir()


def held_out(doc_id: Column, modulus: int = 4) -> Column:
    """Whether a document is kept away from learning: remainder 2 of the CRC of its id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids that are not held out, the smallest by hash: (doc_id, label).

    Rows with a null id or label are left out; of several labels of an id the larger counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # of many more than wanted, most go before the sort: twice as many as wanted are expected to stay, so enough do
    size, place = rows.count(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    if size > 4 * limit and limit >= 1000:
        rows = rows.where(place <= F.lit(2 * limit * (1 << 20) // size))
    return rows.orderBy(place, "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame, text: str = "text") -> DataFrame:
    """(label, text) of the documents of a ``labelled_sample``: one row an id, the smallest text of those that repeat it."""
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: smaller than ``cut``; removed when the process ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Removes the files of ``store``, of which nothing that is still to be computed may read."""
    for df in stored:
        _remove(df.sparkSession, df._stored_at)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores behind them until none is one of ``columns``, upper and lower case being the same."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(columns: Iterable[str], *names: str) -> list[str]:
    """``columns`` but those that are called like one of ``names``, upper and lower case being the same."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]
