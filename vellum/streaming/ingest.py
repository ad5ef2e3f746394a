"""Streams: files into stored chunks, audit events into windows, and a cache whose entries expire."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import OVERLAP, SIZE, split_blocks
from ..operators.models import Embedder, with_embeddings
from ..operators.recovery import recover_blocks
from ..sources.parsers import blocks_of, failure_report, parse_files
from ..sources.routing import route
from ..sources.scratch import scratch
from ..sources.store import Table

BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of files (path, content), with vectors if there is an embedder, and the reports of files that couldn't be parsed."""
    parsed = parse_files(route(files))
    blocks = recover_blocks(blocks_of(parsed))
    made = split_blocks(blocks, size, overlap)
    return made if embedder is None else with_embeddings(made, "content", embedder), failure_report(parsed)


def stream_files(spark: SparkSession, folder: str, chunks: Table, checkpoint: str, failed: Callable[[DataFrame, int], None] | None = None, embedder: Embedder | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Files that land in a folder, chunked and put in place of their earlier chunks.

    A batch that runs again replaces the same documents by the same chunks, so the sink is exactly-once.
    """

    def batch(files: DataFrame, number: int) -> None:
        made, reports = ingest(files.select("path", "content"), embedder=embedder)
        # written once, and read by all that follows: parsing and embedding don't run again
        done = scratch(spark)
        made.write.parquet(done)
        chunks.replace(files.select(F.col("path").alias("document_id")), spark.read.schema(made.schema).parquet(done))
        if failed is not None:
            failed(reports, number)

    arriving = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_windows(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", slow_ms: float = 5000.0) -> DataFrame:
    """(start, event, n, slow) of audit events (ts timestamp, event, ms) in tumbling windows; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ms") > slow_ms).alias("slow"))
    return counted.select(F.col("w.start").alias("start"), "event", "n", "slow")


def first_in_ttl(requests: DataFrame, ttl: str = "3600 seconds") -> DataFrame:
    """A stream's requests (key, ts, ...) without those whose key was seen within the time that an answer is cached."""
    return requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["key"])
