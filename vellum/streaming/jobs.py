"""Jobs of ingestion: their arguments, their attempts, and what a finished one makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arguments of a job.
JOB = ("document_id", "path", "kb")
ATTEMPTS = 3


def checked_jobs(jobs: DataFrame, known: tuple[str, ...] = JOB) -> DataFrame:
    """Jobs (job_id, arguments map) with ``rejected``: why the arguments don't fit, or null."""
    keys, listed = F.map_keys("arguments"), F.array(*map(F.lit, known))
    missing, surplus = F.array_sort(F.array_except(listed, keys)), F.array_sort(F.array_except(keys, listed))
    reason = F.concat_ws("; ", F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))), F.when(F.size(surplus) > 0, F.concat(F.lit("unknown "), F.array_join(surplus, ", "))))
    return jobs.withColumn("rejected", F.nullif(reason, F.lit("")))


def job_states(attempts: DataFrame, most: int = ATTEMPTS, seconds: float = 1800.0) -> DataFrame:
    """(job_id, state, attempts, error) of attempts (job_id, attempt, ok, seconds, error).

    The first attempt in time that is ok completes a job. One that took longer counts as failed. A job is failed, with the
    error of its last attempt, once it has used up its attempts; before that it waits for the next. Later attempts don't count.
    """
    late = F.col("seconds") > seconds
    seen = attempts.where(F.col("attempt") <= most).select("job_id", "attempt", (F.col("ok") & ~late).alias("ok"), F.when(late, "timeout").otherwise(F.col("error")).alias("error"))
    done = F.min(F.when(F.col("ok"), F.col("attempt")))
    per = seen.groupBy("job_id").agg(done.alias("_done"), F.max("attempt").alias("_last"), F.max_by("error", "attempt").alias("_error"))
    state = F.when(F.col("_done").isNotNull(), "completed").when(F.col("_last") >= most, "failed").otherwise("retry")
    return per.select("job_id", state.alias("state"), F.coalesce("_done", "_last").alias("attempts"), F.when(state != "completed", F.col("_error")).alias("error"))


def still_cached(entries: DataFrame, changes: DataFrame, seconds: int = 3600) -> DataFrame:
    """Cache entries (key, kb, stored_at, asked_at) that are fresh when asked for, and whose store had no change (kb, changed_at) in between."""
    last = entries.join(changes, "kb").where("changed_at >= stored_at AND changed_at <= asked_at").select("key", "stored_at", "asked_at").distinct()
    fresh = entries.where(F.unix_timestamp("asked_at") - F.unix_timestamp("stored_at") < seconds)
    return fresh.join(last, ["key", "stored_at", "asked_at"], "left_anti")
