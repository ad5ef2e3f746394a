"""Measures of retrieval and of latency, one definition of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = ((1, 1, "1"), (2, 3, "2-3"), (4, 5, "4-5"), (6, 10, "6-10"), (11, 20, "11-20"))


def share(condition: Column) -> Column:
    """The share of rows that meet a condition; a null doesn't, and no rows give 0."""
    return F.round(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0)), 6)


def first_hit(hits: DataFrame, hit: Column, *keys: str) -> DataFrame:
    """(keys, rank): the rank of the first hit, null without one."""
    return hits.groupBy(*keys).agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def recall_at(rank: Column, ks: tuple[int, ...] = (1, 3, 5)) -> list[Column]:
    return [share(rank <= k).alias(f"recall_{k}") for k in ks]


def mrr(rank: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr")


def overlap_recall(exact: DataFrame, approximate: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, recall): hits of an exact and an approximate ranking in common, over those possible."""
    sides = [df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name)) for df, name in ((exact, "truth"), (approximate, "found"))]
    both = sides[0].join(sides[1], "query_id", "left")
    cut = lambda c, k: F.slice(F.coalesce(c, F.array().cast("array<bigint>")), F.lit(1), k)
    at = both.select("truth", "found", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return at.groupBy("k").agg(F.round(F.sum(F.size(F.array_intersect(cut(F.col("truth"), F.col("k")), cut(F.col("found"), F.col("k"))))) / (F.count(F.lit(1)) * F.first("k")), 6).alias("recall"))


def nearest_rank(value: str, q: float) -> Column:
    """The smallest value that at least the share q of values doesn't exceed; 0 without values."""
    return F.expr(f"coalesce(percentile_disc({q}) WITHIN GROUP (ORDER BY {value}), 0)")


#: How far, as a share of the rows, the band around a place reaches; approximate percentiles are far closer.
BAND, ACCURACY = 0.001, 10_000


def truncated_index(df: DataFrame, value: str, q: float, out: str, *keys: str) -> DataFrame:
    """(keys, out): the value at place min(n - 1, int(n * q)) from 0; differs from ``nearest_rank``.

    Approximate percentiles give a band that has the place; rows below it are counted, and only those within it are sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).withColumn("_all", F.lit(1))
    by = [*keys, "_all"]
    ends = F.percentile_approx(value, [max(q - BAND, 0.0), min(q + BAND, 1.0)], ACCURACY)
    bounds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_b"))
    both = rows.join(bounds, by)
    low, high = F.col("_b")[0], F.col("_b")[1]
    below = both.groupBy(*by).agg(F.count_if(F.col(value) < low).alias("_below"))
    band = both.where((F.col(value) >= low) & (F.col(value) <= high)).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    placed = band.join(below, by)
    return placed.where(F.col("_r") + F.col("_below") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * q)) + 1).select(*keys, F.col(value).alias(out))


def rank_bucket(rank: Column) -> Column:
    out = F.lit("none")
    for lo, hi, name in BUCKETS:
        out = F.when(rank.between(lo, hi), name).otherwise(out)
    return out


def position_class(rank: Column, shown: int = 5, pool: int = 20) -> Column:
    return F.when(rank <= shown, "shown").when(rank <= pool, "crowded").otherwise("blind")


def rerank_change(before: Column, after: Column) -> Column:
    """What reranking did to the first place, from whether it was right before and after."""
    return F.when(~before & after, "fixed").when(before & ~after, "broke").when(before, "kept_right").otherwise("kept_wrong")


def clarify_rates(df: DataFrame, kind: str, expected: str, judged: str) -> DataFrame:
    """(kind, n, miss_rate, false_alarm_rate) by kind and, with kind "total", over all; null where nothing was expected, or nothing clear."""
    one, other = F.col(expected), ~F.col(expected)
    rates = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(one, (~F.col(judged)).cast("double"))), 6).alias("miss_rate"), F.round(F.avg(F.when(other, F.col(judged).cast("double"))), 6).alias("false_alarm_rate")]
    return df.rollup(kind).agg(*rates).withColumn(kind, F.coalesce(kind, F.lit("total")))


def consistency(variants: DataFrame) -> DataFrame:
    """(question_id, hits, all_hit, same_top) of (question_id, rank, top_source); a missing top counts as a source."""
    hit = F.coalesce(F.col("rank") > 0, F.lit(False))
    return variants.groupBy("question_id").agg(F.count_if(hit).alias("hits"), F.bool_and(hit).alias("all_hit"), (F.count_distinct(F.coalesce("top_source", F.lit("\x00"))) == 1).alias("same_top"))


def stability(verdicts: DataFrame) -> DataFrame:
    """(question_id, class) of verdicts (question_id, level, right): always right, always wrong, or wavering."""
    return verdicts.groupBy("question_id").agg(F.when(F.bool_and("right"), "stable_right").when(~F.bool_or("right"), "stable_wrong").otherwise("wobble").alias("class"))


def agreement(verdicts: DataFrame, level: str, value: str, base: int) -> DataFrame:
    """(level, agreement) of verdicts with those of the base level for the same question."""
    truth = verdicts.where(F.col(level) == base).select("question_id", F.col(value).alias("_base"))
    return verdicts.join(truth, "question_id").groupBy(level).agg(share(F.col(value).eqNullSafe(F.col("_base"))).alias("agreement"))


def slow_sets(calls: DataFrame, limit: float) -> DataFrame:
    """(always, ever): questions that are slow at every level, and at some, of (question_id, level, ms)."""
    levels = calls.agg(F.count_distinct("level").alias("_levels"))
    per = calls.where(F.col("ms") > limit).groupBy("question_id").agg(F.count_distinct("level").alias("n"))
    return per.join(F.broadcast(levels)).agg(F.count_if(F.col("n") == F.col("_levels")).alias("always"), F.count(F.lit(1)).alias("ever"))


def source_diverse(sources: str, least: int) -> Column:
    """Whether a group has at least so many distinct sources that aren't empty."""
    return F.count_distinct(F.nullif(F.col(sources), F.lit(""))) >= least


def deltas(measures: DataFrame, config: str, base: str, other: str) -> DataFrame:
    """(metric, base, other, delta) of (config, metric, value)."""
    wide = measures.groupBy("metric").pivot(config, [base, other]).agg(F.first("value"))
    return wide.withColumn("delta", F.round(F.col(f"`{other}`") - F.col(f"`{base}`"), 6))
