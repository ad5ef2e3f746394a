"""What reports are made of: projections of stored rows, group measures, failure rates and comparisons of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_line
from .metrics import share, source_diverse

#: Columns of a chunk that a hit shows.
CHUNK_COLUMNS = ("id", "document_id", "chunk_index", "content", "department", "secret_level", "source_file", "title", "start_offset", "end_offset", "page", "raw_table", "table_complex")


def display_name(original: Column, filename: Column) -> Column:
    return F.coalesce(original, filename)


def chunk_rows(rows: DataFrame, score: str = "score") -> DataFrame:
    """Hits with the columns of a chunk and a score in double precision; columns that a store lacks are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in CHUNK_COLUMNS], F.col(score).cast("double").alias("score"))


def sources_shown(hits: DataFrame) -> DataFrame:
    """What an answer shows of its sources: score to four places, page, and the raw table where there is one."""
    return hits.select("query_id", "rank", "source_file", "chunk_index", F.bround("score", 4).alias("score"), "page", "raw_table")


def first_sources(hits: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, sources): the first ``n`` distinct sources in alphabetical order."""
    return hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("source_file")), 1, n).alias("sources"))


def labelled_union(parts: dict[str, DataFrame], label: str = "category") -> DataFrame:
    """All parts under each other, with the name of each."""
    named = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def same_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """(document_id, same): whether two parses of a document give the same kinds and texts in the same order; one side alone differs."""
    side = lambda df, name: df.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))), lambda x: F.struct(x["kind"], x["text"])).alias(name))
    both = side(a, "_a").join(side(b, "_b"), "document_id", "full")
    return both.select("document_id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def most_changed(difference: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` values added most and the ``n`` removed most, of a multiset difference (value, added, removed)."""
    value = next(c for c in difference.columns if c not in ("added", "removed"))
    sides = [difference.where(F.col(s) > 0).orderBy(F.desc(s), value).limit(n).select(value, F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("added", "removed")]
    return sides[0].unionByName(sides[1])


def with_warning(warnings: Column, warning: Column) -> Column:
    """Warnings with one more, unless it is there already."""
    return F.array_union(F.coalesce(warnings, F.array().cast("array<string>")), F.array(warning))


def group_means(calls: DataFrame, limit: float) -> DataFrame:
    """(grp, n, mean_ms, mean_length, over) of calls (grp, ms, length): mean latency and length of a group, and calls over the limit."""
    return calls.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.avg("length"), 6).alias("mean_length"), F.count_if(F.col("ms") > limit).alias("over"))


def numeric_rates(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall over all questions; and over hits only, the share whose chunk has both value and anchor, whose line has, and whose table is broken.

    ``hits`` has rank (null without a hit), content, value, anchor and broken, a row for each question.
    """
    hit, content = F.col("rank").isNotNull(), F.col("content")
    whole = F.contains(content, F.col("value")) & F.contains(content, F.col("anchor"))
    over_hits = lambda c: F.round(F.coalesce(F.avg(F.when(hit, F.coalesce(c, F.lit(False)).cast("double"))), F.lit(0.0)), 6)
    return hits.agg(
        F.count(F.lit(1)).alias("n"), *[share(F.col("rank") <= k).alias(f"recall_{k}") for k in ks], over_hits(whole).alias("same_chunk"),
        over_hits(same_line(content, F.col("value"), F.col("anchor"))).alias("same_line"), over_hits(F.col("broken")).alias("broken"),
    )


def failure_rates(attempts: DataFrame) -> DataFrame:
    """(path, attempts, failures, rate) of attempts (path, ok), the worst first."""
    counted = attempts.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    return counted.withColumn("rate", F.round(F.col("failures") / F.col("attempts"), 6)).orderBy(F.desc("rate"), "path")


def block_signature(kinds: Column, texts: Column) -> Column:
    """One hash of a parse's blocks in their order, by which attempts are told apart."""
    return F.sha2(F.array_join(F.zip_with(kinds, texts, lambda k, t: F.concat(k, F.lit(":"), F.coalesce(t, F.lit("")))), "\x1e"), 256)


def verdicts_by_scope(hits: DataFrame, scopes: dict[str, Column], least: int = 2) -> DataFrame:
    """(question_id, scope, gate): whether the hits (question_id, source_file, ...) that a scope lets through have ``least`` sources; none have not."""
    every = [hits.withColumn("source_file", F.when(inside, F.col("source_file"))).groupBy("question_id").agg(source_diverse("source_file", least).alias("gate")).withColumn("scope", F.lit(name)) for name, inside in scopes.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.select("question_id", "scope", "gate")


def first_by(hits: DataFrame, source: str, anchor: str | None = None) -> DataFrame:
    """(question_id, rank): the first hit of the expected source; with an anchor, of one whose content has it, too."""
    hit = F.col("source_file") == F.col(source)
    if anchor is not None:
        hit &= F.contains("content", F.col(anchor))
    return hits.groupBy("question_id").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def deciles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, p10, p50, p90): values at the places n // 10, n // 2 and int(0.9 n) from 0, by the value's counts."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    listed = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "_n"))).alias("_l"), F.sum("_n").alias("_total"))

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(df.schema[value].dataType).alias("v"))
        return F.aggregate("_l", start, lambda s, x: F.when(s["seen"] > place, s).otherwise(F.struct((s["seen"] + x["_n"]).alias("seen"), x["v"].alias("v"))))["v"]

    total = F.col("_total")
    return listed.select(*keys, at(F.floor(total / 10)).alias("p10"), at(F.floor(total / 2)).alias("p50"), at(F.least(total - 1, F.floor(total * 0.9))).alias("p90"))


def text_of(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, text) of wanted files: from the first folder, by ``priority``, of files (file, priority, text) that has it, else empty."""
    best = files.groupBy("file").agg(F.min_by("text", "priority").alias("text"))
    return wanted.select("file").join(best, "file", "left").select("file", F.coalesce("text", F.lit("")).alias("text"))


def status_in(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, http, status, error, chunk_count) of asked ids within one store: 404 for an id that it lacks."""
    known = documents.select("id", "status", "error", "chunk_count", F.lit(200).alias("_http"))
    return ids.select("id").join(known, "id", "left").select("id", F.coalesce("_http", F.lit(404)).alias("http"), "status", "error", "chunk_count")


def snapshot(rows: DataFrame, match: Column, columns: list[str]) -> dict[str, object] | None:
    """One matching row's columns, before or after a change; None without one."""
    found = rows.where(match).select(*columns).orderBy(*columns).limit(1).collect()
    return found[0].asDict() if found else None


def report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """Writes a summary and its details as JSON lines into two folders of ``path``."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").json(f"{path}/details")
