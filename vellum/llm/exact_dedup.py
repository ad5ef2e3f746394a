"""Exact deduplication by a tree merge of sorted digest runs, in SQL functions only.

Documents are dealt into runs by a hash of their id. Each run is reduced to one
entry per digest, sorted by digest; in round r the runs whose numbers agree but for the last r
digits in base ``fan_in`` are merged in that order, keeping for each
digest the winning id and the group's size, until one run is left. The winners
flow back down the same tree: an entry joins its parent entry, and at the bottom
a document joins the entry of its own run. A digest has one entry per run at
most, so a group that holds a third of all rows never meets in one task, neither
on the way up nor on the way down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, store, without

def _merged(entries: DataFrame, keys: list[str], keep: str, winner: tuple[str, str], size: tuple[Column, str]) -> DataFrame:
    """Entries of equal keys as one, with the winning id and the sum of sizes, in the order of the keys.

    A struct can't be held in a hash aggregation, so Spark sorts every task's entries by the keys, exchanges the
    runs, and merges them in their order (SortAggregate).
    """
    best = F.struct(F.col(winner[0]).isNotNull().cast("int").alias("known"), F.col(winner[0]).alias("id")) if keep == "max" else F.struct(F.col(winner[0]).isNull().cast("int").alias("unknown"), F.col(winner[0]).alias("id"))
    return entries.groupBy(*keys).agg((F.max if keep == "max" else F.min)(best)["id"].alias(winner[1]), F.sum(size[0]).alias(size[1]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | str = "text", keep: str = "min", runs: int | None = None, fan_in: int = 16) -> DataFrame:
    """The columns of ``docs`` with keep_id, group_size, kept and text_sha256.

    ``text`` is a column or an expression (a normalisation) of which equal values
    make a group; null counts as empty. ``keep`` says whether the smallest or the
    largest id of a group stays. An entry is verified at every level by the byte
    length and an independent 64-bit hash, which belong to the merge key: texts that
    agree in the digest alone are kept apart. Among rows that repeat the winning
    id with the same text, one is kept. A null id loses against any other; a group
    of null ids only keeps one of its rows, with a null keep_id. ``runs`` grows
    with the row count unless it is given. An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    if runs is None:
        runs = fan_in ** max(2, math.ceil(math.log(max(docs.count(), 1) / 100_000 + 1, fan_in)))
    body = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    plain = without(docs.columns, *new)
    digest, size, second, run, parent, keep_, n, won = fresh([*docs.columns, *new], "_digest", "_bytes", "_second", "_run", "_parent", "_keep", "_n", "_first")
    key = [digest, size, second]
    rows = docs.select(
        *plain,
        # never null, and said so: else the optimizer filters by the digest and computes it twice
        F.coalesce(F.unhex(F.sha2(body, 256)), F.lit(b"")).alias(digest),
        F.octet_length(body).alias(size),
        F.xxhash64(body).alias(second),
        F.coalesce(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.substring(body, 1, 64))), F.lit(runs)).cast("int"), F.lit(0)).alias(run),
    )
    keys = [run, *key]
    levels = [store(_merged(rows.select(*keys, id_col), keys, keep, (id_col, keep_), (F.lit(1), n)).sortWithinPartitions(*keys))]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        merged = levels[-1].withColumn(run, F.floor(F.col(run) / fan_in).cast("int"))
        levels.append(store(_merged(merged, keys, keep, (keep_, keep_), (F.col(n), n)).sortWithinPartitions(*keys)))
    winners = levels[-1]
    for level in reversed(levels[:-1]):
        parents = winners.select(F.col(run).alias(parent), *key, keep_, n)
        entries = level.select(run, F.floor(F.col(run) / fan_in).cast("int").alias(parent), *key)
        winners = entries.join(parents, [parent, *key]).select(run, *key, keep_, n)
    best = F.col(id_col).desc_nulls_last() if keep == "max" else F.col(id_col).asc_nulls_last()
    first = F.row_number().over(Window.partitionBy(run, *key).orderBy(best)) == 1
    wins = F.col(id_col).eqNullSafe(F.col(keep_)) & F.col(won)
    joined = rows.join(winners, [run, *key]).withColumn(won, first)
    return joined.select(
        *plain, F.col(keep_).alias("keep_id"), F.col(n).cast("bigint").alias("group_size"), wins.alias("kept"), F.lower(F.hex(digest)).alias("text_sha256")
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts, of which the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="max").drop("text")
