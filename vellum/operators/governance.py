"""Completeness, reproducibility, versions and corrections of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CONTENT_STATUSES, shape

#: Columns that a correction may set, and their types; and those that are refused with a reason of their own.
CHUNK_FIELDS = {"department": "string", "secret_level": "int", "title": "string", "is_deprecated": "boolean"}
DOCUMENT_FIELDS = {"content_status": "string"}
DERIVED = ("id", "document_id", "content", "embedding", "content_tsv", "content_hash", "raw_table", "chunk_index")
_WORDS = {"true": True, "1": True, "false": False, "0": False}


def differences(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of both has, ``missing`` or ``surplus``."""
    e, s = expected.select(key).distinct(), stored.select(key).distinct()
    return e.join(s, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(s.join(e, key, "left_anti").withColumn("side", F.lit("surplus")))


def multiset_difference(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """(value, added, removed) for each value whose number of rows differs; one shuffle for both directions."""
    counted = before.select(value, F.lit(-1).alias("_n")).unionByName(after.select(value, F.lit(1).alias("_n"))).groupBy(value).agg(F.sum("_n").alias("_n"))
    return counted.where("_n <> 0").select(value, F.greatest("_n", F.lit(0)).alias("added"), F.greatest(-F.col("_n"), F.lit(0)).alias("removed"))


def fingerprint(rows: DataFrame, order: list[str], value: Column, per_bucket: int = 10_000) -> DataFrame:
    """(n, fingerprint) of rows: MD5 of the MD5s of buckets of ordered values, so that no task has to hold them all.

    Buckets are the first hexadecimal digits of the key's MD5, two at least and as many as keep ``per_bucket`` rows in each.
    """
    digits, size = 2, rows.count()
    while 16**digits * per_bucket < size:
        digits += 1
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in order]).cast("binary"))
    keyed = rows.select(*order, F.coalesce(value.cast("string"), F.lit("\\N")).alias("_v"), F.left(key, F.lit(digits)).alias("_b"))
    listed = F.array_sort(F.collect_list(F.struct(*order, "_v")))
    parts = keyed.groupBy("_b").agg(F.md5(F.array_join(F.transform(listed, lambda x: x["_v"]), "|").cast("binary")).alias("_h"), F.count(F.lit(1)).alias("_n"))
    # buckets are summed up by their first two digits before they meet
    upper = parts.groupBy(F.left("_b", F.lit(2)).alias("_b")).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), "|").cast("binary")).alias("_h"), F.sum("_n").alias("_n"))
    return upper.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), "|").cast("binary")).alias("fingerprint"))


def reproducible(fingerprints: DataFrame) -> DataFrame:
    """(reproducible): whether all runs have one fingerprint."""
    return fingerprints.agg((F.count_distinct("fingerprint") <= 1).alias("reproducible"))


def schema_differences(a: DataFrame, b: DataFrame) -> list[tuple[str, str, str]]:
    """(column, type, side) of columns that only one store's table has in that type."""
    left, right = set(shape(a)), set(shape(b))
    return sorted([(*x, "first") for x in left - right] + [(*x, "second") for x in right - left])


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key; rows that tie are ordered by all their columns."""
    newest = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order], *[F.asc(c) for c in rows.columns if c != key and c not in order and not rows.schema[c].dataType.typeName() == "map"])
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def parse_assignments(items: list[str], allowed: dict[str, str]) -> dict[str, object]:
    """Values of key=value items; derived, unknown or repeated keys and values of another type are errors."""
    out: dict[str, object] = {}
    for item in items:
        key, found, raw = item.partition("=")
        key = key.strip()
        if not found or not key:
            raise ValueError(f"not of the form key=value: {item!r}")
        if key in DERIVED:
            raise ValueError(f"{key} follows from the content; load the document again instead")
        if key not in allowed:
            raise ValueError(f"{key} can't be set; allowed: {', '.join(sorted(allowed))}")
        if key in out:
            raise ValueError(f"{key} is set twice")
        if allowed[key] == "boolean":
            if raw.lower() not in _WORDS:
                raise ValueError(f"{key} is true or false, not {raw!r}")
            out[key] = _WORDS[raw.lower()]
        else:
            out[key] = int(raw) if allowed[key] == "int" else raw
        if key == "content_status" and raw not in CONTENT_STATUSES:
            raise ValueError(f"content_status is one of {', '.join(CONTENT_STATUSES)}")
    return out


def corrected(rows: DataFrame, match: Column, items: list[str], allowed: dict[str, str] = CHUNK_FIELDS) -> DataFrame:
    """``rows`` with the assignments applied where ``match`` holds; every other column stays as it is."""
    values = parse_assignments(items, allowed)
    hit = F.coalesce(match, F.lit(False))
    return rows.withColumns({c: F.when(hit, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def resolve(documents: DataFrame, name: str) -> str:
    """The id of the one live document of that file or original name; none or several are an error."""
    found = documents.where(~F.col("is_deleted") & ((F.col("filename") == name) | (F.col("original_name") == name))).select("id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} document is called {name!r}")
    return found[0]["id"]


def unchanged(new_chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks whose content some stored chunk has: they need no new embedding."""
    return new_chunks.join(stored.select("content_hash").distinct(), "content_hash", "left_semi")


def unlanded(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question_id, span) that no chunk of the expected source has: with any, figures aren't to be reported.

    Questions are few beside chunks: the spans of a source travel as one list to its chunks, which say which of them they hold.
    """
    asked = questions.select("question_id", "source", F.explode("spans").alias("span"))
    wanted = asked.groupBy("source").agg(F.collect_set("span").alias("spans"))
    there = chunks.select(F.col("source_file").alias("source"), "content").join(wanted, "source")
    held = there.select("source", F.explode(F.filter("spans", lambda s: F.contains(F.col("content"), s))).alias("span")).distinct()
    return asked.join(held, ["source", "span"], "left_anti").select("question_id", "span")
