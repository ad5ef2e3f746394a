"""Sharding by jump consistent hashing, in SQL functions only.

The generator of Lamping and Veach (2014) needs a product modulo 2**64; Spark's
integers refuse to overflow, so the product is taken in limbs of 16 bits that
stay below 2**63. No ring table exists: the key and the shard count decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, without

_FACTOR = 2862933555777941757
_MASK = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * _FACTOR + 1 modulo 2**64, on the upper and lower 32 bits of key."""
    upper, c1, c0 = _FACTOR >> 32, (_FACTOR >> 16) & 0xFFFF, _FACTOR & 0xFFFF
    t0 = lo * c0 + 1
    t1 = lo * c1 + F.shiftright(t0, 16)
    low = F.shiftleft(t1.bitwiseAND(0xFFFF), 16).bitwiseOR(t0.bitwiseAND(0xFFFF))
    # Only the lower 32 bits of each product count here.
    high = F.shiftright(t1, 16) + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(0xFFFF), 16) + (lo * upper).bitwiseAND(_MASK)
    return high.bitwiseAND(_MASK), low


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among ``shards``, by jump consistent hashing.

    The loop is a fold that stops changing once the next jump passes the last
    shard. A jump always moves at least one shard on, so ``shards`` steps are
    always enough; as about ln(shards) are expected, a short fold comes first
    and only keys that it doesn't settle run the long one. A null key gives null.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_MASK).alias("lo"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j")
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        b = s["j"]
        # the upper 31 bits of the key, plus 1, divide 2**31
        j = F.floor((b + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), b.alias("b"), j.cast("bigint").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def fold(steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)

    short = min(shards, 8 + 4 * math.ceil(math.log(shards + 1)))
    out = fold(short)
    result = out["b"]
    if short < shards:
        result = F.when(out["j"] >= shards, out["b"]).otherwise(fold(shards)["b"])
    return result.cast("int")


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 16384) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    size is the text's bytes in UTF-8 plus 16. shard follows from the key and the
    shard count alone (a null key counts as 0, one that is no integer by a hash of it as
    a string), grown_shard is the shard with one more. slot numbers the rows of a shard from 0 without gaps.

    Slots are dealt by buckets of about ``rows_per_bucket`` rows: each bucket of a
    shard is numbered on its own, and the bucket's first slot is a running sum over
    the small table of bucket sizes, so no task ever holds a whole shard. A null
    text has size 16 and the CRC of nothing, like an empty one. Rows that agree in
    key and text get adjacent slots in any order. An input column that is called
    like one of the new ones is replaced; an empty table gives an empty result.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    buckets = 2 * (docs.count() // (2 * rows_per_bucket)) + 1
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    body, k = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(key).cast("bigint") if whole else F.xxhash64(F.col(key).cast("string")), F.lit(0).cast("bigint"))
    kept = without(docs.columns, *new)
    bucket, n, first, row = fresh([*docs.columns, *new], "_bucket", "_n", "_first", "_row")
    rows = docs.select(
        *kept,
        (F.octet_length(body).cast("bigint") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(k, shards).alias("shard"),
        jump_hash(k, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(k, body), F.lit(buckets)).cast("int").alias(bucket),
    )
    counts = rows.groupBy("shard", bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("shard", bucket).orderBy(F.col(key), "text_crc32", "size")
    numbered = rows.withColumn(row, F.row_number().over(within)).join(firsts, ["shard", bucket])
    return numbered.select(*kept, "size", "text_crc32", "law", "shard", (F.col(first) + F.col(row) - 1).cast("bigint").alias("slot"), "grown_shard")


def op8_jump_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document dealt into 40 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs, 40).drop("text")
