"""Column functions for hashes, stamps and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a cleaning layer that doesn't exist yet.
NO_CLEANING = "none"
#: Fixed value: the namespace for URLs of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stamps(content: Column, parser: str, chunker: str, model: str, dimension: int, cleaning: str = NO_CLEANING) -> list[Column]:
    """The version columns of a document."""
    return [
        F.sha2(content, 256).alias("source_hash"), F.lit(parser).alias("parser_version"), F.lit(cleaning).alias("clean_rules_version"), F.lit(chunker).alias("chunker_version"), F.lit(f"{model}:{dimension}").alias("embedding_model"),
    ]


def cache_key(kb: Column, **parts: Column) -> Column:
    """A key that differs whenever the store, the permissions, the question or a version differs."""
    return F.concat(F.lit("answer:"), kb, F.lit(":"), F.sha2(F.array_join(F.array(*[F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit("\\N"))) for k, v in sorted(parts.items())]), "\n"), 256))


def url_id(name: Column) -> Column:
    """The version-5 UUID of a name in the namespace of URLs."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
