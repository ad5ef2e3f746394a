import pytest

CLASHES = ["score", "kept", "keep_id", "component_id", "shard", "slot", "size", "law", "rate", "copies", "label", "hash", "n_tokens", "quality_score", "toxicity", "held_out", "fp", "doc", "x", "_row", "_Run", "_n", "_keep", "_first", "_bucket", "_gone", "_p", "_buckets", "_sums", "base", "known", "model", "rare", "_text", "least", "Name", "n", "keys", "bits"]


def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, and ties."""
    long_text = " ".join(f"Word{i % 977}" for i in range(60_000))
    return [(None, "a text without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "twice the same row"), (5, "twice the same row"), (6, "twice the same row"), (7, "é ü ñ 🙂"), (-8, "a negative id")]


@pytest.fixture(scope="session")
def odd(spark):
    """``odd_rows`` with further columns that are called like those that operators add."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, None, None, None, *CLASHES) for i, t in odd_rows()], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
