import pytest
from pyspark.sql import functions as F

from vellum.operators import models as MD
from vellum.operators import reports as RP
from vellum.operators.metrics import truncated_index
from vellum.sources.parsers import decoded
from vellum.sources.store import ConcurrentChange, Table


def test_hash_embedder_is_deterministic_and_batched(spark):
    calls = []

    class Wrong(MD.HashEmbedder):
        def embed(self, texts):
            return [v[:-1] for v in super().embed(texts)]

    one = MD.HashEmbedder(8)
    assert one.embed(["a b", ""]) == MD.HashEmbedder(8).embed(["a b", ""]) and one.embed([""]) == [[0.0] * 8]
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(40, None)], "id long, text string")
    got = MD.with_embeddings(rows, "text", one, batch=7).collect()
    assert len(got) == 41 and all(len(r["embedding"]) == 8 for r in got) and not calls
    with pytest.raises(Exception, match="dimension"):
        MD.with_embeddings(rows, "text", Wrong(8)).collect()


def test_replies_after_failures(spark):
    def fails(prompt):
        raise TimeoutError("no answer")

    rows = spark.createDataFrame([(1, "q")], "query_id long, question string")
    (r,) = MD.with_replies(rows, F.col("question"), fails, retries=2).collect()
    assert r["reply"]["text"] is None and "TimeoutError" in r["reply"]["error"]
    assert [tuple(r) for r in MD.expanded_queries(rows, fails).collect()] == [(1, 0, "q")]


@pytest.mark.parametrize("n", [1, 2, 9, 10, 4000])
def test_places_of_percentiles(spark, n):
    rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"), F.lit("k").alias("k"))
    for q in (0.0, 0.1, 0.5, 0.9, 0.999):
        (r,) = truncated_index(rows, "v", q, "p", "k").collect()
        assert r["p"] == min(n - 1, int(n * q)), q
        (r,) = truncated_index(rows.drop("k"), "v", q, "p").collect()
        assert r["p"] == min(n - 1, int(n * q))
    (r,) = RP.deciles(rows, "v", "k").collect()
    assert tuple(r)[1:] == (n // 10, n // 2, min(n - 1, int(0.9 * n)))


def test_two_writers(spark, tmp_path):
    table = Table(spark, str(tmp_path), "real", "t", "id", "id long", buckets=2)
    table.upsert(spark.range(3))
    last, parts = table._current()
    table.upsert(spark.range(3, 5))
    with pytest.raises(ConcurrentChange):
        table._switch(parts, last)
    assert sorted(r["id"] for r in table.read().collect()) == [0, 1, 2, 3, 4]


def test_encodings():
    assert decoded("déjà vu, naïve".encode("latin-1")) == "déjà vu, naïve"
    assert decoded("年假按照工龄计算, 每年五天".encode("gb18030")) == "年假按照工龄计算, 每年五天"
    assert decoded("ä".encode("utf-16")) == "ä" and decoded(b"\xef\xbb\xbfabc") == "abc"
    with pytest.raises(ValueError, match="encoding"):
        decoded(b"\x00\x01\xff\x81")
