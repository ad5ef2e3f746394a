"""Names, columns and full coverage of the queries of this subpackage."""

import re

import pytest

from vellum.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_language_model": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_jump_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11))
    assert ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op8_jump_sharding"])
def test_native_queries_return_every_document(spark, sf, name, documents):
    got = QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(got.columns) and got.count() == documents.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for view in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{sf}/{view}.parquet')")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    answer = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    wanted = sorted(str([row[names.index(c)] for c in columns]) for row in answer.fetchall())
    assert sorted(str([row[c] for c in columns]) for row in df.collect()) == wanted
