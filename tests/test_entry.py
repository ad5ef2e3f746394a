"""The driver contract: names, columns, and answers equal to those of DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def test_every_oracle_belongs_to_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.queries()) > 70


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    answer = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    wanted = sorted(tuple(plain(row[columns.index(c)]) for c in names) for row in answer.fetchall())
    assert sorted(tuple(plain(row[c]) for c in names) for row in df.collect()) == wanted
