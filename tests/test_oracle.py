"""Every registered query with SQL gives the same rows as DuckDB on the smallest folder."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import FOLDER

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SLOW = {"ml_score_demand", "ml_score_lots", "ml_three_targets"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def table(rows, names):
    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = [dict(zip(columns, row)) for row in result.fetchall()]
    names = sorted(columns)
    assert sorted(df.columns) == names
    assert table([r.asDict() for r in df.collect()], names) == table(expected, names)


def test_every_query_is_callable_and_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "reason" in df.columns
