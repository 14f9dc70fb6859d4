"""Every registered query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import decimal

import duckdb
import pytest

from tagloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    want = con.sql(plans.ORACLE_SQL[name])
    columns = sorted(want.columns)
    found = plans.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    a = sorted(repr(tuple(plain(v) for v in r)) for r in found.select(*columns).collect())
    b = sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in columns)) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
