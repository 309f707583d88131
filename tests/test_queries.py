"""Every query that has SQL gives the rows of the SQL; every query runs."""

import math
import os

import duckdb
import pytest

from scriptoria.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


def ordered(rows, columns):
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, db, data, name):
    df = registry.QUERIES[name](spark, data)
    r = db.sql(registry.ORACLE[name])
    assert sorted(df.columns) == sorted(r.columns)
    assert ordered(df.collect(), df.columns) == ordered(r.fetchall(), r.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 5


def test_distinct_context_moves_no_text(spark, data):
    """Digests are made below the join of hits and texts."""
    plan = registry.QUERIES["distinct_context"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("Join Inner, (doc#") < plan.find("sha2(")
