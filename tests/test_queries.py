"""Every query with SQL against DuckDB at the smallest scale; every other one gives rows."""

import os

import duckdb
import pytest

from riskweave.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def canonical(frame):
    def cell(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v.item() if hasattr(v, "item") else v

    return sorted(repr(tuple(map(cell, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    ours, sql = Q.QUERIES[name](spark, sf).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    assert canonical(ours) == canonical(sql)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL) - {"ripper_rules"}))
def test_gives_rows(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0
