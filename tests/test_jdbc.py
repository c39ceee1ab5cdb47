"""Reads by JDBC, from the Derby that comes with Spark: one task or many, the same rows."""

import datetime as dt

import pytest

from riskweave.sources import io


@pytest.fixture(scope="module")
def derby(spark):
    options = {"url": "jdbc:derby:memory:riskweave", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, float(i % 9), f"t{i % 4}", dt.date(2024, 1, 1) + dt.timedelta(days=i % 90)) for i in range(1000)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, g string, d date")
    df.coalesce(1).write.format("jdbc").options(**options | {"url": options["url"] + ";create=true"}, dbtable="loans").save()
    return options, sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_one_task_without_a_column(spark, derby):
    options, rows = derby
    df = io.execute(spark, "SELECT * FROM loans", "jdbc", **options)
    assert df.rdd.getNumPartitions() == 1 and got(df) == rows


@pytest.mark.parametrize("column,bounds", [('"id"', None), ('"id"', (200, 300)), ('"d"', None)])
def test_many_tasks_read_every_row_once(spark, derby, column, bounds):
    options, rows = derby
    df = io.execute(spark, 'SELECT "id", "x", "g", "d" FROM loans', "jdbc", partition_on=column, partitions=5, bounds=bounds, **options)
    assert df.rdd.getNumPartitions() == 5 and got(df) == rows


def test_predicates_divide_the_rows(spark, derby):
    options, rows = derby
    df = io.execute(spark, "SELECT * FROM loans", "jdbc", predicates=['"x" < 3', '"x" >= 3', '"x" IS NULL'], **options)
    assert df.rdd.getNumPartitions() == 3 and got(df) == rows
    with pytest.raises(ValueError):
        io.execute(spark, "SELECT * FROM loans", "jdbc", partition_on='"id"', predicates=["1 = 1"], **options)


def test_filters_and_columns_reach_the_engine(spark, derby):
    options, _ = derby
    df = io.execute(spark, "SELECT * FROM loans", "jdbc", columns=["a", "b", "c", "e"], partition_on='"id"', partitions=4, **options).where("a >= 990").select("b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,990)" in plan and df.count() == 10
    assert "ReadSchema: struct<x:double>" in plan


def test_tables_without_steps(spark, derby):
    options, _ = derby
    none = io.execute(spark, "SELECT * FROM loans WHERE 1 = 0", "jdbc", partition_on='"id"', **options)
    one = io.execute(spark, 'SELECT * FROM loans WHERE "id" = 7', "jdbc", partition_on='"id"', **options)
    assert none.count() == 0 and [r["id"] for r in one.collect()] == [7]
