"""What several jobs read of a table is worked out once, so that its joins are not broadcast again for each job."""

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from riskweave.operators import binning, core, rules, split, stats


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(core, "SORTED_VALUES", 60)
    monkeypatch.setattr(core, "PARTS", 8)


@pytest.fixture
def counted(spark):
    """A table of 900 rows and the number of its rows worked out so far."""
    rng, met = np.random.default_rng(3), spark.sparkContext.accumulator(0)
    rows = [(i, int(i % 4 == 0), float(rng.integers(0, 2) * 500 + rng.normal()), float(rng.normal()), "uv"[i % 2]) for i in range(900)]

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    kinds = "id long, y int, a double, b double, part string"
    return spark.createDataFrame(rows, kinds).mapInArrow(count, kinds), met, rows


def test_monotonic_bins_work_their_rows_out_once(spark, narrow, counted):
    df, met, rows = counted
    cuts = binning.monotonic(df, ["a", "b"], "y")
    assert met.value == 900
    plain = spark.createDataFrame(rows, df.schema)
    assert cuts == binning.monotonic(plain, ["a", "b"], "y")


def test_quantiles_work_their_rows_out_once(spark, narrow, counted):
    df, met, rows = counted
    got = core.exact_quantiles(df, {"a": [0.1, 0.5], "b": [0.9]})
    assert met.value == 900
    assert np.allclose([*got["a"], *got["b"]], [*np.quantile([r[2] for r in rows], [0.1, 0.5]), np.quantile([r[3] for r in rows], 0.9)])


def test_curves_work_their_rows_out_once_for_edges_and_levels(spark, narrow, counted):
    df, met, rows = counted
    out = stats.contrast_curves(df, ["a", "part"], "y", "part", base="u")
    assert met.value == 900
    assert sum(r["n"] for r in out.collect()) == 2 * len(rows)


def test_latest_rows_are_found_in_rows_worked_out_once(spark, narrow, counted):
    df, met, rows = counted
    marked = split.latest(df, 0.25, "b", ["id"])
    assert met.value == 900
    want = {r[0] for r in sorted(rows, key=lambda r: (-r[3], r[0]))[:225]}
    assert {r["id"] for r in marked.where("is_test").collect()} == want


def test_rules_are_fitted_on_rows_worked_out_once(spark, narrow, counted):
    df, met, _ = counted
    rules.RuleFit(trees=2, depth=2).fit(df, "y", ["a", "b"])
    assert met.value == 900


@pytest.mark.parametrize("n", [1, 2, 3, 8, 63])
def test_parts_by_halving(spark, n):
    cuts = [float(3 * i) for i in range(n)]
    rows = spark.createDataFrame([(float(i),) for i in range(-2, 3 * n + 2)], "v double")
    got = rows.select("v", core._part(F.col("v"), cuts, F.lit).alias("p")).collect()
    assert all(r["p"] == sum(c < r["v"] for c in cuts) for r in got)


def test_held_tables_are_let_go_unless_kept_before(spark):
    df = spark.range(10).selectExpr("id + 1 AS v")
    with pytest.raises(ZeroDivisionError), core.held(df):
        assert df.storageLevel != StorageLevel.NONE
        1 / 0  # noqa: B018
    assert df.storageLevel == StorageLevel.NONE
    df.persist()
    with core.held(df):
        pass
    assert df.storageLevel != StorageLevel.NONE
    df.unpersist()
