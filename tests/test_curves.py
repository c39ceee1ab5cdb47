"""Curves of columns side by side, bands of scores and totals of reports, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import stats


def rows_of(df):
    return {(r["part"], r["feature"], r["bin"]): (r["n"], round(r["rate"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        part = ["train", "test", None][i % 3]
        v = None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(rng.integers(0, 60)) + (40 if part == "test" else 0)
        out.append((i, part, v, "abc"[i % 3] if i % 4 else None, int(i % 5 == 0) if i % 7 else None, f"k{i}", None))
    names = "id long, kind string, value double, level string, y int, many string, bin double"
    return out, spark.createDataFrame(out, names)


def expected(rows, base):
    values = [r[2] for r in rows if (base is None or r[1] == base) and r[2] is not None and r[2] == r[2]]
    edges = sorted(set(np.quantile(values, [i / 10 for i in range(1, 10)])))
    met, kinds = {}, {r[1] for r in rows}
    for r in rows:
        there = r[2] is not None and r[2] == r[2]
        for f, b in (("value", str(1 + sum(r[2] > e for e in edges)) if there else None), ("level", r[3]), ("many", r[5]), ("bin", None)):
            met.setdefault((r[1], f, b), []).append(r[4])
    bins = {("value", str(i)) for i in range(1, len(edges) + 2)} | {(f, b) for _, f, b in met if f != "many"}
    out = {(k, f, b): (0, 0.0) for k in kinds for f, b in bins}
    for at, ys in met.items():
        known = [y for y in ys if y is not None]
        out[at] = (len(ys), round(sum(known) / len(known), 9) if known else 0.0)
    return out


@pytest.mark.parametrize("base", ["train", None])
def test_contrast_curves(parts, base):
    rows, df = parts
    got = stats.contrast_curves(df, ["value", "level", "many", "bin"], "y", "kind", base=base).withColumnRenamed("kind", "part")
    assert got.columns == ["part", "feature", "bin", "n", "rate"]
    assert rows_of(got) == expected(rows, base)


def test_contrast_curves_at_the_edges(spark, parts):
    rows, df = parts
    with pytest.raises(ValueError, match="no row has 'later'"):
        stats.contrast_curves(df, ["value"], "y", "kind", base="later")
    assert stats.contrast_curves(df.limit(0), ["value", "level"], "y", "kind").count() == 0
    assert stats.contrast_curves(df, [], "y", "kind").count() == 0
    got = stats.contrast_curves(df, ["value"], "y", "kind", base="train")
    assert got.columns[0] == "kind" and got.where("kind = 'test'").where("n = 0").count() > 0  # test lies above the first edges of train
    named = df.withColumnsRenamed({"kind": "part", "value": "n"}).withColumn("feature", F.lit("x"))
    assert rows_of(stats.contrast_curves(named, ["n", "feature"], "y", "part", base="train"))[("train", "feature", "x")][0] == 200


def test_feature_curve_keeps_null_keys_together(parts):
    _, df = parts
    known = df.where("value is not null and not isnan(value)")
    got = stats.feature_curve(known, "value", "y", "kind").collect()
    assert len(got) == len({(r["kind"], r["bin"]) for r in got}) == 30 and sum(r["n"] for r in got) == known.count()


def test_score_edges_take_the_most_bands_that_have_rows(spark):
    tied = spark.createDataFrame([(float(v),) for v in [1] * 70 + [2] * 12 + [3] * 10 + [4] * 8], "s double")
    edges = stats.score_edges(tied, "s")
    for q in range(10, 1, -1):  # the plain way
        e = list(np.quantile([1] * 70 + [2] * 12 + [3] * 10 + [4] * 8, [i / q for i in range(1, q)]))
        if len(set(e)) == q - 1 and len({sum(v > x for x in e) for v in (1, 2, 3, 4)}) == q:
            break
    else:
        e = []
    assert np.allclose(edges, e)
    assert stats.score_edges(tied.where("s = 1"), "s") == [] == stats.score_edges(tied.limit(0), "s")
    even = spark.range(100).select(F.col("id").cast("double").alias("s"))
    assert len(stats.score_edges(even, "s")) == 9 and stats.score_edges(even, "s", bands=1) == []


def test_woe_report_totals_within_null_keys(parts):
    _, df = parts
    got = stats.woe_report(df.where("level is not null"), ["level"], "y", "kind").collect()
    for kind in ("train", "test", None):
        mine = [r for r in got if r["kind"] == kind]
        assert mine and abs(sum(r["group_sample_ratio"] for r in mine) - 1) < 1e-12 and len({r["IV"] for r in mine}) == 1
