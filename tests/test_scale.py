"""Exact ranks and splits without one-task steps, with small limits so that every path is taken."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import binning, core, drift, encoders, split, stats


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(core, "SORTED_VALUES", 60)
    monkeypatch.setattr(core, "PARTS", 8)
    monkeypatch.setattr(split, "HASH_RANGES", 8)


def test_quantiles_by_narrowing_are_exact(spark, narrow):
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=700), np.full(900, 0.25), rng.integers(0, 5, 400)])
    b = np.where(rng.random(2000) < 0.1, np.nan, rng.exponential(size=2000))
    rows = [(float(x), None if np.isnan(y) else float(y), None) for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    probs = [0.0, 0.025, 0.1, 0.333, 0.5, 0.75, 0.999, 1.0]
    got = core.exact_quantiles(df, dict.fromkeys("abc", probs))
    assert np.allclose(got["a"], np.quantile(a, probs)) and np.allclose(got["b"], np.nanquantile(b, probs)) and got["c"] == []
    big = spark.createDataFrame([(2**60 + i % 50,) for i in range(500)], "v long")
    assert core.order_statistics(big, {"v": [0, 249, 499, 500]})["v"] == {0: 2**60, 249: 2**60 + 24, 499: 2**60 + 49}


@pytest.mark.parametrize("limit", [60, 250_000])
def test_tied_decimals_keep_their_bins(spark, monkeypatch, limit):
    monkeypatch.setattr(core, "SORTED_VALUES", limit)
    rng = np.random.default_rng(4)
    pool = [round(float(x), 2) for x in rng.uniform(-999, 9999, 60)] + [-440.82]
    values = [pool[i] for i in rng.integers(0, len(pool), 3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    probs = [k / 97 for k in range(98)]
    got = core.exact_quantiles(df, {"v": probs})["v"]
    ranked = sorted(values)
    for p, q in zip(probs, got, strict=True):
        at = p * (len(values) - 1)
        lo, hi = ranked[math.floor(at)], ranked[math.ceil(at)]
        assert q == lo if lo == hi else lo <= q <= hi
    assert all(a <= b for a, b in zip(got, got[1:]))
    edges = sorted(set(binning.quantiles(df, ["v"], [k / 20 for k in range(1, 20)])["v"]))
    bins = {(r["v"], r["b"]) for r in df.select("v", binning.bin_column("v", edges).alias("b")).collect()}
    whole = [q for q in edges if q in pool]
    assert bins == {(v, 1 + sum(v > e for e in edges)) for v in values} and len(whole) > 10


def brute(rows, quota):
    """Ids of the rows of greatest value, null last, ties by id."""
    return {r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:quota]}


@pytest.mark.parametrize("size", [0.0, 0.13, 0.5, 0.93, 1.0])
@pytest.mark.parametrize("ids", [["id"], ["id", "name"]])
def test_latest_rows(spark, narrow, size, ids):
    rng = np.random.default_rng(2)
    rows = [(int(i), None if i % 10 == 0 else float(rng.integers(0, 6)), f"n{i}") for i in rng.permutation(230)]
    df = spark.createDataFrame(rows, "id long, t double, name string")
    marked = split.latest(df, size, "t", ids)
    assert marked.columns == ["id", "t", "name", "is_test"]
    assert {r["id"] for r in marked.where("is_test").collect()} == brute(rows, math.floor(230 * size))
    top = split.cut_off(df, "t", size, ids, keep_weight=False)
    assert {r["id"] for r in top.collect()} == brute(rows, int(230 * size))


def test_greatest_in_groups_and_quotas(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 9 == 0 else float(rng.integers(0, 4)), None if i % 8 == 0 else "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t double, g string")
    got = split.latest_in_group(df, 0.4, "t", "g", ["id"])
    assert got.columns == ["id", "t", "g", "is_test"] and got.count() == 300
    for g in ("a", "b", "c", None):
        mine = [r for r in rows if r[2] == g]
        assert {r["id"] for r in got.where(F.col("is_test") & F.col("g").eqNullSafe(F.lit(g))).collect()} == brute(mine, math.floor(len(mine) * 0.4))
    taken = split.take_newest(df, "g", {"a": 7, "b": 10_000, "z": 5}, "t", ["id"]).collect()
    by = {g: [r for r in rows if r[2] == g] for g in "ab"}
    assert {r["id"] for r in taken} == brute(by["a"], 7) | brute(by["b"], 10_000)


def test_folds_are_stratified_and_fixed(spark, narrow):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 2) for i in range(500)], "id long, y int")
    a, b = ({(r["id"], r["fold"]) for r in split.fold(d, "y", 5, ["id"]).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 500
    per = {(r["y"], r["fold"]): r["count"] for r in split.fold(df, "y", 5, ["id"]).groupBy("y", "fold").count().collect()}
    for y in (0, 1, None):
        n = [per[y, f] for f in range(5)]
        assert max(n) - min(n) <= 1 and sum(n) == df.where(F.col("y").eqNullSafe(F.lit(y))).count()


def test_a_cell_with_the_fill_value_equals_a_null(spark):
    pairs = spark.createDataFrame([(1, -999.0, None, "a", None), (2, None, None, None, "-999"), (3, 1.0, 1.0, "x", "x"), (4, 1.0, 2.0, "x", "y")], "k int, a_v double, b_v double, a_s string, b_s string")
    got = {r["feature"]: r for r in drift.consistency_ratio(pairs, ["v", "s"]).collect()}
    assert (got["v"]["raw"], got["v"]["filled"]) == (0.25, 0.75)
    assert (got["s"]["raw"], got["s"]["filled"]) == (0.25, 0.5)
    assert {r["feature"]: r["filled"] for r in drift.consistency_ratio(pairs, ["v"], None).collect()} == {"v": 0.25}


def test_helper_columns_never_clash(spark):
    names = ["t", "group", "order", "taken", "level", "hash", "range", "cuts", "edge", "last", "__o", "__g", "__t", "__h"]
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], *[f"own {i}"] * len(names)) for i in range(60)], ["id", "v", "g", *names])
    for out in (split.latest(df, 0.3, "v", ["id"]), split.latest_in_group(df, 0.3, "v", "g", ["id"]), split.at_random(df, 0.3, ["id"])):
        assert out.columns == [*df.columns, "is_test"] and out.where("is_test").count() == 18
        assert all(r["order"] == r["__o"] == f"own {r['id']}" for r in out.collect())
    assert split.take_newest(df, "g", {"a": 5}, "v", ["id"]).columns == df.columns
    assert split.sample(df, "g", "v", ["id"], {"a": 1, "b": 1}).columns == df.columns


def test_levels_are_numbered_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(f"k{rng.integers(0, 900)}", None if i % 13 == 0 else "xyz"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string").repartition(5)
    for across in (False, True):
        enc = encoders.LabelEncoder(columns=["a", "b"], across=across).fit(df)
        got = enc.transform(df).distinct().collect()
        a, b = sorted({r[0] for r in rows}), ["x", "y", "z"]
        for r in got:
            assert r["a_label"] == a.index(r["a"]) + 1
            assert r["b_label"] == (0 if r["b"] is None else b.index(r["b"]) + 1 + across * len(a))
    top = {(r["feature"], r["bin"]): r["n"] for r in stats.distribution(df, ["a", "b"], bins=4).collect()}
    count = {v: sum(x[0] == v for x in rows) for v in a}
    best = sorted(a, key=lambda v: (-count[v], v))[:4]
    assert {k[1] for k in top if k[0] == "a"} == {*best, "others+"} and top["a", "others+"] == 3000 - sum(count[v] for v in best)
    assert {k[1] for k in top if k[0] == "b"} == {"x", "y", "z", "missing"}
    shares = encoders.CountEncoder(columns=["b"]).fit(df).transform(df).where("b is null").first()["b_count"]
    assert shares == pytest.approx(sum(x[1] is None for x in rows) / 3000)
