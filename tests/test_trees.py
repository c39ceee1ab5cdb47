"""Trees on one column: grown in a task or by all tasks, the same cuts; forests of random sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import binning, rules


def by_hand(x, y, **how):
    """`tree_cuts` on the counts of all values that are not missing."""
    there = ~np.isnan(x)
    values, at = np.unique(x[there], return_inverse=True)
    pos = np.bincount(at, y[there], len(values))
    return binning.tree_cuts(values, pos, np.bincount(at, minlength=len(values)) - pos, **how)


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.2, np.nan, rng.integers(0, 40, 3000) / 8)  # ties and missing values
    c = np.full(3000, 2.5)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * np.sin(3 * a) - np.nan_to_num(b) / 4))).astype(int)
    rows = [(float(i), float(j), float(k), int(v), 1.0) for i, j, k, v in zip(a, b, c, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, pos double").repartition(6), {"a": a, "b": b, "c": c}, y


@pytest.mark.parametrize("how", [{"bins": 8}, {"bins": 12, "depth": 6}, {"bins": 6, "least": 200}, {"bins": 1}, {"bins": 40, "depth": 9, "least": 20}])
def test_all_tasks_find_the_cuts_of_one(three, how):
    df, columns, y = three
    want = {k: by_hand(x, y, **how) for k, x in columns.items()}
    assert want["c"] == [] and (how["bins"] == 1 or len(want["a"]) > 2)
    assert binning.decision_tree(df, ["a", "b", "c"], "y", **how) == want
    assert binning.decision_tree(df, ["a", "b", "c"], "y", task_values=0, **how) == want
    assert binning.decision_tree(df, ["a", "b", "c"], "y", task_values=100, **how) == want  # a by all, b and c in tasks


def test_no_rows_and_no_values(spark, three):
    df, _, _ = three
    assert binning.decision_tree(df.limit(0), ["a", "b"], "y", task_values=0) == {"a": [], "b": []}
    empty = df.withColumn("n", F.lit(None).cast("double"))
    assert binning.decision_tree(empty, ["n"], "y", task_values=0) == {"n": []}


def test_a_million_values(spark):
    n = 1_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n / 1000.0).alias("x")).withColumn("y", (F.pmod(F.xxhash64("x"), F.lit(1000)) < 300 + 250 * F.sin(F.col("x") / 90)).cast("int"))
    rows = df.toPandas()
    how = {"bins": 10, "depth": 5, "least": 1000}
    want = by_hand(rows["x"].to_numpy(), rows["y"].to_numpy(), **how)
    got = binning.decision_tree(df, ["x"], "y", **how)
    assert len(want) == 9 and got == {"x": want}


def test_sizes_follow_the_law():
    sizes = np.array(rules.tree_sizes(20_000, 4))
    want = [np.exp(-k / 2) - np.exp(-(k + 1) / 2) for k in range(6)]  # P(2 + floor(e) = 2 + k), e of mean 2
    assert sizes.min() == 2 and np.allclose([(sizes == 2 + k).mean() for k in range(6)], want, atol=0.01)
    filled = rules.tree_sizes(None, 4, leaves=500)
    assert sum(filled) >= 500 > sum(filled[:-1]) and rules.tree_sizes(5, 2) == [2] * 5


@pytest.fixture(scope="module")
def rare(spark):
    """A label of 4 % positives in two corners: no leaf of a classifier would name them."""
    rng = np.random.default_rng(3)
    x, z = rng.random(4000), rng.random(4000)
    y = (rng.random(4000) < np.where((x > 0.8) & (z < 0.3), 0.3, np.where(x < 0.1, 0.15, 0.01))).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, z, y, strict=True)], "x double, z double, y int").repartition(3)


def test_trees_have_their_leaves_best_splits_first(rare):
    sizes = [2, 3, 5, 9, 1]
    forest = rules.sized_forest(rare, ["x", "z"], "y", sizes, depth=5)
    assert [len(r) for r in forest] == [2 * (s - 1) for s in sizes]
    rows = rare.toPandas()
    for found in forest:
        part = {r: rows.eval(r.replace("`", "").replace(" AND ", " and ")) for r in found}
        for left, right in zip(found[::2], found[1::2]):  # the two sides of a split share the way to it and divide its rows
            above = left.rpartition(" AND ")[0]
            assert above == right.rpartition(" AND ")[0]
            whole = part[above] if above else part[left] | part[right]
            assert (part[left] ^ part[right])[whole].all() and not (part[left] & part[right]).any()

    def won(left, right):
        gini = lambda at: 2 * rows.y[at].sum() * (1 - rows.y[at]).sum() / max(at.sum(), 1)
        a, b = (rows.eval(r.replace("`", "").replace(" AND ", " and ")) for r in (left, right))
        return gini(a | b) - gini(a) - gini(b)

    deep = forest[3]
    gains = [(won(a, b), a.rpartition(" AND ")[0]) for a, b in zip(deep[::2], deep[1::2])]
    for i, (g, _) in enumerate(gains):  # what was open earlier and split later was not better
        for later, way in gains[i + 1 :]:
            if not way or way in deep[: 2 * i]:
                assert later <= g + 1e-9


def test_rulefit_of_random_sizes(rare):
    fit = rules.RuleFit(max_rules=24, reg=0.001).fit(rare, "y", ["x", "z"])
    assert 24 <= sum(fit.sizes) and 8 < len(fit.rules) <= 2 * sum(s - 1 for s in fit.sizes)
    first = fit.get_rules()[0]
    assert first["type"] == "rule" and first["coef"] != 0 and 0 < first["support"] < 1
    scored = fit.transform(rare.select("x", "z", "y")).toPandas()
    corner = (scored.x > 0.8) & (scored.z < 0.3)
    assert scored.columns.tolist() == ["x", "z", "y", "y_pred"] and scored.y_pred[corner].mean() > 5 * scored.y_pred[(scored.x > 0.2) & (scored.x < 0.7)].mean()
    again = rules.sized_forest(rare, ["x", "z"], "y", fit.sizes)
    assert list(dict.fromkeys(r for tree in again for r in tree)) == fit.rules
    assert rules.RuleFit(random_sizes=False, trees=2, depth=2).fit(rare.withColumn("y", (F.col("x") > 0.5).cast("int")), "y", ["x", "z"]).rules
