"""Scores by round, early stopping, rows set aside, search, and curves within keys."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import core, drift, models, optimize, stats
from riskweave.plans import stages


def brute_auc(scores, labels):
    """Share of pairs in order, ties half; null where a class is missing."""
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ks(scores, labels):
    pos, neg = np.sort([s for s, y in zip(scores, labels) if y]), np.sort([s for s, y in zip(scores, labels) if not y])
    if not len(pos) or not len(neg):
        return None
    at = np.unique(np.concatenate([pos, neg]))
    return float(np.max(np.abs(np.searchsorted(pos, at, "right") / len(pos) - np.searchsorted(neg, at, "right") / len(neg))))


@pytest.fixture(scope="module")
def keyed(spark):
    """A key with most rows, a null key, a key of one class and one row alone."""
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else (None if i % 20 else "rare"), round(float(rng.normal()), 1 if i % 3 else 3) if i % 17 else None, float(rng.integers(-999, 3)) if i % 5 else -999.0, int(rng.random() < 0.4), int(rng.random() < 0.1)) for i in range(1500)]
    rows += [("one", float(i), 1.0, 1, 1) for i in range(5)] + [("alone", 1.0, None, 0, 1)]
    return rows, spark.createDataFrame(rows, "part string, a double, b double, y int, part_of int").repartition(6)


def test_running_sums_within_keys(keyed):
    rows, df = keyed
    counted = df.where("a is not null").groupBy("part", "a").agg(F.count("a").alias("n"), F.sum("y").alias("cuts"))
    got = core.cumulate_within(counted, ["part"], "a", {"cn": "n", "before": "cuts"}, parts=8)
    assert sorted(got.columns) == ["a", "before", "cn", "cuts", "n", "part"]
    for r in got.collect():
        mine = [x for x in rows if x[0] == r["part"] and x[1] is not None and x[1] <= r["a"]]
        assert (r["cn"], r["before"]) == (len(mine), sum(x[3] for x in mine))


def test_curves_within_keys(keyed):
    rows, df = keyed
    got = {r["part"]: r for r in stats.curve_within(df, ["part"], "a", "y").collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        x = [(a, y) for p, a, _, y, _ in rows if p == k and a is not None]
        want = brute_auc(*zip(*x)), brute_ks(*zip(*x))
        assert (r["auc"], r["ks"]) == (pytest.approx(want[0]), pytest.approx(want[1])) if want[0] is not None else (r["auc"] is None and r["ks"] is None)
    whole = stats.curve_within(df, [], "a", "y").collect()
    assert len(whole) == 1 and whole[0]["auc"] == pytest.approx(stats.auc(df, "a", "y").first()[0])


def test_evaluation_of_all_features_labels_and_groups_in_one_plan(spark, keyed):
    rows, df = keyed
    got = {(r["part"], r["label"], r["feature"]): r for r in stats.feature_evaluation(df, ["a", "b"], ["y", "part_of"], "part", bins=5).collect()}
    assert len(got) == len({r[0] for r in rows}) * 4
    for (k, label, feature), r in got.items():
        x = [(row[1 if feature == "a" else 2], row[3 if label == "y" else 4]) for row in rows if row[0] == k]
        filled = brute_auc([-999.0 if v is None else v for v, _ in x], [y for _, y in x])
        assert r["auc"] == (None if filled is None else pytest.approx(max(filled, 1 - filled)))
        there = [(v, y) for v, y in x if v is not None]
        want = brute_ks(*zip(*there)) if there else None
        assert r["ks"] == (None if want is None else pytest.approx(want))
    jobs = lambda: spark.sparkContext.statusTracker().getJobIdsForGroup("count")
    spark.sparkContext.setJobGroup("count", "")
    stats.feature_evaluation(df, ["a"], "y", "part").collect()
    few = len(jobs())
    stats.feature_evaluation(df, ["a", "b", "part_of"], ["y", "part_of"], "part").collect()
    assert len(jobs()) - few <= few + 2  # no jobs for each column, label or group
    spark.sparkContext.setJobGroup("", "")


def test_distances_of_all_columns_at_once(spark, keyed):
    rows, df = keyed
    a, b = df.where("part = 'hot'"), df.where("part is null or part = 'rare'")
    got = {r["feature"]: r["ks"] for r in drift.ks_two_sample(a, b, "a", "b").collect()}
    for i, c in ((1, "a"), (2, "b")):
        x = [(r[i], r[0] == "hot") for r in rows if r[0] in ("hot", "rare", None) and r[i] is not None]
        assert got[c] == pytest.approx(brute_ks(*zip(*x)))
    tests = {r["feature"]: r for r in drift.consistency_tests(a, b, ["a", "b"]).collect()}
    assert tests["a"]["ks"] == round(got["a"], 4) and 0 <= tests["a"]["ks_p"] <= 1


@pytest.fixture(scope="module")
def noisy(spark):
    """A label that two columns tell, with much noise: trees soon learn the noise of what they see."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        a, b, c, d = rng.normal(size=4)
        rows.append((i, float(a), float(b), float(c), float(d), int(rng.random() < 1 / (1 + math.exp(-1.2 * a - 0.8 * b)))))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int").repartition(3).persist()


COLUMNS = ["a", "b", "c", "d"]
BOOST = {"n_estimators": 12, "max_depth": 4, "learning_rate": 0.6, "random_state": 1}


def test_margins_by_round_are_those_of_the_model(noisy):
    x = models.assemble(noisy, COLUMNS).withColumn("leaf", F.lit("own"))
    m = models.make_estimator("GBTClassifier", BOOST, label="y").fit(x)
    got = models.staged_margins(m, x)
    assert got.columns == [*x.columns, "margins"] and {r["leaf"] for r in got.select("leaf").distinct().collect()} == {"own"}
    last = {r["id"]: r["margins"] for r in got.select("id", "margins").collect()}
    assert {len(v) for v in last.values()} == {12}
    scored = m.transform(x)
    for r in scored.select("id", models.probability(scored).alias("p")).collect():
        assert 1 / (1 + math.exp(-2 * last[r["id"]][-1])) == pytest.approx(r["p"])
    few = models.make_estimator("GBTClassifier", BOOST | {"n_estimators": 5}, label="y").fit(x).transform(x)
    for r in few.select("id", models.probability(few).alias("p")).collect():
        assert 1 / (1 + math.exp(-2 * last[r["id"]][4])) == pytest.approx(r["p"])  # an ensemble cut short is that of fewer rounds
    auc = {r["round"]: r["auc"] for r in models.staged_auc(got, "y").collect()}
    y = {r["id"]: r["y"] for r in noisy.collect()}
    for r in (0, 6, 11):
        assert auc[r] == pytest.approx(brute_auc([last[i][r] for i in y], list(y.values())))


def test_the_best_round():
    assert models.best_round([0.6, 0.7, 0.69, 0.68, 0.9], 2) == 1
    assert models.best_round([0.6, 0.7, 0.69, 0.68, 0.9], 3) == 4
    assert models.best_round([0.6, 0.7, 0.7, 0.7], None) == 1
    assert models.best_round([None, 0.5], 5) == 1 and models.best_round([None, None], 1) == 0


def test_early_stopping_and_refit(noisy):
    t = models.ModelTrainer("XGBClassifier", BOOST, folds=3, seed=3, early_stopping_rounds=4, report=True).fit(noisy, "y", "id", COLUMNS)
    assert [models.best_round(a, 4) for a in t.staged] == t.best_rounds and min(t.best_rounds) < 8  # AUC peaks early
    assert t.rounds == sum(t.best_rounds) // 3 + 1 == t.model.getNumTrees
    assert t.fold_auc == pytest.approx([a[r] for a, r in zip(t.staged, t.best_rounds)])
    scores = {r["id"]: (r["__fold"], r["y_pred"], r["y_true"]) for r in t.out_of_fold.collect()}
    assert len(scores) == 900
    for k in range(3):
        mine = [s for s in scores.values() if s[0] == k]
        assert t.fold_auc[k] == pytest.approx(brute_auc([s[1] for s in mine], [s[2] for s in mine]))
    assert all(m["train_auc"] > m["val_auc"] for m in t.fold_metrics) and set(t.summary()) == {"train_auc", "val_auc"}
    plain = models.ModelTrainer("XGBClassifier", BOOST, folds=3, seed=3).fit(noisy, "y", "id", COLUMNS)
    assert sum(t.fold_auc) > sum(plain.fold_auc) and plain.model.getNumTrees == 12 and plain.rounds is None
    t.close()
    with pytest.raises(ValueError):
        models.ModelTrainer("LogisticRegression", early_stopping_rounds=3).fit(noisy, "y", "id", COLUMNS)


def test_rows_set_aside(noisy):
    t = models.ModelTrainer("LogisticRegression", folds=2, test_size=0.25, report=True).fit(noisy, "y", "id", COLUMNS)
    aside = {r["id"]: r for r in t.holdout.collect()}
    assert len(aside) == 225 and not aside.keys() & {r["id"] for r in t.out_of_fold.collect()}
    assert [set(m) for m in t.fold_metrics] == [{"fold", "train_auc", "val_auc", "test_auc"}] * 2
    assert abs(t.fold_metrics[0]["test_auc"] - brute_auc([r["y_pred"] for r in aside.values()], [r["y_true"] for r in aside.values()])) < 0.05
    alone = models.ModelTrainer("GBTClassifier", BOOST, folds=0, test_size=0.3, early_stopping_rounds=3).fit(noisy, "y", "id", COLUMNS)
    assert alone.rounds == alone.best_rounds[0] + 1 == alone.model.getNumTrees and alone.fold_auc == []
    assert alone.out_of_fold.count() == alone.holdout.count() == 270
    with pytest.raises(ValueError):
        models.ModelTrainer(folds=0).fit(noisy, "y", "id", COLUMNS)


def test_the_trainer_stage_stops_early(spark, noisy, tmp_path):
    noisy.write.parquet(f"{tmp_path}/train")
    st = {"method": "XGBClassifier", "params": BOOST | {"early_stopping_rounds": 3, "eval_metric": "auc"}, "folds": 2, "test_size": 0.2}
    got = json.loads(stages.trainer_ui(spark, {"ds": {"train": f"{tmp_path}/train", "label": "y", "id": "id"}, "out": {"dst": f"{tmp_path}/out"}, "st": st}))
    assert got["code"] == 1, got["msg"]
    report = got["result"]["report"]
    assert report["rounds"] == sum(report["best_rounds"]) // 2 + 1 and 0.5 < report["holdout"]["auc"] < 1 and "test_auc" in report["summary"]


def bumps(p):
    return -((p["x"] - 0.73) ** 2) - ((p["y"] - 2.4) / 6) ** 2 + 0.1 * math.cos(9 * p["x"]) - abs(p["k"] - 7) / 40


SPACE = {"x": (0.0, 1.0), "y": (0.5, 6.5), "k": (1, 20)}


def test_search_by_a_gaussian_process_beats_the_shrinking_one():
    gained = [optimize.maximise(bumps, SPACE, 24, seed, "gp")[0]["target"] - optimize.maximise(bumps, SPACE, 24, seed, "shrink")[0]["target"] for seed in range(6)]
    assert min(gained) > -0.01 and sum(g > 0 for g in gained) >= 5
    a, b = (optimize.maximise(bumps, SPACE, 14, 3, batch=n) for n in (3, 3))
    assert a == b and len(a[1]) == 14
    for trial in a[1]:
        assert set(trial) == {"params", "target"} and isinstance(trial["params"]["k"], int) and 1 <= trial["params"]["k"] <= 20
        assert 0 <= trial["params"]["x"] <= 1 and 0.5 <= trial["params"]["y"] <= 6.5
    assert a[0] == max(a[1], key=lambda t: t["target"])


def test_the_process_goes_through_its_points():
    rng = np.random.default_rng(1)
    x = rng.random((12, 2))
    y = np.sin(5 * x[:, 0]) + x[:, 1]
    gp = optimize.GaussianProcess().fit(x, y)
    mean, deviation = gp.predict(x)
    assert np.allclose(mean, y, atol=1e-2) and deviation.max() < 0.02
    assert gp.predict(np.array([[9.0, 9.0]]))[1][0] > 0.5 * gp.spread
    flat = optimize.GaussianProcess().fit(x, np.ones(12))
    assert np.allclose(flat.predict(x)[0], 1)
    assert optimize.maximise(lambda p: None, {"x": (0.0, 1.0)}, 5)[0]["target"] == 0.0
    with pytest.raises(ValueError):
        optimize.maximise(bumps, SPACE, 3, strategy="other")


def test_search_trains_side_by_side(noisy):
    best, trials = models.search(noisy, COLUMNS, "y", "id", "LogisticRegression", {"regParam": (0.0, 0.9)}, trials=4, folds=2, batch=2)
    assert len(trials) == 4 and best["target"] == max(t["target"] for t in trials) > 0.7
    one, _ = models.search(noisy, COLUMNS, "y", "id", "LogisticRegression", {"regParam": (0.0, 0.9)}, trials=2, folds=1, strategy="shrink")
    assert one["target"] > 0.6
