"""Several data sets by key, and what filters say of their columns."""

import json

import pytest

from riskweave.operators import drift, select
from riskweave.plans import persist, stages


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def sets(spark):
    a = spark.createDataFrame([("01", 1.0004, "x|y", 5), ("1", None, None, 6), ("2", 3.0, "z", 7), (None, 9.0, "q", 8)], "id string, Amount double, apps string, more int")
    b = spark.createDataFrame([("01", "1.0", "y|x|x"), ("1", "0", None), ("2", None, "z|w"), (None, "9", "q")], "ID string, sum string, Apps string")
    c = spark.createDataFrame([("2", 3, "z"), ("1", None, "n"), ("01", 1, "x|y"), ("3", 4, "k")], "Id string, AMOUNT long, APPS string")
    return {"a": a, "b": b, "c": c}


def test_three_data_sets_by_key(sets):
    got = drift.compare_all("ID", sets, {"b": {"SUM": "amount"}}, beside={"rest": sets["c"]}, list_columns=["apps"])
    third = 1 / 3
    near = lambda found, want: all(x == pytest.approx(y) if isinstance(y, float) else x == y for r, w in zip(found, want, strict=True) for x, y in zip(r, w, strict=True))
    assert near(rows(got["rates"], "feature", "left", "right"), [
        ("amount", "a", "b", 3, third, 2 * third, third, third, False), ("amount", "a", "c", 3, 2 * third, 1.0, 1.0, 0.0, True), ("amount", "b", "c", 3, third, 2 * third, third, third, False),
        ("apps", "a", "b", 3, third, 2 * third, 2 * third, 0.0, True), ("apps", "a", "c", 3, 2 * third, 2 * third, 2 * third, 0.0, True), ("apps", "b", "c", 3, third, third, third, 0.0, True),
    ])
    assert rows(got["differences"], "key", "feature") == [("1", "amount", None, "0.0", None), ("1", "apps", None, None, "n"), ("2", "amount", "3.0", None, "3.0"), ("2", "apps", "z", "w|z", "z")]
    assert near(rows(got["means"], "feature"), [("amount", 2.0, 0.5, 2.0, 8 / 3)])


def test_what_comparisons_refuse(spark, sets):
    with pytest.raises(ValueError, match="not unique in b"):
        drift.compare_all("id", sets | {"b": sets["b"].union(sets["b"])})
    with pytest.raises(ValueError, match="one name"):
        drift.compare_all("id", sets, {"a": {"more": "amount"}})
    with pytest.raises(ValueError, match="no column"):
        drift.compare_all("id", {"a": sets["a"].select("id", "more"), "b": sets["b"]})
    with pytest.raises(ValueError):
        drift.compare_all("id", {"key": sets["a"], "b": sets["b"]})
    empty = drift.compare_all("id", {k: v.limit(0) for k, v in sets.items()}, {"b": {"sum": "amount"}})
    assert empty["rates"].count() == empty["differences"].count() == 0


@pytest.fixture(scope="module")
def people(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    cells = zip(range(600), y, y + rng.normal(0, 1, 600), y + rng.normal(0, 3, 600), rng.normal(size=600), strict=True)
    return spark.createDataFrame([(i, int(v), float(a), float(b), float(c), 1.0 if i % 50 else None) for i, v, a, b, c in cells], "id long, y int, strong double, weak double, none double, same double")


FILTERS = [select.QualityFilter(same_thr=0.9), select.SelectKBest(k=2), select.SelectFromModel(n=2), select.RFE(n=1), select.LRFilter("coef"), select.LRFilter("stepwise")]


@pytest.mark.parametrize("chosen", FILTERS, ids=lambda f: type(f).__name__ + getattr(f, "method", ""))
def test_every_filter_tells_the_same_things(spark, people, chosen):
    df = people.drop("id") if isinstance(chosen, select.QualityFilter) else people.drop("id", "same")
    chosen.fit(df, "y")
    said = {r["feature"]: r for r in chosen.features}
    assert set(said) == set(df.columns) - {"y"} and {c for c, r in said.items() if r["support"]} == set(chosen.columns)
    assert all(list(r) == ["feature", "support", "ranking", "score", "pvalue", "importance", "detail"] for r in chosen.features)
    assert said["strong"]["ranking"] == 1 and [r["ranking"] for r in chosen.features] == sorted(r["ranking"] for r in chosen.features)
    assert rows(select.features_table(spark, [chosen]).select("feature", "support"), "feature") == sorted((c, r["support"]) for c, r in said.items())
    if isinstance(chosen, select.QualityFilter):
        assert said["same"]["support"] is False and said["same"]["detail"]["missing"] == pytest.approx(0.02)
    elif isinstance(chosen, select.SelectKBest):
        assert said["strong"]["pvalue"] < 1e-6 < 0.01 < said["none"]["pvalue"] and said["strong"]["score"] > said["weak"]["score"]
    elif not (isinstance(chosen, select.LRFilter) and chosen.method == "stepwise"):
        assert said["strong"]["importance"] > 0


def test_the_report_stays_with_the_saved_filters(spark, people, tmp_path):
    for k, part in (("train", people.where("id < 400")), ("test", people.where("id >= 400"))):
        part.write.parquet(f"{tmp_path}/{k}.parquet")
    st = [{"method": "StableFilter", "params": {"limit": 5.0}}, {"method": "SelectKBestFilter", "params": {"k": 1}}]
    got = json.loads(stages.filter_ui(spark, {"ds": {"train": f"{tmp_path}/train.parquet", "test": f"{tmp_path}/test.parquet", "label": "y", "id": "id"}, "out": {"dst": f"{tmp_path}/out"}, "st": st}))
    assert got["code"] == 1, got["msg"]
    said = got["result"]["report"]["features"]
    assert [r["feature"] for r in said if r["filter"] == "SelectKBest" and r["support"]] == ["strong"] == got["result"]["report"]["columns"]
    assert all(r["score"] is not None for r in said if r["filter"] == "StableFilter" and r["support"])
    again = persist.load(spark.newSession(), got["result"]["meta"]["path"])
    assert [f.features for f in again.steps] == [[{k: r[k] for k in ("feature", "support", "ranking", "score", "pvalue", "importance", "detail")} for r in said if r["step"] == i] for i in (1, 2)]
    assert spark.read.json(got["result"]["report"]["table"]).count() == len(said)
