"""Hand-made cases: nulls, unseen levels, ties, closed ends, single classes, broken JSON."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import scalars, sqltext
from riskweave.operators import binning, core, drift, encoders, models, rfm, rules, select, split, stats
from riskweave.plans import spec, stages
from riskweave.sources import io
from riskweave.streaming import scoring


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, float(i % 17) if i % 5 else None, "abc"[i % 3] if i % 7 else None, i % 2 if i % 3 else 1, float("nan") if i % 11 == 0 else i / 10) for i in range(400)]
    return core.null_nans(spark.createDataFrame(rows, "id long, x double, g string, y int, z double")).persist()


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (None,)], "v double")
    assert [r[0] for r in df.select(binning.bin_column("v", [1.0, 2.0])).collect()] == [1, 2, 3, 0]
    assert binning.bin_labels([1.0])[1] == "(-inf, 1.0]"


def test_nan_and_null_are_alike(people):
    assert people.where(F.isnan("z")).count() == 0 and people.where("z is null").count() == 37


def test_numeric_strings(spark):
    df = spark.createDataFrame([("1", "1"), ("2.5", "x"), (None, None)], "a string, b string")
    assert dict(core.coerce_numeric(df).dtypes) == {"a": "double", "b": "string"}


def test_kinds(people):
    k = core.infer_kinds(people, 20, ["x", "g", "z"])
    assert k.cate == ["x", "g"] and k.cont == ["z"]
    assert core.auto_spec(people, 5, ["z"]).cate == ["g", "y"]


def test_running_sums_match_a_window(spark):
    rows = [(float(i * 7 % 101), i) for i in range(101)]
    got = {r["k"]: r["s"] for r in core.cumulate(spark.createDataFrame(rows, "k double, n int"), "k", {"s": "n"}, parts=7).collect()}
    at = 0
    for k, n in sorted(rows):
        at += n
        assert got[k] == at


def test_woe_bounds_null_level_and_label_swap(spark):
    rows = [("p", 1)] * 5 + [("n", 0)] * 4 + [(None, 1), (None, 0), ("m", 1), ("m", 0), ("m", 0)]
    df = spark.createDataFrame(rows, "g string, y int")
    t = {r["level"]: r for r in encoders.woe_table(df, ["g"], "y").collect()}
    assert t["p"]["woe"] == 4.6 and t["n"]["woe"] == -4.6
    assert math.isclose(t["m"]["woe"], math.log((1 / 7) / (2 / 7)))
    back = {r["level"]: r for r in encoders.woe_table(df.withColumn("y", 1 - F.col("y")), ["g"], "y").collect()}
    assert all(math.isclose(t[k]["woe"], -back[k]["woe"]) for k in t) and sum(r["iv"] for r in t.values()) >= 0
    e = encoders.WOEEncoder(columns=["g"]).fit(df, "y")
    unseen = e.transform(spark.createDataFrame([("zzz",)], "g string")).first()["g_woe"]
    assert math.isclose(unseen, t[None]["woe"])
    plain = encoders.WOEEncoder(columns=["g"]).fit(df.where("g is not null"), "y")
    assert plain.transform(spark.createDataFrame([("zzz",), (None,)], "g string")).select("g_woe").distinct().first()[0] == 0.0


def test_encoders_on_unseen_and_null(spark, people):
    new = spark.createDataFrame([("a",), ("q",), (None,)], "g string")
    assert [r[0] for r in encoders.LabelEncoder(columns=["g"]).fit(people).transform(new).select("g_label").collect()] == [1.0, 0.0, 0.0]
    assert [tuple(r)[1:] for r in encoders.OneHotEncoder(columns=["g"]).fit(people).transform(new).collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]
    c = encoders.CountEncoder(columns=["g"]).fit(people).transform(new).select("g_count").collect()
    assert c[1][0] == 0.0 and c[2][0] > 0
    a, b = (encoders.LabelEncoder(columns=["g", "h"], across=x).fit(people.withColumn("h", F.col("g"))).transform(new.withColumn("h", F.col("g"))).first() for x in (False, True))
    assert a["h_label"] == 1.0 and b["h_label"] == 4.0
    with pytest.raises(ValueError):
        encoders.category_encoder("__import__")


def test_levels_are_clustered_by_woe_and_unseen_ones_are_0_or_the_rate(spark):
    rows = [(g, int(i % 10 < k)) for g, k in (("a", 1), ("b", 1), ("c", 5), ("d", 5), ("e", 9)) for i in range(100)]
    df, new = spark.createDataFrame(rows, "g string, y int"), spark.createDataFrame([("a",), ("b",), ("e",), ("zzz",)], "g string")
    a, b, e, unseen = [r["g_cluster"] for r in binning.ClusterBinEncoder(["g"]).fit(df, "y").transform(new).select("g_cluster").collect()]
    assert a == b < 0 < e and unseen == 0.0
    got = encoders.WOEEncoder(columns=["g"], unseen="rate").fit(df, "y").transform(new).where("g = 'zzz'").first()["g_woe"]
    assert got == pytest.approx(0.42)


def test_tree_cuts_are_exact():
    v, pos, neg = np.arange(6.0), np.array([0, 0, 0, 5, 5, 5]), np.array([5, 5, 5, 0, 0, 0])
    assert binning.tree_cuts(v, pos, neg, 4) == [2.5]
    assert len(binning.tree_cuts(np.arange(40.0), np.arange(40) % 3, np.arange(40) % 2, 6)) <= 5


def test_heavy_values_are_edges(spark):
    df = spark.createDataFrame([(0.0,)] * 60 + [(float(i),) for i in range(1, 41)], "v double")
    assert 0.0 in binning.heavy_quantiles(df, ["v"], 10)["v"]
    const = spark.createDataFrame([(3.0,)] * 10, "v double")
    assert binning.heavy_quantiles(const, ["v"], 10)["v"] == [3.0]
    assert drift.psi(const, const, ["v"]).first()["psi"] == pytest.approx(0, abs=1e-3)


def test_psi_of_itself_is_zero_and_extremes_count(spark, people):
    assert drift.psi(people, people, ["x", "z"]).agg(F.max(F.abs("psi"))).first()[0] < 1e-3
    assert drift.psi(people, people.withColumn("z", F.col("z") / 2), ["z"]).first()["psi"] > 0.2
    far = people.withColumn("z", F.col("z") + 1000)
    assert drift.psi(people, far, ["z"]).first()["extreme_ratio"] == 1.0


def test_tails():
    assert drift.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert drift.f_tail(3.0, 5, 12) == pytest.approx(0.0546, abs=1e-3)
    assert drift.ks_tail(0.0, 10, 10) == 1.0


def test_auc_with_ties_and_reversed(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 9, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(s, y, strict=True)], "s int, y int")
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    got = stats.auc(df, "s", "y").first()[0]
    assert got == pytest.approx(want) and stats.auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0] == pytest.approx(1 - want)


def test_bands_add_up(people):
    e = stats.score_edges(people, "z")
    b = stats.score_bands(people.where("z is not null"), "z", "y", e)
    assert b.agg(F.sum("n")).first()[0] == people.where("z is not null").count()


def test_splits(spark, people):
    marked = split.latest(people.withColumn("t", F.col("id") % 10), 0.25, "t", ["id"])
    assert marked.where("is_test").count() == 100
    ties = [r[0] for r in marked.where("is_test and t = 7").select("id").orderBy("id").collect()]
    assert ties == sorted(ties)[: len(ties)] and ties[0] == 7
    assert split.one_class(people.where("y = 1"), "y")
    per = [r["count"] for r in split.fold(people, "y", 4, ["id"], "f").where("y = 1").groupBy("f").count().collect()]
    assert len(per) == 4 and max(per) - min(per) <= 1
    with pytest.raises(ValueError):
        split.split(people, "nonsense", 0.5)


def test_sample_in_the_ratio_of_another_set(people):
    base = people.where("z < 20")
    got = split.sample(people, "z", "id", ["id"], base=base, threshold=0.01)
    assert 0 < got.count() < 400 and got.columns == people.columns
    even = split.sample(people, "g", "id", ["id"], {"a": 1, "b": 1}, threshold=0.01).groupBy("g").count().collect()
    assert len({r["count"] for r in even}) == 1


def test_quotas():
    assert split.quotas({"a": 100, "b": 10}, {"a": 1, "b": 1}, 0.01) == {"a": 10, "b": 10}
    assert split.quotas({"a": 100, "b": 10, "d": 5}, {"a": 1, "b": 1, "c": 9}, 0.5) == {"a": 100, "b": 10}
    with pytest.raises(ValueError):
        split.quotas({"a": 5}, {"a": 1}, 50)


def test_filters(spark, people):
    f = select.QualityFilter().fit(people.withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("double")).withColumn("name", F.col("id").cast("string")), "y")
    assert set(f.exclude) == {"one", "none", "name"}
    k = select.SelectKBest(k=1).fit(people.withColumn("good", F.col("y") * 1.0 + F.rand(1) / 10), "y", ["x", "good"])
    assert k.columns == ["good"]
    s = select.StableFilter(columns=["x", "z"]).fit(people, people.withColumn("z", F.col("z") / 2))
    assert s.exclude == ["z"]
    lr = select.LRFilter("coef").fit(people.withColumn("good", F.col("y") + F.rand(2)).withColumn("bad", -F.col("y") + F.rand(3)), "y", ["good", "bad"])
    assert lr.columns == ["good"]


def test_models_and_rules(spark, people):
    df = people.withColumn("good", F.col("y") + F.rand(1))
    t = models.ModelTrainer("LogisticRegression", folds=3, oversample=True).fit(df, "y", "id", ["good", "x"])
    assert min(t.fold_auc) > 0.8 and t.transform(df).count() == 400
    with pytest.raises(ValueError):
        models.make_estimator("os.system")
    best, trials = models.search(df, ["good"], "y", "id", "LogisticRegression", {"regParam": (0.0, 0.5)}, trials=2, folds=2)
    assert len(trials) == 2 and best["target"] == max(x["target"] for x in trials)
    r = rules.Ripper(least_positives=20, max_rules=2).fit(df, "y", ["good", "g"], "id")
    assert r.rules and r.transform(df).where("y_pred > 0").count() > 0
    fit = rules.RuleFit(trees=3).fit(df, "y", ["good", "x"])
    assert {x["type"] for x in fit.get_rules()} == {"rule", "linear"}
    sk = rules.SkopeRules().fit(df, "y", ["good"])
    assert sk.transform(df).agg(F.max("y_pred")).first()[0] >= 0.5
    mlr = models.MixtureLR(steps=5).fit(df, "y", ["good", "x"])
    assert stats.auc(mlr.transform(df), "y_pred", "y").first()[0] > 0.7


def test_rule_text_parses():
    text = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert rules.tree_rules(text, ["a", "b"]) == ["`a` <= 1.5", "`a` <= 1.5 AND `b` > 2.0", "`a` <= 1.5 AND `b` <= 2.0", "`a` > 1.5"]


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 1}, "c": [1, 2]}'), (2, "oops"), (3, None)], "id int, j string")
    got = {r["id"]: r for r in scalars.flatten_json(df, "j", "a struct<b:int>, c array<int>").collect()}
    assert got[1]["a_b"] == 1 and got[1]["c"] == [1, 2] and (got[1]["_ERROR_"], got[2]["_ERROR_"], got[3]["_ERROR_"]) == (0, 1, 0)
    maps = {r[0]: r[1] for r in df.select("id", scalars.flatten_variant(F.col("j"))).collect()}
    assert maps[1] == {"a_b": "1", "c": "[1,2]"} and maps[2] == {"_ERROR_": "1"} and maps[3] is None


def test_texts(spark):
    df = spark.createDataFrame([(" None ",), ("NaN",), ("x",)], "s string")
    assert [r[0] for r in df.select(scalars.clean_null_words(F.col("s"))).collect()] == [None, None, "x"]
    sql = "select a.x from t1 as a left join db.t2 b on a.i = b.i where a.s = 'from x'"
    assert sqltext.tables_of(sql) == {"a": "t1", "b": "db.t2"}
    assert sqltext.format_sql(sql).splitlines()[0] == "SELECT a.x" and "'from x'" in sqltext.format_sql(sql)
    assert sqltext.subqueries("select * from (select 1 from (select 2) q) z")[0] == (2, "select 2")
    assert [r[0] for r in spark.createDataFrame([("b|a|b",)], "s string").select(drift.canonical_list(F.col("s"), "|", True)).collect()] == ["a|b"]


def test_rfm_delta(spark):
    df = spark.createDataFrame([("u", 1.0, 10.0, 1), ("u", 2.0, 13.0, 2), ("u", 3.0, 11.0, 3), ("v", 1.0, 5.0, 4)], "uid string, age double, v double, id int")
    r = rfm.delta_features(df, "uid", "v", "age", "id").collect()
    assert len(r) == 1 and r[0]["v_delta_max"] == -7.0 and r[0]["v_delta_min"] == -12.0


def test_sources(spark, people, tmp_path):
    people.write.csv(str(tmp_path / "p.csv"), header=True)
    assert io.get_data(spark, str(tmp_path / "p.csv")).count() == 400
    assert "`x` DECIMAL(20,12)" in io.ddl(people, "t") and "`id` BIGINT" in io.ddl(people, "t")
    people.createOrReplaceTempView("people")
    assert io.execute(spark, "select count(*) c from people", columns=["n"]).first()["n"] == 400
    io.write_json(people.limit(2), str(tmp_path / "j"))
    assert "null" in "".join(f.read_text() for f in (tmp_path / "j").glob("*.json"))
    assert json.loads(io.report_json({"a": float("nan"), 1: [math.inf]})) == {"a": None, "1": [None]}
    assert io.workbook({"s": people.limit(3)}, str(tmp_path / "w"))
    with pytest.raises(ValueError):
        io.workbook({"s": people}, str(tmp_path / "w"), most=10)
    with pytest.raises(ValueError):
        io.execute(spark, "select 1", engine="other")


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0001, None), (2, 2.0, "x")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0002, None), (2, 3.0, "x")], "k int, v double, s string")
    ratio, diff = drift.compare_report(a, b, "k")
    got = {r["feature"]: r for r in ratio.collect()}
    assert got["v"]["raw"] == 0.5 and (got["s"]["raw"], got["s"]["filled"]) == (0.5, 1.0)
    assert [r["v"] for r in diff.orderBy("k").collect()] == [None, "a:2.0, b:3.0"]
    with pytest.raises(ValueError):
        drift.common_rows(a.unionAll(a), b, "k")


def test_chain(spark, people, tmp_path):
    df = people.withColumn("days", F.col("id") % 30).withColumn("t", F.col("id")).withColumn("s", F.col("days") + F.rand(1) * 9).drop("y")
    df.write.parquet(str(tmp_path / "in.parquet"))
    out = lambda n: {"dst": str(tmp_path / n)}
    steps = [
        ("spliter", {"out": out("a"), "st": {"method": "oot", "test_size": 0.25, "time_col": "t", "label_col": "days"}}),
        ("transformer", {"out": out("b"), "st": {"method": "auto", "threshold": 5, "cate": [{"encoders": [{"method": "WOEEncoder"}]}], "cont": [{"encoders": [{"method": "ContBinningEncoder", "params": {"bins": 4}}]}]}}),
        ("filter", {"out": out("c"), "st": [{"method": "SelectKBestFilter", "params": {"k": 3}}]}),
        ("trainer", {"out": out("d"), "st": {"method": "LogisticRegression", "folds": 2}}),
    ]
    got = stages.chain(spark, steps, {"table": str(tmp_path / "in.parquet"), "label": {"name": "14d", "type": "int"}, "id": "id"})
    assert [g["code"] for g in got] == [1, 1, 1, 1], got[-1]["msg"]
    assert got[-1]["result"]["report"]["train"]["auc"] > 0.6
    bad = json.loads(stages.spliter_ui(spark, {"ds": {"table": str(tmp_path / "in.parquet"), "label": {"name": "99d"}, "id": "id"}, "out": out("e"), "st": {"label_col": "days", "time_col": "t"}}))
    assert bad["code"] == 2 and "one class" in bad["msg"]
    assert json.loads(stages.trainer_ui(spark, {"nonsense": 1}))["code"] == 2
    with pytest.raises(ValueError):
        spec.instantiate("eval")


def test_streaming(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "s"))
    e = encoders.WOEEncoder(columns=["g"]).fit(people, "y")
    stream = spark.readStream.schema(people.schema).parquet(str(tmp_path / "s"))
    q = scoring.score_stream(stream, [e]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").where("g_woe is not null").count() == 400
    w = scoring.watch_stability(stream, people, ["x"], str(tmp_path / "psi"), str(tmp_path / "cp"))
    w.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "psi")).count() >= 1
