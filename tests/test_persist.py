"""Every registered encoder through the JSON flow, and a finished flow that scores later data."""

import json

import pytest
from pyspark.sql import functions as F

from riskweave.plans import persist, spec, stages
from riskweave.streaming import scoring


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flow")
    rows = [(i, float(i % 17) if i % 5 else None, "abc"[i % 3] if i % 7 else None, i % 2 if i % 3 else 1, i / 10, "|".join("pqr"[: 1 + i % 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, g string, y int, z double, apps string")
    df.write.parquet(f"{root}/in.parquet")
    return str(root), df


#: Column kind, columns and parameters for each registered encoder.
CASES = {
    "BaseEncoder": ("custom", ["x", "g", "z"], {}), "WOEEncoder": ("cate", ["g"], {}), "CountEncoder": ("cate", ["g"], {}), "CateLabelEncoder": ("cate", ["g"], {}), "CateOneHotEncoder": ("cate", ["g"], {}),
    "TargetEncoder": ("cate", ["g"], {}), "ImputeEncoder": ("cont", ["x"], {}), "ContImputerEncoder": ("cont", ["x"], {"strategy": "median"}), "ContBinningEncoder": ("cont", ["x", "z"], {"bins": 4}),
    "ClusterBinEncoder": ("cate", ["g"], {}), "CateBinningEncoder": ("cate", ["g"], {"bins": 2}), "BinningEncoder": ("custom", ["x", "g"], {}), "BinningWOEEncoder": ("custom", ["x", "g"], {}), "ReduceGen": ("cont", ["x", "z"], {}),
    "AppCateEncoder": ("custom", ["apps"], {"names": {"p": "one", "q": "two"}, "unknown": "other"}), "FriedScale": ("cont", ["x"], {}), "IndexValueEncoder": ("custom", ["x", "g"], {}),
    "NothingEncoder": ("custom", ["x"], {}), "DropEncoder": ("custom", ["x"], {}), "StableEncoder": ("custom", ["x"], {}),
}


@pytest.mark.parametrize("name", sorted(set(spec.REGISTRY) - {"StableFilter", "SelectKBestFilter", "SelectFromModelFilter", "RFEFilter", "LRFilter"}))
def test_every_encoder_runs_and_is_saved(spark, data, name):
    root, df = data
    kind, cols, params = CASES[name]
    st = {kind: [{"cols": cols, "encoders": [{"method": name, "params": params}]}]}
    got = json.loads(stages.transformer_ui(spark, {"ds": {"train": f"{root}/in.parquet", "test": f"{root}/in.parquet", "label": "y", "id": "id"}, "out": {"dst": f"{root}/{name}"}, "st": st}))
    assert got["code"] == 1, got["msg"]
    now = spark.read.parquet(got["result"]["ds"]["test"])
    again = persist.load(spark.newSession(), got["result"]["meta"]["path"]).transform(spark.read.parquet(f"{root}/in.parquet"))
    assert sorted(map(str, again.select(now.columns).collect())) == sorted(map(str, now.collect()))


def test_a_flow_scores_later_data(spark, data):
    root, df = data
    df.withColumn("days", F.col("id") % 30).withColumn("s", F.col("days") + F.rand(1) * 9).drop("y", "apps").write.parquet(f"{root}/raw.parquet")
    out = lambda n: {"dst": f"{root}/chain/{n}"}
    steps = [
        ("spliter", {"out": out("a"), "st": {"method": "oot", "test_size": 0.25, "time_col": "z", "label_col": "days"}}),
        ("transformer", {"out": out("b"), "st": {"cate": [{"cols": ["g"], "encoders": [{"method": "WOEEncoder"}]}], "cont": [{"cols": ["x", "s"], "encoders": [{"method": "ContBinningEncoder", "params": {"bins": 4}}]}]}}),
        ("filter", {"out": out("c"), "st": [{"method": "SelectKBestFilter", "params": {"k": 3}}]}),
        ("trainer", {"out": out("d"), "st": {"method": "LogisticRegression", "folds": 2}}),
        ("inference", {"out": out("e")}),
    ]
    first = stages.chain(spark, steps[:2], {"table": f"{root}/raw.parquet", "label": {"name": "14d", "type": "int"}, "id": "id"})
    assert [g["code"] for g in first] == [1, 1], first[-1]["msg"]
    got = stages.chain(spark, steps[:4], {"table": f"{root}/raw.parquet", "label": {"name": "14d", "type": "int"}, "id": "id"})
    assert [g["code"] for g in got] == [1, 1, 1, 1], got[-1]["msg"]
    meta = [g["result"]["meta"]["path"] for g in got[1:]]
    held = got[0]["result"]["ds"]["test"]
    scored = json.loads(stages.inference_ui(spark.newSession(), {"ds": {"test": held, "meta": meta, "label": {"name": "14d"}, "id": "id"}, "out": out("f")}))
    assert scored["code"] == 1, scored["msg"]
    want = {r["id"]: r["y_pred"] for r in spark.read.parquet(got[3]["result"]["ds"]["test"]).collect()}
    have = {r["id"]: r["y_pred"] for r in spark.read.parquet(scored["result"]["ds"]["test"]).collect()}
    assert want.keys() == have.keys() and all(abs(want[k] - have[k]) < 1e-9 for k in want)
    stream = spark.readStream.schema(spark.read.parquet(held).schema).parquet(held)
    q = scoring.score_stream(stream, [persist.load(spark, meta[0])]).writeStream.format("memory").queryName("loaded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("loaded").where("g_woe is not null").count() == len(want)
    assert json.loads(stages.inference_ui(spark, {"ds": {"test": held, "meta": meta}}))["code"] == 2  # no folder


def test_unknown_classes_are_not_loaded(spark, data):
    root, _ = data
    spark.createDataFrame([('{"$object": "os.system", "state": {}}',)], "value string").write.text(f"{root}/bad/state")
    with pytest.raises(ValueError):
        persist.load(spark, f"{root}/bad")


def test_data_report_has_bins_of_numeric_columns(spark, data):
    _, df = data
    r = stages.data_report(df.where("id < 200"), df.where("id >= 200"), ["x", "g", "z"], "y")
    assert {x["feature"] for x in r["woe_train"]} == {x["feature"] for x in r["v_psi"]} == {"x", "g", "z"}
    iv = {x["feature"]: x["IV"] for x in r["woe_test"]}
    assert [x["feature"] for x in r["v_psi"]] == sorted(iv, key=lambda k: (-iv[k], k))
