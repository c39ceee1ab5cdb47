"""Order of reports, warnings, and a flow that ends with its report."""

import json
import random

import pytest

from riskweave.plans import reports, stages


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(9)

    def rows(n, shift):
        out = []
        for i in range(n):
            g, x = rng.choice(["2", "10", "x", None]), rng.gauss(shift, 1)
            out.append((i, g, x if i % 9 else None, rng.gauss(0, 1), int(rng.random() < (0.7 if (g == "2") != (x > shift) else 0.2))))
        return spark.createDataFrame(out, "id long, g string, x double, z double, y int").persist()

    return rows(700, 0.0), rows(400, 1.5)


def test_levels_stand_in_order(parts):
    report = reports.in_order(reports.level_report(*parts, ["g", "x", "z"], "y", bins=4)).collect()
    iv = {r["feature"]: r["iv_test"] for r in report}
    assert list(dict.fromkeys(r["feature"] for r in report)) == sorted(iv, key=lambda k: (-iv[k], k))
    assert [r["level"] for r in report if r["feature"] == "g"] == ["2", "10", "x", "missing"]
    assert [r["level"] for r in report if r["feature"] == "x"] == ["1", "2", "3", "4", "missing"]
    assert all((r["auc_test"] is None) == (r["feature"] == "g") for r in report)
    assert sum(r["n_train"] for r in report if r["feature"] == "x") == 700


def test_warnings_name_what_moved(parts):
    train, test = parts
    made = reports.flow_report(train, test, ["g", "x", "z"], "y")
    warned = made["warnings"].collect()
    assert ("x", "stable", "psi") in {tuple(r[:3]) for r in warned} and ("x", "desc", "mean") in {tuple(r[:3]) for r in warned}
    assert not any(r["feature"] == "z" and r["kind"] == "stable" for r in warned)
    assert all(abs(r["difference"]) >= 0.2 for r in warned)
    same = reports.flow_report(train, train, ["g", "x", "z"], "y")
    assert same["warnings"].count() == 0


def test_a_flow_ends_with_its_report(spark, parts, tmp_path):
    train, _ = parts
    train.withColumn("t", train["id"]).write.parquet(f"{tmp_path}/raw")
    out = lambda k: {"dst": f"{tmp_path}/{k}"}
    steps = [
        ("spliter", {"out": out("a"), "st": {"method": "oot", "time_col": "t", "test_size": 0.3}}),
        ("transformer", {"out": out("b"), "st": {"cate": [{"cols": ["g"], "encoders": [{"method": "WOEEncoder"}]}], "cont": [{"cols": ["x", "z"], "encoders": []}]}}),
        ("reporter", {"out": out("c"), "st": {"bins": 5}}),
    ]
    got = stages.chain(spark, steps, {"table": f"{tmp_path}/raw", "label": "y", "id": "id"})
    assert [g["code"] for g in got] == [1, 1, 1], got[-1]["msg"]
    report = got[-1]["result"]["report"]
    assert set(report["tables"]) == {"spliter", "transformer"} and set(report["tables"]["spliter"]) == {"woe_eva", "stable_test", "data_stats"}
    table = spark.read.json(report["tables"]["transformer"]["woe_eva"])
    assert {r["feature"] for r in table.select("feature").distinct().collect()} == {"g", "g_woe", "x", "z"}
    assert spark.read.json(got[-1]["result"]["meta"]["path"]).count() == len(report["warnings"])
    assert json.loads(stages.reporter_ui(spark, {"ds": {"flow": [], "train": f"{tmp_path}/raw", "test": f"{tmp_path}/raw", "label": "no"}, "out": out("d")}))["code"] == 2
