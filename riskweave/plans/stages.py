"""The stages of a modelling flow, each from one JSON document to one JSON answer.

A stage reads tables, fits on the train part in a few aggregations, applies its model to both parts
and writes Parquet and a JSON report. Answers are ``{code: 1, result: {ds, meta, report}}``, or
``{code: 2, msg: ...}`` when a stage fails.
"""

from __future__ import annotations

import json
import math
import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, models, select, split, stats
from ..operators.core import FeatureSpec, auto_spec, coerce_numeric, declare, is_numeric
from ..operators.drift import psi, psi_warnings, report_psi
from ..sources.io import StageFolder, get_data, report_json, table_to_dicts, write_json
from . import persist, reports
from .spec import StageSpec, instantiate


def stage(name: str) -> Callable:
    """Wrap a stage: parse, run, answer; an exception becomes code 2 with its trace."""

    def wrap(run):
        def answer(spark: SparkSession, text: str | dict) -> str:
            try:
                spec = StageSpec.parse(text)
                if not spec.out.get("dst"):
                    raise ValueError("a specification needs out.dst, a folder that driver and executors share")
                folder = StageFolder(spec.out["dst"], name)
                return report_json({"code": 1, "msg": "", "result": run(spark, spec, folder)})
            except Exception as e:  # the contract: failures are answers
                return report_json({"code": 2, "msg": f"{e}\n{traceback.format_exc()}", "result": {}})

        answer.__doc__ = run.__doc__
        answer.__name__ = run.__name__
        return answer

    return wrap


def _read(spark: SparkSession, spec: StageSpec, *names: str) -> list[DataFrame | None]:
    return [coerce_numeric(get_data(spark, spec.ds[n])) if spec.ds.get(n) is not None else None for n in names]


def _ids(spec: StageSpec) -> list[str]:
    ids = spec.ds.get("id") or spec.ds.get("index_col") or []
    return [ids] if isinstance(ids, str) else list(ids)


def _result(folder: StageFolder, spec: StageSpec, report: dict, meta: dict | None = None, **parts: DataFrame | None) -> dict:
    return {"ds": {"label": spec.ds.get("label"), "id": spec.ds.get("id")} | folder.write(**parts), "meta": meta or {}, "report": report}


@stage("sampler")
def sampler_ui(spark, spec, folder):
    """Stratified sample of ``ds.table`` by ``st``: level, sort_values, ratio or base, threshold."""
    df, base = _read(spark, spec, "table", "base")
    s = spec.st
    out = split.sample(df, s["level"], s["sort_values"], _ids(spec), s.get("ratio"), base, s.get("threshold", 0.1))
    counts = {str(r[0]): r[1] for r in out.groupBy(s["level"]).count().collect()}
    return _result(folder, spec, {"sample": counts}, train=out)


@stage("spliter")
def spliter_ui(spark, spec, folder):
    """Train and test of ``ds.table``; the label is derived from ``st.label_col``."""
    (df,) = _read(spark, spec, "table")
    s = spec.st
    df = split.derive_label(df, s["label_col"], spec.label) if s.get("label_col") else df
    train, test = split.split(df, s.get("method", "oot"), s.get("test_size", 0.25), s.get("time_col"), s.get("group_key"), _ids(spec), s.get("drop_cols", []), s.get("random_state", 7))
    result = _result(folder, spec, {}, train=train, test=test)
    parts = {k: get_data(spark, result["ds"][k]) for k in ("train", "test")}
    for k, p in parts.items():
        if split.one_class(p, spec.label):
            raise ValueError(f"{k} has one class")
    result["report"] = {k: table_to_dicts(p.agg(F.count(F.lit(1)).alias("n"), F.avg(spec.label).alias("rate")))[0] for k, p in parts.items()}
    return result


@stage("transformer")
def transformer_ui(spark, spec, folder):
    """Encoders for categorical, continuous and custom columns, fitted on train, in order.

    ``st`` has lists under ``cate``, ``cont`` and ``custom`` of ``{cols, encoders: [{method, params}]}``;
    ``method: auto`` with a threshold finds the columns of each kind.
    """
    train, test = _read(spark, spec, "train", "test")
    fitted, ids, label = [], _ids(spec), spec.label
    s = dict(spec.st)
    features = train.drop(*[c for c in (label, *ids) if c])
    if s.get("method") == "auto":
        found = auto_spec(features, s.get("threshold", 20), [c for g in s.get("custom", []) for c in g["cols"]])
        for kind, cols in (("cate", found.cate), ("cont", found.cont)):
            groups = s.get(kind) or [{"encoders": []}]
            s[kind] = [groups[0] | {"cols": cols}]
    kinds = FeatureSpec([c for g in s.get("cate", []) for c in g["cols"]], [c for g in s.get("cont", []) for c in g["cols"]])
    train, test = declare(train, kinds), declare(test, kinds) if test is not None else None
    for kind in ("cate", "cont", "custom"):
        for group in s.get(kind, []):
            cols = list(group["cols"])
            for e in group.get("encoders", []):
                if not cols:
                    break
                enc = instantiate(e["method"], {"columns": cols} | e.get("params", {}) if _takes_columns(e["method"]) else e.get("params", {}))
                before = set(train.columns)
                enc.fit(train if _takes_columns(e["method"]) else train.select(*cols, *([label] if label else [])), label)
                train, test = enc.transform(train), enc.transform(test) if test is not None else None
                cols = [c for c in train.columns if c not in before] or [c for c in cols if c in train.columns]
                fitted.append(enc)
    names = [type(e).__name__ for e in fitted]
    meta = persist.save(persist.Flow(fitted, kinds.cate, kinds.cont), folder.meta, spark)
    return _result(folder, spec, {"columns": train.columns, "encoders": names}, {"encoders": names, "path": meta}, train=train, test=test)


def _takes_columns(method: str) -> bool:
    from dataclasses import fields, is_dataclass

    from .spec import REGISTRY

    cls = REGISTRY.get(method)
    return is_dataclass(cls) and any(f.name == "columns" for f in fields(cls)) or method == "DropEncoder"


@stage("filter")
def filter_ui(spark, spec, folder):
    """Filters one after the other on train, applied to both parts (test may be absent). What each says
    of its columns (``select.features_table``) is in the report, in a table beside it and in the saved flow."""
    train, test = _read(spark, spec, "train", "test")
    ids, label = _ids(spec), spec.label
    filters = [instantiate(f["method"], f.get("params", {})) for f in spec.st]
    text = [c for c in train.columns if c not in (label, *ids) and not is_numeric(train, c)]
    train, test, done = select.run_filters(train, test, filters, label, [*ids, *text])
    meta = persist.save(persist.Flow(done), folder.meta, spark)
    said = select.features_table(spark, done)
    write_json(said, folder.report("filter_report"))
    report = {"columns": [c for c in train.columns if c not in (label, *ids)], "filters": [type(f).__name__ for f in done], "features": table_to_dicts(said), "table": folder.report("filter_report")}
    return _result(folder, spec, report, {"path": meta}, train=train, test=test)


def _numeric(df: DataFrame, spec: StageSpec) -> list[str]:
    return [c for c in df.columns if c not in (spec.label, *_ids(spec)) and is_numeric(df, c)]


@stage("optimizer")
def optimizer_ui(spark, spec, folder):
    """Search of parameters over ``st.ranges`` for ``st.method``; ``st.gp_params`` may have ``init_points``,
    ``n_iter`` (then all trials are their sum) and ``kappa``."""
    (train,) = _read(spark, spec, "train")
    s, g = spec.st, spec.st.get("gp_params") or {}
    first = g.get("init_points")
    trials = g["n_iter"] + (5 if first is None else first) if "n_iter" in g else s.get("trials", 6)
    best, trials = models.search(train, _numeric(train, spec), spec.label, _ids(spec)[0], s["method"], {k: tuple(v) for k, v in s["ranges"].items()}, trials, s.get("folds", 3), s.get("seed", 7), s.get("strategy", "gp"), first, g.get("kappa", 2.576), s.get("parallelism", 2), s.get("test_size", 0.2))
    return _result(folder, spec, {"trials": trials}, {"best": best})


@stage("trainer")
def trainer_ui(spark, spec, folder):
    """Cross-validated model of ``st.method``; scores of train (out of fold) and test, model and report.
    ``st`` may ask for ``test_size`` rows set aside and, for boosted trees, ``early_stopping_rounds``,
    there or among the parameters."""
    train, test = _read(spark, spec, "train", "test")
    s, idc = spec.st, _ids(spec)[0]
    params = {k: v for k, v in s.get("params", {}).items() if k not in ("early_stopping_rounds", "eval_metric", "verbose")}
    stop = s.get("early_stopping_rounds", s.get("params", {}).get("early_stopping_rounds"))
    t = models.ModelTrainer(s["method"], params, s.get("folds", 5), s.get("seed", 7), s.get("oversample", False), early_stopping_rounds=stop, test_size=s.get("test_size", 0.0), report=s.get("cv_report", True)).fit(train, spec.label, idc, _numeric(train, spec))
    persist.save(t, folder.meta, spark)
    scored = {"train": t.out_of_fold.drop("__fold"), "test": t.transform(test) if test is not None else None}
    result = _result(folder, spec, {}, {"model": folder.meta, "path": folder.meta, "columns": t.columns}, **scored)
    edges = stats.score_edges(scored["train"], "y_pred")
    more = {"fold_auc": t.fold_auc, "folds": t.fold_metrics, "summary": t.summary(), "best_rounds": t.best_rounds, "rounds": t.rounds}
    if t.holdout is not None:
        more["holdout"] = table_to_dicts(stats.curve_within(t.holdout, [], "y_pred", "y_true"))[0]
    result["report"] = more | {k: {"auc": stats.auc(d, "y_pred", "y_true").first()[0], "ks": stats.ks(d, "y_pred", "y_true").first()[0], "bands": table_to_dicts(stats.score_bands(d, "y_pred", "y_true", edges).orderBy("band"))} for k, d in scored.items() if d is not None}
    return result


@stage("inference")
def inference_ui(spark, spec, folder):
    """Scores of ``ds.test`` by what stages saved: ``ds.meta`` is a path from their answers, or several
    in order (transformer, filter, trainer). The session that fitted them need not be alive."""
    (df,) = _read(spark, spec, "test")
    out = inference(df, [persist.load(spark, p) for p in ([spec.ds["meta"]] if isinstance(spec.ds["meta"], str) else spec.ds["meta"])])
    return _result(folder, spec, {"columns": out.columns}, {"path": spec.ds["meta"]}, test=out)


def inference(df: DataFrame, encoders: list, trainer: models.ModelTrainer | None = None) -> DataFrame:
    """Fitted encoders, filters and a model on a batch or streaming frame."""
    for e in (*encoders, *([trainer] if trainer else [])):
        df = e.transform(df)
    return df


def data_report(train: DataFrame, test: DataFrame, columns: list[str], label: str, bins: int = 10) -> dict[str, list[dict]]:
    """Description, WOE, stability and warnings of two parts, as lists of rows in order of the
    features' information on test, levels by number where they are numbers, missing ones last. Numeric columns have the quantile bins of train, others their levels."""
    numeric = [c for c in columns if is_numeric(train, c)]
    levels = [c for c in columns if c not in numeric]
    stable = psi(train, test, numeric) if numeric else None
    binner = binning.ContBinningEncoder(bins, "qcut", columns=numeric).fit(train)

    def woe(df):
        parts = [stats.woe_report(df, levels, label)] * bool(levels) + [stats.binned_woe_report(df, binner, label)] * bool(numeric)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    woe_train, woe_test = woe(train), woe(test)
    out = {
        "desc_train": stats.data_stats(train, columns), "desc_test": stats.data_stats(test, columns), "woe_train": woe_train, "woe_test": woe_test,
        "v_psi": report_psi(woe_train, woe_test, "group_sample_ratio"), "l_psi": report_psi(woe_train, woe_test, "overdue_ratio"),
        "psi": stable, "warnings": psi_warnings(stable) if stable is not None else None,
    }
    rows = {k: table_to_dicts(v) for k, v in out.items() if v is not None}
    iv = {r["feature"]: r["IV"] for r in rows["woe_test"] if r["IV"] is not None}

    def place(r: dict) -> tuple:
        level = r.get("level")
        try:
            number = float(level) if level is not None else math.inf
        except ValueError:
            number = math.inf
        return (-iv.get(r["feature"], -math.inf), r["feature"], level is None, number, str(level or ""))

    return {k: sorted(v, key=place) for k, v in rows.items()}


@stage("reporter")
def reporter_ui(spark, spec, folder):
    """The report of a whole flow, from the parts that its stages left: ``ds.flow`` lists ``[stage, {train,
    test}]`` as `chain` gathers them (without it, ``ds.train`` and ``ds.test`` alone).

    For each stage with both parts and a label: levels with WOE and evaluation in order of the IV on
    test, stability tests, description, and warnings beyond ``st.limit`` (0.2). Every table is written
    as JSON under ``report/<stage>_<table>``, all warnings together under ``report/warning_report``; the
    answer has the warnings and where the tables are.
    """
    flow = spec.ds.get("flow") or [["flow", {"train": spec.ds["train"], "test": spec.ds["test"]}]]
    limit, paths, warned = spec.st.get("limit", 0.2), {}, None
    for name, parts in flow:
        if not (parts.get("train") and parts.get("test")):
            continue
        train, test = (coerce_numeric(get_data(spark, parts[k])) for k in ("train", "test"))
        if spec.label not in train.columns:
            continue
        known = (spec.label, *_ids(spec), *spec.st.get("exclude", []))
        columns = [c for c in train.columns if c in test.columns and c not in known]
        for kind, table in reports.flow_report(train, test, columns, spec.label, spec.st.get("bins", 10), limit).items():
            if kind == "warnings":
                own = table.withColumn("stage", F.lit(name))
                warned = own if warned is None else warned.unionByName(own)
            else:
                write_json(table, folder.report(f"{name}_{kind}"))
                paths.setdefault(name, {})[kind] = folder.report(f"{name}_{kind}")
    if warned is None:
        raise ValueError("no stage of the flow has train, test and label")
    write_json(warned, folder.report("warning_report"))
    written = spark.read.schema(warned.schema).json(folder.report("warning_report")).orderBy("stage", "feature", "kind", "metric")
    return _result(folder, spec, {"warnings": table_to_dicts(written), "tables": paths}, {"path": folder.report("warning_report")})


def chain(spark: SparkSession, steps: list[tuple[str, dict]], data: dict) -> list[dict]:
    """Stages one after the other, each on the files of the one before; ends at a failure. The parts that
    splitting, encoding and filtering left are kept in ``ds.flow`` for a reporter at the end."""
    run = {"sampler": sampler_ui, "spliter": spliter_ui, "transformer": transformer_ui, "filter": filter_ui, "optimizer": optimizer_ui, "trainer": trainer_ui, "inference": inference_ui, "reporter": reporter_ui}
    answers, ds = [], dict(data)
    for name, settings in steps:
        got = json.loads(run[name](spark, {"ds": ds, "out": settings.get("out", {}), "st": settings.get("st", {})}))
        answers.append(got)
        if got["code"] == 2:
            break
        new = {k: v for k, v in got["result"]["ds"].items() if v is not None}
        if name in ("spliter", "transformer", "filter"):
            ds["flow"] = [*ds.get("flow", []), [name, {k: new.get(k) for k in ("train", "test")}]]
        if got["result"]["meta"].get("path") and name not in ("inference", "reporter"):
            ds["meta"] = [*ds.get("meta", []), got["result"]["meta"]["path"]]
        ds = ds | new | ({"table": new["train"]} if name == "sampler" else {})
    return answers
