"""Fitted encoders, filters and trainers in folders, to score later data in another session.

A folder holds ``state`` (one JSON text: parameters and what was learned), ``tables`` (Parquet, for
encoders that keep a table of levels) and, for trainers, ``model``. All of it is written and read by
Spark, so any file system it knows will do. Only registered classes are made again; nothing is
evaluated or imported by name.
"""

from __future__ import annotations

import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ..operators import binning, encoders, models, select
from .spec import REGISTRY

#: Classes that other ones hold, beside those that specifications may name.
PARTS = (encoders.LabelEncoder, encoders.ContImputerEncoder, encoders.WOEEncoder, binning.ContBinningEncoder, binning.CateBinningEncoder, binning.BinningEncoder, binning.HistogramEncoder, encoders.IndexValueEncoder, models.ModelTrainer, select.QualityFilter)
#: What is not needed once fitted.
DROPPED = {"assembler", "out_of_fold", "holdout", "levels_table"}


def classes() -> dict[str, type]:
    """Name to class of all that may be loaded."""
    return {c.__name__: c for c in (*PARTS, *REGISTRY.values(), Flow)}


class Flow:
    """Fitted encoders and filters in order, applied after columns are cast as at fit."""

    def __init__(self, steps: list, cate: list[str] = (), cont: list[str] = ()):
        self.steps, self.cate, self.cont = list(steps), list(cate), list(cont)

    def transform(self, df: DataFrame) -> DataFrame:
        from ..operators.core import FeatureSpec, declare

        df = declare(df, FeatureSpec([c for c in self.cate if c in df.columns], [c for c in self.cont if c in df.columns]))
        for s in self.steps:
            df = s.transform(df)
        return df


def save(thing, folder: str, spark: SparkSession) -> str:
    """Write a fitted object; what stands in the folder is replaced."""
    tables: list[DataFrame] = []
    models_: list = []

    def plain(x):
        if isinstance(x, DataFrame):
            tables.append(x)
            return {"$table": len(tables) - 1}
        if type(x).__name__ in classes() and type(x) is classes()[type(x).__name__]:
            return {"$object": type(x).__name__, "state": {k: plain(v) for k, v in vars(x).items() if k not in DROPPED}}
        if hasattr(x, "write") and hasattr(x, "uid"):
            models_.append(x)
            return {"$model": len(models_) - 1}
        if isinstance(x, dict):
            return {"$pairs": [[plain(k), plain(v)] for k, v in x.items()]}
        if isinstance(x, (list, tuple, set)):
            return [plain(v) for v in x]
        if hasattr(x, "item"):
            return x.item()
        if x is None or isinstance(x, (str, int, float, bool)):
            return x
        raise TypeError(f"cannot save a {type(x).__name__}")

    state = json.dumps(plain(thing))
    for i, t in enumerate(tables):
        t.write.mode("overwrite").parquet(f"{folder}/tables/{i}")
    for i, m in enumerate(models_):
        m.write().overwrite().save(f"{folder}/model/{i}")
    spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/state")
    return folder


def load(spark: SparkSession, folder: str):
    """The object that `save` wrote, ready to transform batches and streams."""
    known = classes()

    def made(x):
        if isinstance(x, list):
            return [made(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "$table" in x:
            return spark.read.parquet(f"{folder}/tables/{x['$table']}")
        if "$model" in x:
            return DefaultParamsReader.loadParamsInstance(f"{folder}/model/{x['$model']}", spark)
        if "$pairs" in x:
            return {k: made(v) for k, v in ((made(k), v) for k, v in x["$pairs"])}
        if x.get("$object") not in known:
            raise ValueError(f"unknown class {x.get('$object')!r}")
        out = known[x["$object"]].__new__(known[x["$object"]])
        vars(out).update({k: made(v) for k, v in x["state"].items()})
        return out

    return made(json.loads(spark.read.option("wholetext", True).text(f"{folder}/state").first()[0]))
