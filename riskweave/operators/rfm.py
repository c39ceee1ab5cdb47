"""Recency and frequency features of entities from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Aggregates of continuous variables by name.
FUNCTIONS = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "max": F.max, "min": F.min, "std": F.stddev_pop, "sum": F.sum, "count": F.count}
CONT, DELTA = ("mean", "median", "max", "min", "std"), ("mean", "median", "max", "min", "std")


def _conditions(df: DataFrame, uid: str, body: list[str], spans: dict[str, list], rank_key: str):
    """The frame with ranks, and (name, condition) of every body flag and span."""
    out = df
    for b in body:
        recent = W.partitionBy(uid, F.col(b) == 1).orderBy(F.col(rank_key).asc())
        out = out.withColumn(f"__rank_{b}", F.row_number().over(recent)) if spans.get("rank") else out
    found = []
    for b in body:
        flag = F.col(b) == 1
        found += [(f"span_{s}_by_{b}", flag & (F.col(rank_key) < s)) for s in spans.get("span", [])]
        found += [(f"rank_{s}_by_{b}", flag & (F.col(f"__rank_{b}") <= s)) for s in spans.get("rank", [])]
    return out, found


def cont_features(df: DataFrame, uid: str, body: list[str], columns: list[str], span_key: str, spans: dict[str, list], functions=CONT) -> DataFrame:
    """``<col>_<func>_by_<span>``: each aggregate over the events of every flag and span, in one
    grouping. ``spans`` has ``span`` (events younger than s) and ``rank`` (the s youngest events)."""
    x, found = _conditions(df, uid, body, spans, span_key)
    return x.groupBy(uid).agg(*[FUNCTIONS[f](F.when(c, F.col(v).cast("double"))).alias(f"{v}_{f}_by_{k}") for k, c in found for v in columns for f in functions])


def cate_features(df: DataFrame, uid: str, column: str, span_key: str) -> DataFrame:
    """Of the current (youngest) event's level: its count and share, and how far the most frequent
    level is ahead. Null is the level ``missing``; of equally young events the smallest level counts."""
    level = df.select(uid, F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("v"), F.col(span_key).alias("s"))
    g = level.groupBy(uid, "v").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    a = g.groupBy(uid).agg(F.sum("n").alias("total"), F.max("n").alias("mode"), F.min_by("n", F.struct("s", "v")).alias("base"))
    return a.select(uid, F.col("base").alias(f"{column}_base_count"), (F.col("base") / F.col("total")).alias(f"{column}_base_ratio"), (F.col("mode") - F.col("base")).alias(f"{column}_mode_diff"), ((F.col("mode") - F.col("base")) / F.col("total")).alias(f"{column}_mode_ratio_diff"))


def delta_features(df: DataFrame, uid: str, column: str, span_key: str, id_col: str, functions=DELTA) -> DataFrame:
    """Aggregates of each event's change against the one before it (by span, then id) less the
    entity's first value, first events left out."""
    w = W.partitionBy(uid).orderBy(span_key, id_col)
    x = F.col(column).cast("double")
    d = df.select(uid, (x - F.lag(x).over(w) - F.first(x).over(w)).alias("d"), F.row_number().over(w).alias("r")).where("r > 1")
    return d.groupBy(uid).agg(*[FUNCTIONS[f]("d").alias(f"{column}_delta_{f}") for f in functions])


def rfm(df: DataFrame, uid: str, body: list[str], span_key: str, spans: dict[str, list], cont: list[str] = (), cate: list[str] = (), delta: list[str] = (), id_col: str | None = None) -> DataFrame:
    """All features of each entity that has an event."""
    out = cont_features(df, uid, body, list(cont), span_key, spans) if cont else df.select(uid).distinct()
    for c in cate:
        out = out.join(cate_features(df, uid, c, span_key), uid, "full")
    for c in delta:
        out = out.join(delta_features(df, uid, c, span_key, id_col or span_key), uid, "left")
    return out
