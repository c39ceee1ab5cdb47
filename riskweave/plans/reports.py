"""Reports on a flow: weight of evidence beside score quality, stability, and what to warn of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import binning, stats
from ..operators.core import is_numeric, unused
from ..operators.drift import consistency_tests, drift_warnings

#: What stands for a missing value among the levels of a report.
MISSING = "missing"


def report_levels(df: DataFrame, columns: list[str], label: str, binner: binning.ContBinningEncoder) -> DataFrame:
    """`stats.woe_report` of columns with levels and of a fitted encoder's bins; missing values and the
    encoder's missing bin are the level ``missing``."""
    plain, binned = [c for c in columns if c not in binner.columns], list(binner.columns)
    parts = [stats.woe_report(df, plain, label).withColumn("level", F.coalesce("level", F.lit(MISSING)))] * bool(plain)
    if binned:
        parts.append(stats.binned_woe_report(df, binner, label).withColumn("level", F.when(F.coalesce("level", F.lit("0")) == "0", MISSING).otherwise(F.col("level"))))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def level_report(train: DataFrame, test: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Every level of every column in train and test: rows, shares, rates, WOE and IV of both, and for numeric
    columns AUC and KS of both, with the keys of its order.

    Features stand by their IV on test, greatest first (``feature_rank``; ties by name), a feature's
    levels by number where they are numbers, then by text, ``missing`` last: order by
    ``feature_rank, level_missing, level_number (nulls last), level``. Levels that only one part has
    have nulls for the other. Numeric columns have the quantile bins of train, numbered from 1.
    """
    numeric = [c for c in columns if is_numeric(train, c)]
    binner = binning.ContBinningEncoder(bins, "qcut", columns=numeric).fit(train)
    names = {"total_sample_num": "n", "overdue_ratio": "rate", "group_sample_ratio": "share", "woe": "woe", "IV": "iv"}

    def side(df: DataFrame, part: str) -> DataFrame:
        t = report_levels(df, columns, label, binner)
        return t.select("feature", "level", *[F.col(k).alias(f"{v}_{part}") for k, v in names.items()])

    both = side(train, "train").join(side(test, "test"), ["feature", "level"], "full")
    # a level that a part lacks still has its feature's IV there
    iv = both.groupBy("feature").agg(F.max("iv_train").alias("a"), F.max("iv_test").alias("b"))
    ranked = iv.select("feature", "a", "b", F.row_number().over(W.orderBy(F.col("b").desc_nulls_last(), "feature")).alias("feature_rank"))  # a row for each column
    out = both.join(ranked, "feature").withColumns({"iv_train": F.col("a"), "iv_test": F.col("b")}).drop("a", "b")
    if numeric:
        marked = train.select(*numeric, label, F.lit("train").alias("__part")).unionByName(test.select(*numeric, label, F.lit("test").alias("__part")))
        curves = stats.feature_curves(marked, numeric, [label], "__part").groupBy("feature")
        at = lambda c, p: F.max(F.when(F.col("__part") == p, F.col(c))).alias(f"{c}_{p}")
        out = out.join(curves.agg(*[at(c, p) for c in ("auc", "ks") for p in ("train", "test")]), "feature", "left")
    else:
        out = out.withColumns({f"{c}_{p}": F.lit(None).cast("double") for c in ("auc", "ks") for p in ("train", "test")})
    return out.withColumns({"level_missing": F.col("level") == MISSING, "level_number": F.expr("try_cast(level AS double)")})


def in_order(report: DataFrame) -> DataFrame:
    """A `level_report` in its order, sorted by ranges."""
    return report.orderBy("feature_rank", "level_missing", F.col("level_number").asc_nulls_last(), "level")


def report_warnings(report: DataFrame, tests: DataFrame, desc_train: DataFrame, desc_test: DataFrame, limit: float = 0.2) -> DataFrame:
    """``feature, kind, metric, train, test, difference`` of what differs between the parts by ``limit`` or more.

    ``woe``: a feature's IV, AUC or KS, relative (``1 - (test + .01) / (train + .01)``); ``level``: a
    level's share or rate, the level being named in ``metric``; ``stable``: a PSI above the limit;
    ``desc``: a statistic of the description, relative.
    """
    (key,) = unused(report, "metric")
    features = report.groupBy("feature").agg(*[F.max(f"{m}_{p}").alias(f"{m}_{p}") for m in ("iv", "auc", "ks") for p in ("train", "test")])
    relative = lambda a, b: 1 - (b + 0.01) / (a + 0.01)

    def melted(df: DataFrame, kind: str, names: dict) -> DataFrame:
        cells = [F.struct(name.alias(key), F.col(f"{m}_train").alias("train"), F.col(f"{m}_test").alias("test")) for m, name in names.items()]
        x = df.select("feature", F.inline(F.array(*cells))).withColumn("difference", relative(F.col("train"), F.col("test")))
        return x.where(F.abs("difference") >= limit).select("feature", F.lit(kind).alias("kind"), F.col(key).alias("metric"), "train", "test", "difference")

    out = melted(features, "woe", {m: F.lit(m) for m in ("iv", "auc", "ks")})
    out = out.unionByName(melted(report, "level", {m: F.concat(F.lit(f"{m} of "), "level") for m in ("share", "rate")}))
    none = F.lit(None).cast("double")
    out = out.unionByName(tests.where(F.col("psi") >= limit).select("feature", F.lit("stable").alias("kind"), F.lit("psi").alias("metric"), none.alias("train"), none.alias("test"), F.col("psi").alias("difference")))
    shown = [c for c in ("missing", "mean", "std", "p50") if c in desc_train.columns and c in desc_test.columns]
    return out.unionByName(drift_warnings(desc_train, desc_test, shown, limit).withColumn("kind", F.lit("desc")))


def flow_report(train: DataFrame, test: DataFrame, columns: list[str], label: str, bins: int = 10, limit: float = 0.2) -> dict[str, DataFrame]:
    """The tables of one stage of a flow: ``woe_eva``, ``stable_test``, ``data_stats`` and ``warnings``."""
    numeric = [c for c in columns if is_numeric(train, c)]
    report = level_report(train, test, columns, label, bins)
    a, b = stats.data_stats(train, columns), stats.data_stats(test, columns)
    tests = consistency_tests(train, test, numeric) if numeric else train.sparkSession.createDataFrame([], "feature string, psi double")
    both = a.withColumn("dataset", F.lit("train")).unionByName(b.withColumn("dataset", F.lit("test")))
    return {"woe_eva": in_order(report), "stable_test": tests.orderBy("feature"), "data_stats": both.orderBy("feature", "dataset"), "warnings": report_warnings(report, tests, a, b, limit).orderBy("feature", "kind", "metric")}
