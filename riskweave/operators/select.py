"""Choosing columns: by missing and repeated values, stability, univariate scores and models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import is_numeric, require_columns, to_long
from .drift import f_tail, psi
from .stats import level_counts

FILL = -999


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, missing, same, unique``: shares of nulls, of the most frequent value (1 for an
    all-null column) and of distinct values among all rows; one shuffle for all columns."""
    g = level_counts(df, columns)
    n = F.sum("n")
    return g.groupBy("feature").agg((F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / n).alias("missing"), (F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), n) / n).alias("same"), (F.count("value") / n).alias("unique"))


def _described(inputs: list[str], kept: list[str], ranking: dict[str, int] | None = None, **measures: dict[str, float]) -> list[dict]:
    """What every filter says of its columns, one row each: ``feature, support, ranking, score, pvalue,
    importance`` and ``detail``, further measures by name. ``support`` is whether it stays, ``ranking``
    1 for the first to stay (without a ranking: 1 for all that stay, 2 for the rest); a measure that
    a filter does not take is None. Rows go by ranking, then by name."""
    plain = lambda v: None if v is None or v != v else float(v)
    rows = [
        {"feature": c, "support": c in kept, "ranking": ranking[c] if ranking else 1 if c in kept else 2}
        | {k: plain(measures.get(k, {}).get(c)) for k in ("score", "pvalue", "importance")}
        | {"detail": {k: plain(v.get(c)) for k, v in measures.items() if k not in ("score", "pvalue", "importance")}}
        for c in inputs
    ]
    return sorted(rows, key=lambda r: (r["ranking"], r["feature"]))


@dataclass
class QualityFilter:
    """Drops columns with too many nulls, one value too often, or too many texts."""

    missing_thr: float = 0.8
    same_thr: float = 0.8
    cate_thr: float = 0.9

    def fit(self, df: DataFrame, label: str | None = None) -> QualityFilter:
        columns = [c for c in df.columns if c != label]
        quality = column_quality(df, columns).collect()
        self.exclude = [r["feature"] for r in quality if r["missing"] > self.missing_thr or r["same"] > self.same_thr or (not is_numeric(df, r["feature"]) and r["unique"] > self.cate_thr)]
        self.columns = [c for c in columns if c not in self.exclude]
        self.features = _described(columns, self.columns, **{k: {r["feature"]: r[k] for r in quality} for k in ("missing", "same", "unique")})
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.exclude)


@dataclass
class StableFilter:
    """Drops columns whose PSI from train to test is above the limit or undefined."""

    limit: float = 0.2
    columns: list[str] | None = None

    def fit(self, train: DataFrame, test: DataFrame, label: str | None = None) -> StableFilter:
        columns = self.columns or [c for c in train.columns if c != label and is_numeric(train, c)]
        self.psi = {r["feature"]: r["psi"] for r in psi(train, test, columns).collect()}
        self.exclude = [c for c in columns if self.psi.get(c) is None or not self.psi[c] <= self.limit]
        self.features = _described(columns, [c for c in columns if c not in self.exclude], score=self.psi)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.exclude)


def anova(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``feature, f, df1, df2``: one-way analysis of variance of filled columns between classes, from
    counts, sums and squares by class."""
    x = to_long(df.fillna(FILL, columns), columns, label, as_type="double")
    g = x.groupBy("feature", label).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    between = F.col("between") - F.col("S") * F.col("S") / F.col("N")
    d1, d2 = F.col("k") - 1, F.col("N") - F.col("k")
    return t.select("feature", F.try_divide(between / d1, F.col("within") / d2).alias("f"), d1.alias("df1"), d2.alias("df2"))


@dataclass
class _Chosen:
    columns: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.columns)
        gone = [c for c in self.inputs if c not in self.columns]
        return df.drop(*gone)


@dataclass
class SelectKBest(_Chosen):
    """The ``k`` columns of smallest p-value of the F test (then largest F, then name)."""

    k: int = 10

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> SelectKBest:
        self.inputs = columns or [c for c in df.columns if c != label]
        rows = anova(df, self.inputs, label).collect()
        self.report = sorted(((r["feature"], r["f"], f_tail(r["f"], r["df1"], r["df2"]) if r["f"] is not None else 1.0) for r in rows), key=lambda x: (x[2], -(x[1] or 0), x[0]))
        self.columns = [x[0] for x in self.report[: min(self.k, len(self.report))]]
        self.features = _described(self.inputs, self.columns, {x[0]: i for i, x in enumerate(self.report, 1)}, score={c: f for c, f, _ in self.report}, pvalue={c: p for c, _, p in self.report})
        return self


@dataclass
class SelectFromModel(_Chosen):
    """The ``n`` columns of largest importance in a fitted model."""

    estimator: str = "RandomForestClassifier"
    params: dict = field(default_factory=dict)
    n: int = 10

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> SelectFromModel:
        from .models import importances

        self.inputs = columns or [c for c in df.columns if c != label]
        self.report = importances(df, self.inputs, label, self.estimator, self.params)
        self.columns = [c for c, _ in self.report[: self.n]]
        self.features = _described(self.inputs, self.columns, {c: i for i, (c, _) in enumerate(self.report, 1)}, importance=dict(self.report))
        return self


@dataclass
class RFE(_Chosen):
    """Refits without the least important column until ``n`` are left."""

    estimator: str = "LogisticRegression"
    params: dict = field(default_factory=dict)
    n: int = 10

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> RFE:
        from .models import importances

        self.inputs = columns or [c for c in df.columns if c != label]
        left, self.ranking = list(self.inputs), {}
        while len(left) > self.n:
            worst = importances(df, left, label, self.estimator, self.params)[-1][0]
            self.ranking[worst] = len(left) - self.n + 1
            left.remove(worst)
        self.ranking |= dict.fromkeys(left, 1)
        self.columns = left
        self.features = _described(self.inputs, left, self.ranking, importance=dict(importances(df, left, label, self.estimator, self.params)) if left else {})
        return self


@dataclass
class LRFilter(_Chosen):
    """``coef``: refit logistic regression while a coefficient is negative, keeping positive ones.
    ``stepwise``: add the column of smallest p-value while it is at most ``alpha``, then drop once
    those that no longer are. Models have no intercept in the stepwise form."""

    method: str = "coef"
    alpha: float = 0.05
    n: int = 10

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> LRFilter:
        from .models import coefficients, p_values

        self.inputs = columns or [c for c in df.columns if c != label]
        df = df.fillna(FILL, self.inputs)
        if self.method == "coef":
            left, dropped, coef = list(self.inputs), [], {}
            while left:
                coef = coefficients(df, left, label)
                bad = [c for c in left if coef[c] < 0]
                if not bad:
                    break
                dropped.append([c for c in left if not coef[c] > 0])
                left = [c for c in left if coef[c] > 0]
            self.columns = left
            self.ranking = dict.fromkeys(left, 1) | {c: 2 + i for i, gone in enumerate(reversed(dropped)) for c in gone}
            self.features = _described(self.inputs, left, self.ranking, importance={c: coef[c] for c in left})
        elif self.method == "stepwise":
            left, chosen = list(self.inputs), []
            while left and len(chosen) < self.n:
                p = {c: p_values(df, [*chosen, c], label)[c] for c in left}
                best = min(left, key=lambda c: (p[c], c))
                if p[best] > self.alpha:
                    break
                chosen.append(best)
                left = [c for c in left if c != best]
            final = p_values(df, chosen, label) if chosen else {}
            self.columns = [c for c in chosen if final[c] <= self.alpha]
            first = [*self.columns, *[c for c in chosen if c not in self.columns]]
            self.ranking = {c: first.index(c) + 1 if c in first else len(first) + 1 for c in self.inputs}
            self.features = _described(self.inputs, self.columns, self.ranking, pvalue=final)
        else:
            raise ValueError(f"unknown method {self.method!r}")
        return self


def features_table(spark: SparkSession, filters: list) -> DataFrame:
    """The reports of fitted filters as one table, ``step, filter`` and the columns of `_described`."""
    kind = "step int, filter string, feature string, support boolean, ranking int, score double, pvalue double, importance double, detail map<string, double>"
    return spark.createDataFrame([(i, type(f).__name__, *r.values()) for i, f in enumerate(filters, 1) for r in getattr(f, "features", [])], kind)


def run_filters(train: DataFrame, test: DataFrame | None, filters: list, label: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame | None, list]:
    """Fit filters one after the other on train and apply each to both; stops when no column is left."""
    for f in filters:
        columns = [c for c in train.columns if c != label and c not in keep]
        if not columns:
            break
        if isinstance(f, StableFilter):
            f.columns = f.columns or [c for c in columns if is_numeric(train, c)]
            f.fit(train, test, label)
        elif isinstance(f, QualityFilter):
            f.fit(train.drop(*keep), label)
        else:
            f.fit(train, label, columns)
        train, test = f.transform(train), f.transform(test) if test is not None else None
    return train, test, filters
