"""Encoders of categorical and continuous columns. A fit is a few aggregations; what it keeps is a
small table by feature and level; a transform is expressions and joins that also work on streams."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .core import declare, exact_quantiles, infer_kinds, lookup, require_columns, to_long, unused

#: Bounds that stand for an infinite weight of evidence.
WOE_MIN, WOE_MAX = -4.6, 4.6


def woe_expr(pos, neg, all_pos, all_neg, woe_min: float = WOE_MIN, woe_max: float = WOE_MAX):
    """ln of the share of positives over the share of negatives; bounds where one is zero."""
    p, n = pos / all_pos, neg / all_neg
    return F.when(pos == 0, F.lit(woe_min)).when(neg == 0, F.lit(woe_max)).otherwise(F.log(F.try_divide(p, n)))


def woe_table(df: DataFrame, columns: list[str], label: str, *keys: str, woe_min: float = WOE_MIN, woe_max: float = WOE_MAX) -> DataFrame:
    """``keys, feature, level, n, pos, neg, woe, iv`` for each level; null is a level.

    All columns share one shuffle on (keys, feature, level); totals, a row for each feature, are summed
    from its result and joined.
    """
    y = F.col(label).cast("long")
    cells = to_long(df.where(F.col(label).isNotNull()), columns, label, *keys)
    g = cells.groupBy(*keys, "feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    g = g.withColumn("neg", F.col("n") - F.col("pos"))
    tp, tn, *names = unused(g, "tp", "tn", *[f"{k}_of" for k in (*keys, "feature")])
    totals = g.groupBy(*[F.col(k).alias(o) for k, o in zip((*keys, "feature"), names)]).agg(F.sum("pos").alias(tp), F.sum("neg").alias(tn))
    match = F.lit(True)
    for k, o in zip((*keys, "feature"), names):
        match = match & F.col(k).eqNullSafe(F.col(o))
    woe = woe_expr(F.col("pos"), F.col("neg"), F.col(tp), F.col(tn), woe_min, woe_max)
    out = g.join(totals, match).withColumn("woe", woe)
    return out.withColumn("iv", (F.try_divide(F.col("pos"), F.col(tp)) - F.try_divide(F.col("neg"), F.col(tn))) * F.col("woe")).drop(tp, tn, *names)


def information_value(df: DataFrame, columns: list[str], label: str, *keys: str) -> DataFrame:
    return woe_table(df, columns, label, *keys).groupBy(*keys, "feature").agg(F.sum("iv").alias("iv"))


class _LevelMap:
    """Shared by encoders that map a level to a number: ``table`` has feature, level, value."""

    table: DataFrame
    sizes: dict[str, int]

    def _keep(self, table: DataFrame) -> None:
        self.table = table.select("feature", "level", "value").persist()
        self.sizes = {r[0]: r[1] for r in self.table.groupBy("feature").count().collect()}

    def _map(self, df: DataFrame, default: dict[str, float] | float | None) -> DataFrame:
        require_columns(df, self.columns)
        for c in self.columns:
            d = default.get(c) if isinstance(default, dict) else default
            df = lookup(df, self.table.where(F.col("feature") == c), self.sizes.get(c, 0), c, "level", "value", f"{c}{self.suffix}", None if d is None else F.lit(d))
        return df


@dataclass
class WOEEncoder(_LevelMap):
    """Weight of evidence of each level; null is a level, unseen levels take null's value or 0, or with
    ``unseen='rate'`` the overall rate, as the older form does.

    ``null_policy='smoothed'`` is the older form: null's positives and negatives get
    ``int(n * m * nan_thr)`` more, where m is the class's share, and values are clipped.
    """

    cate_threshold: int = 200
    woe_min: float = WOE_MIN
    woe_max: float = WOE_MAX
    suffix: str = "_woe"
    columns: list[str] | None = None
    null_policy: str = "level"
    nan_thr: float = 0.01
    unseen: str = "null"

    def fit(self, df: DataFrame, label: str) -> WOEEncoder:
        if self.columns is None:
            self.columns = [c for c in infer_kinds(df, self.cate_threshold).cate if c != label]
        t = woe_table(df, self.columns, label, woe_min=self.woe_min, woe_max=self.woe_max)
        if self.null_policy == "smoothed":
            n, p = df.agg(F.count(label), F.avg(F.col(label).cast("double"))).first()
            more = lambda share: int(n * (share or 0) * self.nan_thr)
            sp, sn = (F.col("pos") + more(p)) / F.lit(max(n * (p or 0), 1)), (F.col("neg") + more(1 - (p or 0))) / F.lit(max(n * (1 - (p or 0)), 1))
            smooth = F.when((sp == 0) & (sn == 0), 0.0).when(sp == 0, self.woe_min).when(sn == 0, self.woe_max).otherwise(F.log(F.try_divide(sp, sn)))
            t = t.withColumn("woe", F.greatest(F.lit(self.woe_min), F.least(F.lit(self.woe_max), F.when(F.col("level").isNull(), smooth).otherwise(F.col("woe")))))
        self.levels = t
        self._keep(t.withColumn("value", F.col("woe")))
        self.iv = {r[0]: r[1] for r in t.groupBy("feature").agg(F.sum("iv")).collect()}
        null = {r["feature"]: r["value"] for r in self.table.where("level is null").collect()}
        self.default = {c: null.get(c, 0.0) for c in self.columns}
        if self.unseen == "rate":
            self.default = dict.fromkeys(self.columns, float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0))
        elif self.unseen != "null":
            raise ValueError(f"unknown value for unseen levels {self.unseen!r}")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.default)


@dataclass
class CountEncoder(_LevelMap):
    """Share of the rows with the same level, null a level, unseen 0; ``mode='log_count'`` is the
    older ``ln(count + smoothing)`` with ``unseen_value + smoothing`` for unseen levels."""

    suffix: str = "_count"
    columns: list[str] | None = None
    mode: str = "ratio"
    smoothing: float = 1.0
    unseen_value: float = 0.0

    def fit(self, df: DataFrame, label: str | None = None) -> CountEncoder:
        if self.columns is None:
            self.columns = [c for c in infer_kinds(df).cate if c != label]
        g = to_long(df, self.columns).groupBy("feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        total = g.groupBy("feature").agg(F.sum("n").alias("total"))
        self._keep(g.join(total, "feature").withColumn("value", F.col("n") / F.col("total") if self.mode == "ratio" else F.log(F.col("n") + self.smoothing)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, 0.0 if self.mode == "ratio" else math.log(self.unseen_value + self.smoothing) if self.unseen_value + self.smoothing > 0 else 0.0)


def numbered(levels: DataFrame) -> DataFrame:
    """Add ``number``: the place, from 1, of each ``value`` among those of its ``feature``, all distinct.

    Levels are dealt in order over as many tasks as they fill, numbered there and shifted by the
    tasks before, a row for each task and feature; no task sorts a column. The dealt levels stay
    in memory or on disk, so that both steps see the same tasks.
    """
    dealt = levels.repartitionByRange("feature", "value").withColumn("task", F.spark_partition_id()).persist()
    ahead = W.partitionBy("feature").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("feature", "task").agg(F.count(F.lit(1)).alias("n")).select("feature", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("feature", "task").orderBy("value"))
    return dealt.withColumn("number", own).join(before, ["feature", "task"]).select("feature", "value", (F.col("number") + F.col("before")).alias("number"))


@dataclass
class LabelEncoder(_LevelMap):
    """Codes 1..k of the sorted levels, null and unseen 0. ``across=True`` goes on counting from
    column to column, as the older form does."""

    suffix: str = "_label"
    columns: list[str] | None = None
    across: bool = False

    def fit(self, df: DataFrame, label: str | None = None) -> LabelEncoder:
        if self.columns is None:
            self.columns = [c for c in infer_kinds(df).cate if c != label]
        g = to_long(df, self.columns).where("value is not null").distinct() if self.columns else None
        if g is None:
            self.columns = []
            self.table, self.sizes = df.sparkSession.createDataFrame([], "feature string, level string, value double"), {}
            return self
        coded = numbered(g).select("feature", F.col("value").alias("level"), F.col("number").cast("double").alias("value"))
        if self.across:
            n, start = {r[0]: r[1] for r in coded.groupBy("feature").count().collect()}, F.lit(0)
            before = 0
            for c in self.columns:
                start = F.when(F.col("feature") == c, before).otherwise(start)
                before += n.get(c, 0)
            coded = coded.withColumn("value", F.col("value") + start)
        self._keep(coded)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, 0.0)


@dataclass
class OneHotEncoder:
    """A 0/1 column ``<col>_<i><suffix>`` for each sorted level; null and unseen levels are all 0.
    ``sparse=True`` gives one sparse vector column ``onehot`` instead. Columns with more than
    ``most_levels`` levels are refused: a table cannot have that many columns."""

    suffix: str = "_onehot"
    columns: list[str] | None = None
    sparse: bool = False
    most_levels: int = 5000

    def fit(self, df: DataFrame, label: str | None = None) -> OneHotEncoder:
        self.columns = self.columns or [c for c in infer_kinds(df).cate if c != label]
        levels = to_long(df, self.columns).where("value is not null").distinct()
        if many := [r["feature"] for r in levels.groupBy("feature").count().collect() if r["count"] > self.most_levels]:
            raise ValueError(f"too many levels for columns of their own: {many}")
        found: dict[str, list[str]] = {}
        for r in levels.orderBy("feature", "value").collect():
            found.setdefault(r["feature"], []).append(r["value"])
        self.levels = {c: found.get(c, []) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.columns)
        flags = {f"{c}_{i}{self.suffix}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for c in self.columns for i, v in enumerate(self.levels[c], 1)}
        if not self.sparse:
            return df.withColumns(flags) if flags else df
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=list(flags), outputCol="onehot").transform(df.withColumns(flags)).drop(*flags)


@dataclass
class TargetEncoder(_LevelMap):
    """Mean of the label by level, drawn to the overall rate: ``(sum + s n p) / (n + s n)``; unseen
    levels take the overall rate. ``noise`` adds a seeded normal term for each level, off by default."""

    smoothing: float = 0.1
    noise: float = 0.0
    seed: int = 10
    suffix: str = "_target"
    columns: list[str] | None = None

    def fit(self, df: DataFrame, label: str) -> TargetEncoder:
        self.columns = self.columns or [c for c in infer_kinds(df).cate if c != label]
        self.rate = float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)
        g = to_long(df, self.columns, label).groupBy("feature", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
        value = (F.col("s") + self.smoothing * F.col("n") * self.rate) / (F.col("n") * (1 + self.smoothing))
        if self.noise:
            u = lambda k: (F.pmod(F.xxhash64(F.lit(self.seed + k), "feature", "level"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
            value = value + self.noise * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
        self._keep(g.withColumn("value", value))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, self.rate)


@dataclass
class ImputeEncoder:
    """Null, NaN and the text ``nan`` to a fixed value."""

    fillna_value: float = -999
    columns: list[str] | None = None

    def fit(self, df: DataFrame, label: str | None = None) -> ImputeEncoder:
        self.columns = self.columns or df.columns
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        def fill(c):
            kind = kinds[c]
            missing = F.col(c).isNull() | ((F.lower(F.col(c)) == "nan") if kind == "string" else F.isnan(c) if kind in ("double", "float") else F.lit(False))
            return F.when(missing, F.lit(self.fillna_value).cast(kind)).otherwise(F.col(c))
        return df.withColumns({c: fill(c) for c in self.columns})


@dataclass
class ContImputerEncoder:
    """Null to the column's mean, exact median or most frequent value; all-null columns go."""

    strategy: str = "mean"
    columns: list[str] | None = None

    def fit(self, df: DataFrame, label: str | None = None) -> ContImputerEncoder:
        self.columns = self.columns or [c for c in infer_kinds(df).cont if c != label]
        if self.strategy == "most_frequent":
            g = to_long(df, self.columns, as_type="double").where("value is not null").groupBy("feature", "value").count()
            best = F.min(F.struct((-F.col("count")).alias("m"), "value"))
            found = {r["feature"]: r["b"]["value"] for r in g.groupBy("feature").agg(best.alias("b")).collect()}
        else:
            if self.strategy == "median":
                found = {c: q[0] for c, q in exact_quantiles(df, dict.fromkeys(self.columns, [0.5])).items() if q}
            elif self.strategy == "mean":
                found = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in self.columns]).first().asDict() if self.columns else {}
            else:
                raise ValueError(f"unknown strategy {self.strategy!r}")
        self.values = {c: found[c] for c in self.columns if found.get(c) is not None}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        gone = [c for c in self.columns if c not in self.values]
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.values.items()}).drop(*gone)


@dataclass
class AppCateEncoder:
    """Delimited names to the number of distinct names of each category, and its share.

    Names are trimmed and counted once; a null list gives nulls, an absent category 0. Names that
    the dictionary lacks count as ``unknown`` if that is given, else not at all.
    """

    names: dict[str, str] = field(default_factory=dict)
    delimiter: str = "|"
    prefix: str = "app_"
    unknown: str | None = None
    columns: list[str] | None = None

    def fit(self, df: DataFrame | None = None, label: str | None = None) -> AppCateEncoder:
        self.categories = sorted(set(self.names.values()) | ({self.unknown} if self.unknown else set()))
        return self

    def transform(self, df: DataFrame, column: str | None = None) -> DataFrame:
        """Of ``column``, or of all ``columns``; with several each one's name leads its results."""
        columns = [column] if column else self.columns or []
        for c in columns:
            df = self._one(df, c, self.prefix if len(columns) == 1 else f"{c}_{self.prefix}")
        return df

    def _one(self, df: DataFrame, column: str, prefix: str) -> DataFrame:
        names = F.array_distinct(F.transform(F.split(F.col(column), f"\\Q{self.delimiter}\\E"), F.trim))
        table = F.create_map(*[F.lit(x) for kv in self.names.items() for x in kv]) if self.names else F.lit(None).cast("map<string,string>")
        mapped = F.transform(names, lambda x: F.coalesce(F.element_at(table, x), F.lit(self.unknown)))
        out = df.withColumn("__c", mapped)
        same = lambda c: lambda x: x == F.lit(c)
        counts = {f"{prefix}{c}": F.size(F.filter("__c", same(c))) for c in self.categories}
        counts = {k: F.when(F.col("__c").isNotNull(), v) for k, v in counts.items()}
        if not counts:
            return df
        total = sum((F.col(k) for k in counts), F.lit(0))
        return out.withColumns(counts).withColumns({f"{k}_ratio": F.try_divide(F.col(k), total) for k in counts}).drop("__c")


@dataclass
class IndexValueEncoder:
    """Rows as (index, value) arrays for factorisation machines: a continuous column has one index
    and its value, a categorical one an index for each level, one for unseen levels, and value 1."""

    cate: list[str] = field(default_factory=list)
    cont: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame, label: str | None = None) -> IndexValueEncoder:
        if not self.cate and not self.cont:
            kinds = infer_kinds(df, columns=[c for c in df.columns if c != label])
            self.cate, self.cont = kinds.cate, kinds.cont
        self.start, at = {}, 0
        for c in self.cont:
            self.start[c], at = at, at + 1
        self.codes = LabelEncoder(columns=self.cate, suffix="__code").fit(df)
        for c in self.cate:
            self.start[c], at = at, at + self.codes.sizes.get(c, 0) + 1
        self.size = at
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.codes.transform(df)
        idx = [F.lit(self.start[c]) for c in self.cont] + [(F.lit(self.start[c]) + F.col(f"{c}__code")).cast("int") for c in self.cate]
        val = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.cont] + [F.lit(1.0)] * len(self.cate)
        return out.withColumns({"idx": F.array(*idx), "val": F.array(*val)}).drop(*[f"{c}__code" for c in self.cate])


@dataclass
class ReduceGen:
    """Distances to k-means centres, or principal components, of mean-filled columns."""

    method: str = "PCA"
    k: int = 2
    prefix: str = "reduce"
    columns: list[str] | None = None
    seed: int = 7

    def fit(self, df: DataFrame, label: str | None = None) -> ReduceGen:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import PCA, VectorAssembler

        self.fill = ContImputerEncoder(columns=self.columns).fit(df)
        self.columns = list(self.fill.values)
        self.assembler = VectorAssembler(inputCols=self.columns, outputCol="__x")
        x = self.assembler.transform(self.fill.transform(df)).select("__x").persist()
        if self.method == "KMeans":
            self.points = [list(map(float, c)) for c in KMeans(k=self.k, seed=self.seed, featuresCol="__x").fit(x).clusterCenters()]
        elif self.method == "PCA":
            m = PCA(k=self.k, inputCol="__x", outputCol="__y").fit(x)
            self.points = m.pc.toArray().T.tolist()
        else:
            raise ValueError(f"unknown reduction {self.method!r}")
        x.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.fill.values.items()]
        if self.method == "KMeans":
            made = [F.sqrt(sum(((x - p) * (x - p) for x, p in zip(filled, point, strict=True)), F.lit(0.0))) for point in self.points]
        else:
            mean = [self.fill.values[c] for c in self.columns]
            made = [sum(((x - m) * p for x, m, p in zip(filled, mean, point, strict=True)), F.lit(0.0)) for point in self.points]
        return df.withColumns({f"{self.prefix}_{i}": c for i, c in enumerate(made)})


@dataclass
class FriedScale:
    """Columns cut at the quantiles ``q`` and ``1 - q`` and brought to a standard deviation of 0.4
    (columns of at most two values stay)."""

    trim_quantile: float = 0.025
    columns: list[str] | None = None

    def fit(self, df: DataFrame, label: str | None = None) -> FriedScale:
        from .core import distinct_counts

        self.columns = self.columns or [c for c in infer_kinds(df).cont if c != label]
        n = distinct_counts(df, self.columns)
        wide = [c for c in self.columns if n[c] > 2]
        q = [self.trim_quantile, 1 - self.trim_quantile]
        r = exact_quantiles(df, dict.fromkeys(wide, q))
        self.bounds = {c: tuple(r[c]) for c in wide}
        s = df.agg(*[F.stddev_pop(self._cut(c)).alias(c) for c in wide]).first() if wide else {}
        self.scale = {c: 0.4 / s[c] if s[c] else 1.0 for c in wide}
        return self

    def _cut(self, c: str):
        lo, hi = self.bounds[c]
        return F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c).cast("double"))))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self._cut(c) * k for c, k in self.scale.items()}) if self.scale else df


def combined_iv(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """IV of several columns taken as one: their values joined to one level."""
    joined = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    return information_value(df.select(label, joined.alias("+".join(columns))), ["+".join(columns)], label)


#: Category encoders by their short names.
CATEGORY_ENCODERS = {"onehot": OneHotEncoder, "label": LabelEncoder, "target": TargetEncoder, "count": CountEncoder, "woe": WOEEncoder}


def category_encoder(method: str, **params):
    """An encoder by short name; unknown names are refused."""
    if method not in CATEGORY_ENCODERS:
        raise ValueError(f"unknown category encoder {method!r}")
    return CATEGORY_ENCODERS[method](**params)


__all__ = ["AppCateEncoder", "ContImputerEncoder", "CountEncoder", "FriedScale", "ImputeEncoder", "IndexValueEncoder", "LabelEncoder", "OneHotEncoder", "ReduceGen", "TargetEncoder", "WOEEncoder", "category_encoder", "combined_iv", "declare", "information_value", "woe_table"]
