"""Cut points and bins. Bins are closed on the right; the outer ones are open-ended."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import SORTED_VALUES, best_first, cumulate_within, exact_quantiles, held, infer_kinds, null_nans, to_long
from .encoders import WOEEncoder


def bin_column(col: str | Column, cuts: list[float], base: int = 1, missing: int | None = 0) -> Column:
    """Number of the bin ``(cuts[i-1], cuts[i]]``, from ``base``; ``missing`` for null."""
    x = F.col(col) if isinstance(col, str) else col
    if not cuts:
        out = F.when(x.isNotNull(), base)
    else:
        out = F.when(x <= cuts[0], base)
        for i, c in enumerate(cuts[1:], 1):
            out = out.when(x <= c, base + i)
        out = out.when(x.isNotNull(), base + len(cuts))
    return out.otherwise(F.lit(missing).cast("int")).cast("int")


def bin_labels(cuts: list[float], base: int = 1) -> dict[int, str]:
    """Bin number to its interval as text, ``(a, b]``."""
    edges = [-math.inf, *cuts, math.inf]
    return {base + i: f"({a}, {b}]" for i, (a, b) in enumerate(zip(edges, edges[1:]))}


def equal_width(df: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner edges of ``bins`` equal widths between least and greatest; one job for all columns."""
    r = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: [] if r[f"lo_{c}"] is None or r[f"lo_{c}"] == r[f"hi_{c}"] else [r[f"lo_{c}"] + (r[f"hi_{c}"] - r[f"lo_{c}"]) * i / bins for i in range(1, bins)] for c in columns}


def quantiles(df: DataFrame, columns: list[str], probs: list[float], exact: bool = True) -> dict[str, list[float]]:
    """Quantiles of every column: interpolated and exact by narrowing (`core.exact_quantiles`), or
    approximate in one pass."""
    if exact:
        return exact_quantiles(df, dict.fromkeys(columns, probs))
    r = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 100_000).alias(c) for c in columns]).first()
    return {c: list(r[c] or []) for c in columns}


def heavy_quantiles(df: DataFrame, columns: list[str], bins: int = 10, exact: bool = True) -> dict[str, list[float]]:
    """All edges, outer ones included: values holding at least ``0.5 / bins`` of the rows are edges
    of their own, the rest are cut into ``max(bins - k, 2)`` quantiles; where nothing is left but
    such values, they alone are the edges."""
    total = df.agg(*[F.count(F.col(c).cast("double")).alias(c) for c in columns]).first().asDict()
    limit = F.lit(None).cast("double")
    for c, n in total.items():
        limit = F.when(F.col("feature") == c, 0.5 / bins * n).otherwise(limit)
    counted = to_long(df, columns, as_type="double").where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    heavy: dict[str, dict] = {c: {} for c in columns}
    for r in counted.where(F.col("n") >= limit).collect():  # at most 2 * bins values a column
        heavy[r["feature"]][r["value"]] = r["n"]
    rest = df.select(*[F.when(~F.col(c).cast("double").isin(sorted(heavy[c])), F.col(c).cast("double")).alias(c) if heavy[c] else F.col(c).cast("double").alias(c) for c in columns])
    parts = {c: max(bins - len(heavy[c]), 2) for c in columns}
    probs = {c: [i / parts[c] for i in range(parts[c] + 1)] for c in columns}
    if exact:
        got = exact_quantiles(rest, probs, {c: total[c] - sum(heavy[c].values()) for c in columns})
    else:
        got = rest.agg(*[F.percentile_approx(F.col(c), probs[c], 100_000).alias(c) for c in columns]).first()
    return {c: sorted({*heavy[c], *(got[c] or [])}) for c in columns}


def tree_cuts(values: np.ndarray, pos: np.ndarray, neg: np.ndarray, bins: int, depth: int | None = None, least: int = 1) -> list[float]:
    """Cut points of a best-first Gini tree with at most ``bins`` leaves on one sorted feature."""
    cp, cn = np.concatenate([[0], np.cumsum(pos)]), np.concatenate([[0], np.cumsum(neg)])
    place: dict[tuple[int, int], int] = {}

    def impurity(p, n):
        return 2 * p * n / np.maximum(p + n, 1)

    def gain(span: tuple[int, int]) -> float | None:
        lo, hi = span
        at = np.arange(lo + 1, hi)
        lp, ln, rp, rn = cp[at] - cp[lo], cn[at] - cn[lo], cp[hi] - cp[at], cn[hi] - cn[at]
        ok = (lp + ln >= least) & (rp + rn >= least)
        if not ok.any():
            return None
        gains = np.where(ok, impurity(cp[hi] - cp[lo], cn[hi] - cn[lo]) - impurity(lp, ln) - impurity(rp, rn), -1)
        i = int(np.argmax(gains))
        place[span] = int(at[i])
        return float(gains[i]) if gains[i] > 1e-12 else None

    split = best_first((0, len(values)), gain, lambda s: ((s[0], place[s]), (place[s], s[1])), bins - 1, depth or math.ceil(math.sqrt(bins)))
    return sorted(float((values[place[s] - 1] + values[place[s]]) / 2) for s in split)


def _spread_tree_cuts(counted: DataFrame, columns: list[str], bins: int, depth: int | None, least: int, parts: int) -> dict[str, list[float]]:
    """The cut points of `tree_cuts` for columns with more values than a task should hold.

    ``counted`` has ``feature, value, pos, neg``. Running sums of the classes are made once, over ranges
    of each column's values. A round asks for the best splits of all spans, of all columns, that
    the trees need as far as they are known: each row gives the gain of a split behind it, and a
    span keeps the largest. At most ``2 * (bins - 1)`` spans a column are asked for in a round, and
    a round settles at least one more split, mostly a level.
    """
    spark = counted.sparkSession
    sums = cumulate_within(counted, ["feature"], "value", {"cp": "pos", "cn": "neg"}, parts).persist()
    ends = {r["feature"]: r for r in sums.groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("value").alias("hi")).collect()}
    edges = {c: {None: (0.0, 0.0), ends[c]["hi"]: (ends[c]["p"], ends[c]["n"])} for c in columns}
    best: dict[str, dict[tuple, tuple | None]] = {c: {} for c in columns}
    impurity = lambda p, n: F.lit(2.0) * p * n / F.greatest(p + n, F.lit(1.0))
    while True:
        split, unknown = {}, []
        for c in columns:
            known = best[c]

            def gain(span):
                if span not in known:
                    unknown.append((c, span))
                return known[span][0] if known.get(span) else None

            split[c] = [known[s][1] for s in best_first((None, ends[c]["hi"]), gain, lambda s: ((s[0], known[s][1]), (known[s][1], s[1])), bins - 1, depth or math.ceil(math.sqrt(bins)))]
        if not unknown:
            break
        asked = spark.createDataFrame([(c, i, lo, hi, *map(float, edges[c][lo]), *map(float, edges[c][hi])) for i, (c, (lo, hi)) in enumerate(unknown)], "feature string, span int, lo double, hi double, p0 double, n0 double, p1 double, n1 double")
        inside = (sums["feature"] == asked["feature"]) & (asked["lo"].isNull() | (sums["value"] > asked["lo"])) & (sums["value"] < asked["hi"])
        x = sums.join(F.broadcast(asked), inside)
        left, right = (F.col("cp") - F.col("p0"), F.col("cn") - F.col("n0")), (F.col("p1") - F.col("cp"), F.col("n1") - F.col("cn"))
        gains = impurity(F.col("p1") - F.col("p0"), F.col("n1") - F.col("n0")) - impurity(*left) - impurity(*right)
        x = x.where((left[0] + left[1] >= least) & (right[0] + right[1] >= least)).select("span", F.struct(gains.alias("gain"), (-F.col("value")).alias("least"), "cp", "cn").alias("s"))
        found = {r["span"]: r["s"] for r in x.groupBy("span").agg(F.max("s").alias("s")).collect()}
        for i, (c, span) in enumerate(unknown):
            s = found.get(i)
            best[c][span] = None if s is None or s["gain"] <= 1e-12 else (s["gain"], -s["least"])
            if s is not None:
                edges[c][-s["least"]] = (s["cp"], s["cn"])
    after = [(c, at, upto) for c in columns for at, upto in zip(sorted(split[c]), [*sorted(split[c])[1:], ends[c]["hi"]])]
    out: dict[str, list[float]] = {c: [] for c in columns}
    if after:
        cuts = spark.createDataFrame(after, "feature string, at double, upto double")
        beyond = (sums["feature"] == cuts["feature"]) & (sums["value"] > cuts["at"]) & (sums["value"] <= cuts["upto"])
        for r in sums.join(F.broadcast(cuts), beyond).groupBy(cuts["feature"], "at").agg(F.min("value").alias("next")).collect():
            out[r["feature"]].append((r["at"] + r["next"]) / 2)
    sums.unpersist()
    return {c: sorted(v) for c, v in out.items()}


def decision_tree(df: DataFrame, columns: list[str], label: str, bins: int = 10, depth: int | None = None, least: int = 1, quantise: int | None = None, task_values: int = SORTED_VALUES) -> dict[str, list[float]]:
    """Tree cut points of every column: Spark counts labels by value, and trees grow on the counts.

    A column of up to ``task_values`` values grows in one task, the columns next to each other;
    splits of larger ones are searched by all tasks (`_spread_tree_cuts`), with the same result.
    ``quantise`` first brings values up to the next of so many approximate quantiles, at every size
    of table, so that every column fits in a task. NaN counts as missing; a column without values,
    or with one, has no cut.
    """
    x = null_nans(df.select(label, *[F.col(c).cast("double").alias(c) for c in columns]))
    if quantise:
        made = quantiles(x, columns, [i / quantise for i in range(1, quantise + 1)], exact=False)
        edges = {c: np.array(sorted(set(e))) for c, e in made.items() if e}  # at most ``quantise`` numbers a column

        def up(e):
            @F.pandas_udf("double")
            def next_edge(v: pd.Series) -> pd.Series:
                at = np.minimum(np.searchsorted(e, v.to_numpy(float)), len(e) - 1)
                return pd.Series(np.where(v.isna(), np.nan, e[at]))

            return next_edge

        x = x.select(label, *[F.nanvl(up(edges[c])(c), F.lit(None).cast("double")).alias(c) if c in edges else c for c in columns])
    counted = to_long(x, columns, label, as_type="double").where("value is not null").groupBy("feature", "value").agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        return pd.DataFrame({"feature": [key[0]], "cuts": [tree_cuts(pdf["value"].to_numpy(), pdf["pos"].to_numpy(), pdf["neg"].to_numpy(), bins, depth, least)]})

    counted = counted.persist()
    size = {r["feature"]: r["count"] for r in counted.groupBy("feature").count().collect()}
    many = [c for c in columns if size.get(c, 0) > max(task_values, quantise or 0)]
    got = _spread_tree_cuts(counted.where(F.col("feature").isin(many)), many, bins, depth, least, max(32, max(size[c] for c in many) // 1_000_000)) if many else {}
    if few := [c for c in size if c not in many]:
        got |= {r["feature"]: list(r["cuts"]) for r in counted.where(F.col("feature").isin(few)).groupBy("feature").applyInPandas(grow, "feature string, cuts array<double>").collect()}
    counted.unpersist()
    return {c: got.get(c, []) for c in columns}


def monotonic(df: DataFrame, columns: list[str], label: str, start: int = 8) -> dict[str, list[float]]:
    """Fewer and fewer quantiles until the label's mean is monotonic in the feature's mean; one job
    for each number of quantiles and all columns. Cut points are the bins' least values and the
    greatest value; inner ones are returned. Label and columns are kept for these jobs, so that what
    ``df`` joins is joined once."""
    out: dict[str, list[float]] = {}
    with held(df.select(label, *columns)) as rows:
        for q in range(start, 1, -1):
            left = [c for c in columns if c not in out]
            if not left:
                break
            edges = quantiles(rows, left, [i / q for i in range(1, q)])
            binned = rows.select(label, *left, *[bin_column(F.col(c).cast("double"), sorted(set(edges[c])), missing=None).alias(f"__{c}") for c in left])
            cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(f"__{c}").alias("bin")) for c in left])
            got = binned.select(label, F.inline(cells)).where("bin is not null").groupBy("feature", "bin").agg(F.avg("x").alias("mx"), F.avg(label).alias("my"), F.min("x").alias("lo")).collect()
            for c in left:
                own = sorted((r for r in got if r["feature"] == c), key=lambda r: r["mx"])
                ys = [r["my"] for r in own]
                up = all(a < b for a, b in zip(ys, ys[1:]))
                down = all(a > b for a, b in zip(ys, ys[1:]))
                if len(own) > 1 and (up or down):
                    out[c] = [r["lo"] for r in own][1:]
    return {c: out.get(c, []) for c in columns}


def cut_points(df: DataFrame, columns: list[str], method: str = "dt", bins: int = 10, label: str | None = None, exact: bool = True, tree: dict | None = None) -> dict[str, list[float]]:
    """Inner cut points by ``cut``, ``qcut``, ``dt`` or ``monot``. ``tree`` has the ``depth``, ``least`` and
    ``quantise`` of `decision_tree`, which grows on the values themselves or, where not ``exact``, on
    20 000 quantiles."""
    if not columns:
        return {}
    if method == "cut":
        return equal_width(df, columns, bins)
    if method == "qcut":
        return {c: e[1:-1] for c, e in heavy_quantiles(df, columns, bins, exact).items()}
    if method in ("dt", "monot") and label is None:
        raise ValueError(f"{method} needs a label")
    if method == "dt":
        return decision_tree(df, columns, label, bins, **({} if exact else {"quantise": 20_000}) | (tree or {}))
    if method == "monot":
        return monotonic(df, columns, label)
    raise ValueError(f"unknown binning method {method!r}")


@dataclass
class ContBinningEncoder:
    """Continuous columns to bin numbers 1..k, null to 0 (``base`` and ``missing`` for older forms)."""

    bins: int = 10
    method: str = "dt"
    suffix: str = "_bin"
    cate_threshold: int = 20
    columns: list[str] | None = None
    base: int = 1
    missing: int | None = 0
    exact: bool = True
    tree: dict | None = None

    def fit(self, df: DataFrame, label: str | None = None) -> ContBinningEncoder:
        if self.columns is None:
            self.columns = [c for c in infer_kinds(df, self.cate_threshold).cont if c != label]
        self.cuts = cut_points(df, self.columns, self.method, self.bins, label, self.exact, self.tree)
        return self

    @property
    def labels(self) -> dict[str, dict[int, str]]:
        return {c: bin_labels(x, self.base) for c, x in self.cuts.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}{self.suffix}": bin_column(F.col(c).cast("double"), self.cuts[c], self.base, self.missing) for c in self.columns}) if self.columns else df


@dataclass
class CateBinningEncoder:
    """Categorical columns: over ``bins`` levels by tree bins of their WOE, others by ordinal codes
    of the sorted levels; missing and unseen levels are 0."""

    bins: int = 10
    suffix: str = "_woebin"
    columns: list[str] | None = None
    tree: dict | None = None

    def fit(self, df: DataFrame, label: str) -> CateBinningEncoder:
        from .core import distinct_counts
        from .encoders import LabelEncoder

        if self.columns is None:
            self.columns = [c for c in infer_kinds(df).cate if c != label]
        n = distinct_counts(df, self.columns)
        many, few = [c for c in self.columns if n[c] > self.bins], [c for c in self.columns if n[c] <= self.bins]
        self.codes = LabelEncoder(columns=few, suffix=self.suffix).fit(df)
        self.woe = WOEEncoder(columns=many, suffix="__woe").fit(df, label)
        self.binner = ContBinningEncoder(self.bins, "dt", suffix="", columns=[f"{c}__woe" for c in many], tree=self.tree).fit(self.woe.transform(df), label) if many else None
        self.many = many
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.codes.transform(df)
        if self.binner:
            out = self.binner.transform(self.woe.transform(out)).withColumnsRenamed({f"{c}__woe": f"{c}{self.suffix}" for c in self.many})
        return out


@dataclass
class BinningEncoder:
    """Continuous and categorical columns to bin numbers, by kind."""

    cate_threshold: int = 200
    cate_bins: int = 100
    cont_bins: int = 20
    method: str = "dt"
    suffix: str = "_bin"
    tree: dict | None = None

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> BinningEncoder:
        kinds = infer_kinds(df, self.cate_threshold, [c for c in columns or df.columns if c != label])
        self.cont = ContBinningEncoder(self.cont_bins, self.method, self.suffix, columns=kinds.cont, tree=self.tree).fit(df, label)
        self.cate = CateBinningEncoder(self.cate_bins, self.suffix, kinds.cate, self.tree).fit(df, label)
        self.columns = [*kinds.cate, *kinds.cont]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.cont.transform(self.cate.transform(df))


@dataclass
class BinningWOEEncoder:
    """Bins, then the WOE of the bins (columns with ``cate_threshold`` codes or more keep them)."""

    cate_threshold: int = 20
    cate_bins: int = 20
    cont_bins: int = 10
    method: str = "dt"
    suffix: str = "_binwoe"
    tree: dict | None = None

    def fit(self, df: DataFrame, label: str, columns: list[str] | None = None) -> BinningWOEEncoder:
        from .core import distinct_counts

        self.binner = BinningEncoder(self.cate_threshold, self.cate_bins, self.cont_bins, self.method, "__code", self.tree).fit(df, label, columns)
        coded = self.binner.transform(df)
        codes = [f"{c}__code" for c in self.binner.columns]
        n = distinct_counts(coded, codes)
        self.woe = WOEEncoder(columns=[c for c in codes if n[c] < self.cate_threshold], suffix="__woe").fit(coded, label)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.woe.transform(self.binner.transform(df))
        return out.drop(*self.woe.columns).withColumnsRenamed({f"{c}__woe": f"{c.removesuffix('__code')}{self.suffix}" for c in self.woe.columns})


@dataclass
class ClusterBinEncoder:
    """Levels put together by their WOE: WOE, monotonic bins of it, and the WOE of those bins. Null is
    a level; unseen levels are 0, as are columns whose WOE has no monotonic bins."""

    columns: list[str] | None = None
    suffix: str = "_cluster"

    def fit(self, df: DataFrame, label: str) -> ClusterBinEncoder:
        if self.columns is None:
            self.columns = [c for c in infer_kinds(df).cate if c != label]
        self.woe = WOEEncoder(columns=self.columns, suffix="__woe").fit(df, label)
        self.woe.default = dict.fromkeys(self.columns)  # unseen levels have none, and so the bin 0
        x = self.woe.transform(df)
        self.binner = ContBinningEncoder(method="monot", suffix="__bin", columns=[f"{c}__woe" for c in self.columns]).fit(x, label)
        self.last = WOEEncoder(columns=[f"{c}__woe__bin" for c in self.columns], suffix="__woe").fit(self.binner.transform(x), label)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.last.transform(self.binner.transform(self.woe.transform(df)))
        return out.drop(*[f"{c}__woe" for c in self.columns], *self.last.columns).withColumnsRenamed({f"{c}__woe__bin__woe": f"{c}{self.suffix}" for c in self.columns})


@dataclass
class HistogramEncoder:
    """Counts of each column's levels or bins, fixed on one data set and counted on any.

    Categorical (strings, or at most ``diff_thr`` values): the ``bins`` most frequent levels and
    ``others``; null is the level ``nan``. Continuous: quantile bins and ``missing``.
    """

    diff_thr: int = 20
    bins: int = 20

    def fit(self, df: DataFrame, columns: list[str]) -> HistogramEncoder:
        from pyspark.sql import Window as W

        kinds = infer_kinds(df, self.diff_thr + 1, columns)
        self.cate, self.cont = kinds.cate, kinds.cont
        edges = quantiles(df, self.cont, [i / self.bins for i in range(1, self.bins)]) if self.cont else {}
        self.cuts = {c: sorted(set(e)) for c, e in edges.items()}
        levels = to_long(df, self.cate).select("feature", F.coalesce("value", F.lit("nan")).alias("value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")) if self.cate else None
        self.top: dict[str, list[str]] = {c: [] for c in self.cate}
        if levels is not None:
            rank = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "value"))
            for r in levels.withColumn("r", rank).where(F.col("r") <= self.bins).collect():
                self.top[r["feature"]].append(r["value"])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``feature, bin, n``."""
        cells = [F.struct(F.lit(c).alias("feature"), F.when(F.coalesce(F.col(c).cast("string"), F.lit("nan")).isin(self.top[c]), F.coalesce(F.col(c).cast("string"), F.lit("nan"))).otherwise("others").alias("bin")) for c in self.cate]
        for c in self.cont:
            names = bin_labels(self.cuts[c])
            code = bin_column(F.col(c).cast("double"), self.cuts[c], missing=None)
            label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)
            cells.append(F.struct(F.lit(c).alias("feature"), F.coalesce(label, F.lit("missing")).alias("bin")))
        return df.select(F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
