"""Drift between two data sets: stability indices, two-sample tests, covariate shift, consistency."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .binning import HistogramEncoder, bin_column, heavy_quantiles, quantiles
from .core import coerce_numeric, cumulate_within, is_numeric, stack_datasets, to_long
from .stats import binned_woe_report, woe_report


def psi_term(p: Column, q: Column, smooth: float = 0.01) -> Column:
    """(p - q) ln(p / q) after adding ``smooth`` to both shares."""
    return (p - q) * F.log((p + smooth) / (q + smooth))


def psi_edges(train: DataFrame, columns: list[str], bins: int = 10, range_ratio: float = 0.2, plain: bool = False) -> dict[str, list[float]]:
    """Outer and inner edges: heavy values and quantiles of the rest (``plain``: quantiles alone),
    the outer ones widened by ``range_ratio`` of the span."""
    edges = {c: sorted(set(e)) for c, e in (quantiles(train, columns, [i / bins for i in range(bins + 1)]) if plain else heavy_quantiles(train, columns, bins)).items()}
    return {c: [e[0] - range_ratio * (e[-1] - e[0]), *e[1:-1], e[-1] + range_ratio * (e[-1] - e[0])] if len(e) > 1 else [e[0] - range_ratio, e[0] + range_ratio] if e else [] for c, e in edges.items()}


def psi(train: DataFrame, test: DataFrame, columns: list[str], bins: int = 10, smooth: float = 1e-4, limit: float = 10.0, range_ratio: float = 0.2, plain: bool = False) -> DataFrame:
    """``feature, psi, extreme_ratio``: stability of each column from train to test.

    Shares are of the rows within the outer edges; the actual counts get ``smooth`` more, logarithms
    are cut at ``limit``; ``extreme_ratio`` is the share of test values outside. One shuffle of
    bin counts for all columns and both data sets.
    """
    edges = psi_edges(train, columns, bins, range_ratio, plain)
    edges = {c: e for c, e in edges.items() if e}

    def counted(df):
        cells = []
        for c, e in edges.items():
            x = F.col(c).cast("double")
            outside = (x < e[0]) | (x > e[-1])
            cells.append(F.struct(F.lit(c).alias("feature"), F.when(outside, F.lit(0)).otherwise(bin_column(x, e[1:-1], missing=None)).alias("bin")))
        return df.select(F.inline(F.array(*cells))).where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))

    bins_of = train.sparkSession.createDataFrame([(c, i) for c, e in edges.items() for i in range(len(e))], "feature string, bin int")
    x = bins_of.join(counted(train).withColumnRenamed("n", "e"), ["feature", "bin"], "left").join(counted(test).withColumnRenamed("n", "a"), ["feature", "bin"], "left").fillna(0, ["e", "a"])
    inside, w = F.col("bin") > 0, W.partitionBy("feature")
    sums = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0)).over(w)
    k = F.sum(F.when(inside, 1).otherwise(0)).over(w)
    x = x.withColumns({"pe": F.try_divide(F.col("e"), sums("e")), "pa": F.try_divide(F.col("a") + smooth, sums("a") + k * smooth), "out": F.try_divide(F.sum(F.when(~inside, F.col("a")).otherwise(0)).over(w), F.sum("a").over(w))})
    log = F.when(F.col("pe") == 0, limit).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log(F.try_divide("pa", "pe")))))
    return x.groupBy("feature").agg(F.sum(F.when(inside, (F.col("pa") - F.col("pe")) * log)).alias("psi"), F.first("out").alias("extreme_ratio"))


def report_psi(train_report: DataFrame, test_report: DataFrame, value: str, smooth: float = 0.01) -> DataFrame:
    """``feature, psi`` over a column of two WOE reports, levels matched; an absent level is 0."""
    a = train_report.select("feature", "level", F.col(value).alias("p"))
    b = test_report.select(F.col("feature").alias("f"), F.col("level").alias("l"), F.col(value).alias("q"))
    x = a.join(b, a["feature"].eqNullSafe(b["f"]) & a["level"].eqNullSafe(b["l"]), "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return x.groupBy(F.coalesce("feature", "f").alias("feature")).agg(F.sum(psi_term(p, q, smooth)).alias("psi"))


def volume_psi(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> DataFrame:
    """V-PSI: stability of the levels' shares of the rows."""
    return report_psi(woe_report(train, columns, label), woe_report(test, columns, label), "group_sample_ratio")


def label_psi(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> DataFrame:
    """L-PSI: stability of the levels' label rates."""
    return report_psi(woe_report(train, columns, label), woe_report(test, columns, label), "overdue_ratio")


def binned_psi(train: DataFrame, test: DataFrame, binner, label: str) -> DataFrame:
    """``feature, v_psi, l_psi``: both stabilities over the bins of an encoder fitted on train, for
    continuous and categorical columns alike."""
    a, b = binned_woe_report(train, binner, label), binned_woe_report(test, binner, label)
    v, r = (report_psi(a, b, c).withColumnRenamed("psi", k) for c, k in (("group_sample_ratio", "v_psi"), ("overdue_ratio", "l_psi")))
    return v.join(r, "feature")


def histogram_psi(train: DataFrame, test: DataFrame, columns: list[str], diff_thr: int = 20, bins: int = 20, smooth: float = 0.01) -> DataFrame:
    """H-PSI: stability of histograms whose bins come from train; absent bins count 0."""
    h = HistogramEncoder(diff_thr, bins).fit(train, columns)
    share = lambda df, k: h.transform(df).select("feature", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("feature"))).alias(k))
    x = share(train, "p").join(share(test, "q"), ["feature", "bin"], "full").fillna(0.0, ["p", "q"])
    return x.groupBy("feature").agg(F.sum(psi_term(F.col("p"), F.col("q"), smooth)).alias("psi"))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1 - _beta_tail(d1 / 2, d2 / 2, d1 * f / (d1 * f + d2)) if f > 0 else 1.0


def t_two_sided(t: float, d: float) -> float:
    return _beta_tail(d / 2, 0.5, d / (d + t * t))


def ks_tail(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    x = d * math.sqrt(n1 * n2 / (n1 + n2))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def moments(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, dataset, n, nulls, mean, var``: count, nulls, mean and population variance."""
    cells = to_long(stack_datasets(train=train.select(columns), test=test.select(columns)), columns, "dataset", as_type="double")
    return cells.groupBy("feature", "dataset").agg(F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("nulls"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def ks_two_sample(train: DataFrame, test: DataFrame, *columns: str) -> DataFrame:
    """``feature, ks``: largest distance between the two distributions of each column, null values left
    out; all columns in one plan, running sums distributed over ranges within columns. A column
    without values on one side has null."""
    both = stack_datasets(train=train.select(*columns), test=test.select(*columns))
    cells = to_long(both, columns, (F.col("dataset") == "test").cast("int").alias("k"), as_type="double").where("value is not null")
    s = cells.groupBy("feature", F.col("value").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("pos"))
    total = s.groupBy(F.col("feature").alias("of")).agg(F.sum(F.col("n") - F.col("pos")).alias("ta"), F.sum("pos").alias("tb"))
    c = cumulate_within(s, ["feature"], "score", {"cn": "n", "cp": "pos"}).join(total, F.col("feature") == F.col("of"))
    gap = F.abs(F.try_divide(F.col("cn") - F.col("cp"), F.col("ta")) - F.try_divide(F.col("cp"), F.col("tb")))
    return c.groupBy("feature").agg(F.max(gap).alias("ks"))


def consistency_tests(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, f_p, t_p, ks, ks_p, psi, extreme_ratio, null_train, null_test`` for each column.

    F is one-sided on population variances, t pooled, KS asymptotic; undefined tests are null. As
    many jobs for any number of columns; the driver gets a few rows for each.
    """
    by: dict[str, dict] = {}
    for r in moments(train, test, columns).collect():
        by.setdefault(r["feature"], {})[r["dataset"]] = r
    stable = {r["feature"]: r for r in psi(train, test, columns).collect()}
    furthest = {r["feature"]: r["ks"] for r in ks_two_sample(train, test, *columns).collect()}
    rows = []
    for c in columns:
        a, b = by[c]["train"], by[c]["test"]
        f_p = t_p = k = k_p = None
        if a["n"] > 1 and b["n"] > 1:
            if a["var"] and b["var"]:
                f_p = f_tail(a["var"] / b["var"], a["n"] - 1, b["n"] - 1)
            d = a["n"] + b["n"] - 2
            pooled = (a["n"] * a["var"] + b["n"] * b["var"]) / d
            if pooled > 0:
                t_p = t_two_sided((a["mean"] - b["mean"]) / math.sqrt(pooled * (1 / a["n"] + 1 / b["n"])), d)
            k = furthest[c]
            k_p = ks_tail(k, a["n"], b["n"])
        s = stable.get(c)
        rnd = lambda x: None if x is None else round(float(x), 4)
        rows.append((c, rnd(f_p), rnd(t_p), rnd(k), rnd(k_p), rnd(s and s["psi"]), rnd(s and s["extreme_ratio"]), rnd(a["nulls"] / max(a["n"] + a["nulls"], 1)), rnd(b["nulls"] / max(b["n"] + b["nulls"], 1))))
    return train.sparkSession.createDataFrame(rows, "feature string, f_p double, t_p double, ks double, ks_p double, psi double, extreme_ratio double, null_train double, null_test double")


def dataset_tests(train: DataFrame, test: DataFrame, label: str | None = None, exclude: list[str] = (), covariate_shift: bool = False, id_col: str | None = None):
    """Column sets must agree; tests of every shared numeric column and, if asked, covariate shift."""
    if set(train.columns) != set(test.columns):
        raise ValueError(f"columns differ: {sorted(set(train.columns) ^ set(test.columns))}")
    from .core import is_numeric

    columns = [c for c in train.columns if c not in {label, id_col, *exclude} and is_numeric(train, c)]
    tests = consistency_tests(train, test, columns)
    return (tests, *detect_covariate_shift(train, test, columns, id_col)) if covariate_shift else (tests,)


def detect_covariate_shift(train: DataFrame, test: DataFrame, columns: list[str], id_col: str, folds: int = 5, seed: int = 7, trees: int = 20) -> tuple[DataFrame, float]:
    """Weights of the train rows, and Matthews' coefficient of telling train from test.

    A boosted model tells train (1) from test (0) on each fold from the others; a train row weighs
    ``1 / p - 1``, brought to mean 1. ``(train with weight, mcc)``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    both = train.select(id_col, *columns, F.lit(1).alias("__y")).unionAll(test.select(id_col, *columns, F.lit(0)))
    x = VectorAssembler(inputCols=columns, outputCol="__x").transform(both.fillna(-999, columns)).select(id_col, "__y", "__x").withColumn("__f", F.pmod(F.xxhash64(F.lit(seed), id_col, "__y"), F.lit(folds))).persist()
    parts = None
    for f in range(folds):
        m = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=trees, stepSize=0.1, maxDepth=3, seed=seed).fit(x.where(F.col("__f") != f))
        p = m.transform(x.where(F.col("__f") == f)).select(id_col, "__y", vector_to_array("probability")[1].alias("__p"))
        parts = p if parts is None else parts.unionAll(p)
    r = parts.persist()
    rate = both.agg(F.avg("__y")).first()[0]
    c = r.agg(*[F.sum(((F.col("__p") > rate).cast("int") == a).cast("long") * (F.col("__y") == b).cast("long")).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))]).first()
    under = math.sqrt(float((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"])) * (c["tn"] + c["fn"]))
    mcc = (c["tp"] * c["tn"] - c["fp"] * c["fn"]) / under if under else 0.0
    w = r.where("__y = 1").select(id_col, (1 / F.greatest("__p", F.lit(1e-6)) - 1).alias("weight"))
    mean = w.agg(F.avg("weight")).first()[0] or 1.0
    return train.join(w.withColumn("weight", F.col("weight") / mean), id_col), mcc


def drift_warnings(train_stats: DataFrame, test_stats: DataFrame, metrics: list[str], limit: float = 0.2) -> DataFrame:
    """``feature, metric, train, test, difference``: where ``1 - (test + .01) / (train + .01)`` is
    beyond the limit on either side."""
    a = to_long(train_stats, metrics, F.col("feature").alias("name"), as_type="double").select("name", "feature", F.col("value").alias("train"))
    b = to_long(test_stats, metrics, F.col("feature").alias("name"), as_type="double").select("name", "feature", F.col("value").alias("test"))
    x = a.join(b, ["name", "feature"]).withColumn("difference", 1 - (F.col("test") + 0.01) / (F.col("train") + 0.01))
    return x.where(F.abs("difference") >= limit).select(F.col("name").alias("feature"), F.col("feature").alias("metric"), "train", "test", "difference")


def psi_warnings(stability: DataFrame, limit: float = 0.2) -> DataFrame:
    return stability.where(F.col("psi") >= limit).select("feature", F.lit("psi").alias("metric"), "psi", F.format_string("PSI of %s is %.4f", "feature", "psi").alias("message"))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def common_rows(a: DataFrame, b: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """Shared columns of rows with the same key, as ``a_<c>`` and ``b_<c>``, doubles rounded. Keys
    must be unique in both."""
    for df in (a, b):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    columns = [c for c in common_columns(a, b) if c != key]
    kinds = dict(a.dtypes)
    one = lambda df, k: df.select(key, *[(F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)).alias(f"{k}_{c}") for c in columns])
    return one(a, "a").join(one(b, "b"), key)


def consistency_ratio(pairs: DataFrame, columns: list[str], fill: float | None = -999) -> DataFrame:
    """``feature, raw, filled``: share of the rows whose cells agree, nulls never equal, and after both
    sides are filled with ``fill`` (None fills nothing): a cell that holds it equals a null."""
    kinds = dict(pairs.dtypes)

    def filled(k, c):
        x = F.col(f"{k}_{c}")
        return x if fill is None else F.coalesce(x, F.lit(fill).cast(kinds[f"{k}_{c}"]))

    cells = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False)).alias("r"), F.coalesce(filled("a", c) == filled("b", c), F.lit(False)).alias("f")) for c in columns]
    return pairs.select(F.inline(F.array(*cells))).groupBy("feature").agg(F.avg(F.col("r").cast("double")).alias("raw"), F.avg(F.col("f").cast("double")).alias("filled"))


def difference_values(pairs: DataFrame, key: str, columns: list[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Each cell as ``name1:v1, name2:v2`` where the two differ, else null."""
    text = lambda k, c: F.coalesce(F.col(f"{k}_{c}").cast("string"), F.lit("null"))
    return pairs.select(key, *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.concat(F.lit(f"{names[0]}:"), text("a", c), F.lit(f", {names[1]}:"), text("b", c))).alias(c) for c in columns])


def canonical_list(column, delimiter: str = "|", distinct: bool = False) -> Column:
    """A delimited list with its names sorted, once each if asked."""
    parts = F.split(column, f"\\Q{delimiter}\\E")
    return F.array_join(F.array_sort(F.array_distinct(parts) if distinct else parts), delimiter)


def compare_report(a: DataFrame, b: DataFrame, key: str, list_columns: list[str] = (), names=("a", "b"), delimiter: str = "|"):
    """(ratios, differences) of two data sets with a unique key; delimited lists are sorted first."""
    fix = lambda df: df.withColumns({c: canonical_list(F.col(c), delimiter, True) for c in list_columns}) if list_columns else df
    pairs = common_rows(fix(a), fix(b), key)
    columns = [c for c in common_columns(a, b) if c != key]
    return consistency_ratio(pairs, columns), difference_values(pairs, key, columns, names)


def same_names(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Columns in lower case, then by the names of a map, which is taken in lower case too; two columns
    of one name are refused."""
    names = {k.lower(): v.lower() for k, v in (rename or {}).items()}
    out = [names.get(c.lower(), c.lower()) for c in df.columns]
    if twice := sorted({c for c in out if out.count(c) > 1}):
        raise ValueError(f"columns of one name: {twice}")
    return df.toDF(*out)


def align(key: str, parts: dict[str, DataFrame], rename: dict[str, dict[str, str]] | None = None, digits: int = 3, list_columns: list[str] = (), delimiter: str = "|") -> tuple[DataFrame, list[str], list[str]]:
    """(rows, numbers, texts): the rows whose key is in all data sets, a struct of the shared columns for
    each, and which of those are numbers everywhere, as doubles of ``digits`` places, or texts.

    Names are matched by `same_names`, with a map for each data set that has one. Texts that all parse
    are numbers. Delimited lists are sorted, names once each. Null keys meet nothing; a repeated
    one is refused. Joins are by key, one for each data set.
    """
    if len(parts) < 2 or {"key", "feature"} & {n.lower() for n in parts} or len({n.lower() for n in parts}) < len(parts):
        raise ValueError("two or more data sets by different names, neither key nor feature")
    key, lists = key.lower(), [c.lower() for c in list_columns]
    named = {n: same_names(df, (rename or {}).get(n)) for n, df in parts.items()}
    named = {n: coerce_numeric(df, [c for c in df.columns if c not in (key, *lists)]) for n, df in named.items()}
    for n, df in named.items():
        if df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique in {n}")
    shared = sorted(set.intersection(*[set(df.columns) for df in named.values()]) - {key})
    if not shared:
        raise ValueError("no column is in all data sets")
    numbers = [c for c in shared if c not in lists and all(is_numeric(df, c) for df in named.values())]
    texts = [c for c in shared if c not in numbers]

    def cell(c: str) -> Column:
        x = F.round(F.col(c).cast("double"), digits) if c in numbers else F.col(c).cast("string")
        return (canonical_list(x, delimiter, True) if c in lists else x).alias(c)

    rows = None
    for n, df in named.items():
        one = df.select(F.col(key).alias("key"), F.struct(*[cell(c) for c in shared]).alias(n))
        rows = one if rows is None else rows.join(one, "key")
    return rows, numbers, texts


def agreement(rows: DataFrame, names: list[str], numbers: list[str], texts: list[str], zero: float = 0, missing: float = -999) -> DataFrame:
    """How often the cells of each two data sets agree in `align`'s rows: ``feature, left, right, rows``,
    ``raw`` (nulls never equal), ``at_zero`` and ``at_missing`` (null numbers filled with either, null texts
    equal), ``zero_or_null``, the share that only a zero for a null explains, and ``consistent``, whether
    there is none. One grouped pass for all columns and pairs; no rows, no result."""
    cells = []
    for c in (*numbers, *texts):
        for a, b in itertools.combinations(names, 2):
            x, y = F.col(a)[c], F.col(b)[c]
            filled = [F.coalesce(x, F.lit(float(v))) == F.coalesce(y, F.lit(float(v))) for v in (zero, missing)] if c in numbers else [x.eqNullSafe(y)] * 2
            cells.append(F.struct(F.lit(c).alias("feature"), F.lit(a).alias("left"), F.lit(b).alias("right"), *[k.cast("long").alias(n) for k, n in zip((F.coalesce(x == y, F.lit(False)), *filled), ("r", "z", "m"))]))
    n = F.count(F.lit(1))
    return rows.select(F.inline(F.array(*cells))).groupBy("feature", "left", "right").agg(n.alias("rows"), *[(F.sum(k) / n).alias(out) for k, out in (("r", "raw"), ("z", "at_zero"), ("m", "at_missing"))], ((F.sum("z") - F.sum("m")) / n).alias("zero_or_null"), (F.sum("z") == F.sum("m")).alias("consistent"))


def cell_differences(rows: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """``key, feature`` and each data set's cell as text, for the cells that are not alike in all."""
    cells = [F.struct(F.lit(c).alias("feature"), *[F.col(n)[c].cast("string").alias(n) for n in names]) for c in columns]
    alike = functools.reduce(lambda x, y: x & y, [F.col(names[0]).eqNullSafe(F.col(n)) for n in names[1:]])
    long = rows.select("key", F.explode(F.array(*cells)).alias("cell")).select("key", "cell.*")
    return long.where(~alike)


def compare_all(key: str, parts: dict[str, DataFrame], rename: dict[str, dict[str, str]] | None = None, beside: dict[str, DataFrame] | None = None, digits: int = 3, list_columns: list[str] = (), zero: float = 0, missing: float = -999) -> dict[str, DataFrame]:
    """Two or more data sets by key (`align`): ``rates`` (`agreement`), ``differences`` (`cell_differences`)
    and ``means`` of the numbers, over the common rows, next to those over all rows of further data
    sets ``beside``, which share names but no keys."""
    rows, numbers, texts = align(key, parts, rename, digits, list_columns)
    names = list(parts)
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(n)[c].alias(n) for n in names]) for c in numbers]))) if numbers else None
    means = values.groupBy("feature").agg(*[F.avg(n).alias(n) for n in names]) if numbers else None
    for n, df in (beside or {}).items():
        other = same_names(df, (rename or {}).get(n))
        both = [c for c in numbers if c in other.columns]
        if both:
            means = means.join(compare_means(both, **{n: other}), "feature", "left")
    out = {"rates": agreement(rows, names, numbers, texts, zero, missing), "differences": cell_differences(rows, names, [*numbers, *texts])}
    return out | ({"means": means} if numbers else {})


def compare_means(columns: list[str], **parts: DataFrame) -> DataFrame:
    """``feature`` and the mean of each data set."""
    out = None
    for name, df in parts.items():
        one = to_long(df, columns, as_type="double").groupBy("feature").agg(F.avg("value").alias(name))
        out = one if out is None else out.join(one, "feature", "full")
    return out


def normal_curve(df: DataFrame, column: str, points: int = 101) -> DataFrame:
    """``x, density`` of the normal distribution with the column's mean and deviation, over 3 deviations."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))
    at = m.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("m") + F.col("s") * (i * (6.0 / (points - 1)) - 3))))
    return at.select("x", (F.exp(-0.5 * ((F.col("x") - F.col("m")) / F.col("s")) ** 2) / (F.col("s") * math.sqrt(2 * math.pi))).alias("density"))
