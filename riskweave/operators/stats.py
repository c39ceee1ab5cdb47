"""Profiles of columns, score quality and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .binning import bin_column, bin_labels, quantiles
from .core import BROADCAST_ROWS, cumulate, cumulate_within, distinct_counts, held, is_numeric, null_nans, to_long, unused
from .encoders import woe_table


def _melt(one_row: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """A one-row result with columns ``<name>_<column>`` as ``feature, names...``."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{c}").alias(n) for n in names]) for c in columns])))


def missing_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, missing, cover, saturation``: share of nulls, of values, and of values among the
    rows in which any of the columns has one. One aggregation."""
    any_value = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(any_value.cast("long")).alias("some"), *[F.count(c).alias(f"v_{c}") for c in columns])
    cover = {c: F.col(f"v_{c}") / F.col("n") for c in columns}
    return _melt(a.select(*[x for c in columns for x in ((1 - cover[c]).alias(f"missing_{c}"), cover[c].alias(f"cover_{c}"), (F.col(f"v_{c}") / F.col("some")).alias(f"saturation_{c}"))]), columns, ["missing", "cover", "saturation"])


def level_counts(df: DataFrame, columns: list[str], null_as: str | None = None) -> DataFrame:
    """``feature, value, n``: rows of each value of each column; one shuffle."""
    long = to_long(df, columns)
    value = F.coalesce("value", F.lit(null_as)) if null_as is not None else F.col("value")
    return long.groupBy("feature", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def freq_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, count, unique, top, freq, freq_ratio``; null counts as the value ``nan``, and of
    equally frequent values the smallest is the top."""
    g = level_counts(df, columns, "nan")
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    out = g.groupBy("feature").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
    return out.select("feature", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.m")).alias("freq"), (-F.col("b.m") / F.col("count")).alias("freq_ratio"))


def desc_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """``feature, count, mean, std, min, p25, p50, p75, max`` of numeric columns, in one pass."""
    columns = [c for c in columns if is_numeric(df, c)]
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    names = ["count", "mean", "std", "min", "max"]
    more = [] if exact else [lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 100_000)]
    a = x.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in zip([*names, "q"], [F.count, F.avg, F.stddev_samp, F.min, F.max, *more])])
    if exact:
        q = quantiles(x, columns, [0.25, 0.5, 0.75])
        a = a.withColumns({f"q_{c}": F.array(*[F.lit(v) for v in q[c]]) if q[c] else F.lit(None).cast("array<double>") for c in columns})
    a = a.withColumns({f"p{p}_{c}": F.get(F.col(f"q_{c}"), i) for c in columns for i, p in enumerate((25, 50, 75))})
    return _melt(a, columns, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])


def data_stats(df: DataFrame, columns: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Missing, frequency and descriptive statistics of every column, with its kind."""
    kind = F.lit(None).cast("string")
    for c, k in (kinds or {}).items():
        kind = F.when(F.col("feature") == c, k).otherwise(kind)
    out = missing_stats(df, columns).join(freq_stats(df, columns), "feature")
    return out.join(desc_stats(df, columns).drop("count"), "feature", "left").withColumn("type", kind)


def distribution(df: DataFrame, columns: list[str], few: int = 20, bins: int = 20) -> DataFrame:
    """``feature, bin, n``. Columns that are not numeric or have under ``few`` values: their values
    (the ``bins`` most frequent, ``others+``) and ``missing``. Other columns: equal widths strictly
    between the 5 and 95 % quantiles, a bucket for each tail, and ``missing``."""
    n = distinct_counts(df, columns)
    plain = [c for c in columns if not is_numeric(df, c) or n[c] < few]
    wide = [c for c in columns if c not in plain]
    parts = []
    if plain:
        g = level_counts(df, plain, "missing")
        best = F.row_number().over(W.partitionBy("feature").orderBy(F.desc("n"), "value"))  # tasks keep their first ``bins`` before rows move
        top = g.where("value != 'missing'").withColumn("r", best).where(F.col("r") <= bins).select(F.col("feature").alias("of"), F.col("value").alias("bin"))
        shown = F.when(F.col("value") == "missing", F.col("value")).otherwise(F.coalesce("bin", F.lit("others+")))
        marked = g.join(F.broadcast(top) if len(plain) * bins <= BROADCAST_ROWS else top, (F.col("feature") == F.col("of")) & (F.col("value") == F.col("bin")), "left")
        parts.append(marked.groupBy("feature", shown.alias("bin")).agg(F.sum("n").alias("n")))
    if wide:
        ends = quantiles(df, wide, [0.05, 0.95])
        cells = []
        for c in wide:
            lo, hi = ends[c]
            cuts = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
            code = bin_column(F.col(c).cast("double"), cuts, base=0, missing=None)
            cells.append(F.struct(F.lit(c).alias("feature"), F.coalesce(code.cast("string"), F.lit("missing")).alias("bin")))
        parts.append(df.select(F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def cover_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shares of nulls, distinct values and the most frequent value, and a row for the data set."""
    by = level_counts(df, columns).groupBy("feature").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("unique"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"), F.sum("n").alias("n"))
    out = by.select("feature", (F.col("nulls") / F.col("n")).alias("null_ratio"), (1 - F.col("nulls") / F.col("n")).alias("cover"), (F.col("unique") / F.col("n")).alias("unique_ratio"), (F.coalesce("top", "n") / F.col("n")).alias("same_ratio"))
    whole = by.agg(F.sum("nulls").alias("nulls"), F.sum("n").alias("n")).select(F.lit("dataset").alias("feature"), (F.col("nulls") / F.col("n")).alias("null_ratio"), (1 - F.col("nulls") / F.col("n")).alias("cover"), F.lit(None).cast("double").alias("unique_ratio"), F.lit(None).cast("double").alias("same_ratio"))
    return out.unionByName(whole)


def target_stats(df: DataFrame, label: str, time_col: str, *keys: str) -> DataFrame:
    """Rate, first and last time, and rows."""
    return df.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time"), F.count(F.lit(1)).alias("n"))


def woe_report(df: DataFrame, columns: list[str], label: str, *keys: str) -> DataFrame:
    """WOE table with rates: overdue ratio, share of the rows and IV of the feature. Totals of a feature
    are aggregated from its levels and joined, so no task holds all of them."""
    t = woe_table(df, columns, label, *keys)
    all_n, all_iv, *names = unused(t, "all_n", "all_iv", *[f"{k}_of" for k in (*keys, "feature")])
    totals = t.groupBy(*[F.col(k).alias(o) for k, o in zip((*keys, "feature"), names)]).agg(F.sum("n").alias(all_n), F.sum("iv").alias(all_iv))
    match = F.lit(True)
    for k, o in zip((*keys, "feature"), names):
        match = match & F.col(k).eqNullSafe(F.col(o))
    t = t.join(totals, match)
    return t.select(*keys, "feature", "level", F.col("n").alias("total_sample_num"), F.col("pos").alias("overdue_sample_num"), (F.col("pos") / F.col("n")).alias("overdue_ratio"), (F.col("n") / F.col(all_n)).alias("group_sample_ratio"), "woe", F.col(all_iv).alias("IV"))


def binned_woe_report(df: DataFrame, binner, label: str, *keys: str) -> DataFrame:
    """`woe_report` over the bins of a fitted encoder (``columns`` and ``suffix``), so that
    continuous columns have levels too: the same ones on every data set. Null is the level of the
    encoder's missing bin; ``feature`` is the column."""
    codes = [f"{c}{binner.suffix}" for c in binner.columns]
    binned = binner.transform(df).select(label, *keys, *[F.col(c).alias(c.removesuffix(binner.suffix)) for c in codes])
    return woe_report(binned, list(binner.columns), label, *keys)


def score_edges(df: DataFrame, score: str, bands: int = 10) -> list[float]:
    """Inner edges of quantile bands, with fewer bands until every one has rows. Where the wanted
    number leaves a band empty, all lesser ones are tried in the same jobs."""

    def filled(numbers: list[int]) -> list[float]:
        probs = sorted({i / q for q in numbers for i in range(1, q)})
        at = dict(zip(probs, quantiles(df, [score], probs)[score]))
        edges = {q: [at[i / q] for i in range(1, q)] for q in numbers} if at else {}
        edges = {q: e for q, e in edges.items() if len(set(e)) == q - 1}
        met = df.where(F.col(score).isNotNull()).agg(*[F.collect_set(bin_column(score, e)).alias(f"{q}") for q, e in edges.items()]).first() if edges else {}
        return next((e for q, e in edges.items() if len(met[f"{q}"]) == q), [])

    if bands < 2:
        return []
    return filled([bands]) or filled(list(range(bands - 1, 1, -1)))


def score_bands(df: DataFrame, score: str, label: str, edges: list[float]) -> DataFrame:
    """A row for each band with counts, shares, running shares, bad rates and lift (running share
    of bads over that of rows, from the highest band down)."""
    g = df.groupBy(bin_column(score, edges).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.sum(F.col(label).cast("long")).alias("bad_n"))
    up, down, whole = W.orderBy("band").rowsBetween(W.unboundedPreceding, 0), W.orderBy("band").rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    n, bad = F.sum("n").over(whole), F.sum("bad_n").over(whole)
    names = F.element_at(F.create_map(*[F.lit(x) for kv in bin_labels(edges).items() for x in kv]), F.col("band"))
    return g.select(
        "band", names.alias("interval"), "n", (F.col("n") / n).alias("ratio"), (F.sum("n").over(up) / n).alias("cum_ratio"), "mean_score", "bad_n",
        (F.col("bad_n") / bad).alias("bad_share"), F.sum("bad_n").over(up).alias("cum_bad_n"), (F.sum("bad_n").over(up) / bad).alias("cum_bad_share"),
        (F.col("bad_n") / F.col("n")).alias("bad_rate"), (F.sum("bad_n").over(up) / n).alias("cum_bad_of_all"), (F.sum("bad_n").over(up) / F.sum("n").over(up)).alias("cum_bad_rate"),
        ((F.sum("n").over(up) - F.sum("bad_n").over(up)) / (n - bad)).alias("cum_good_share"), ((F.sum("bad_n").over(down) / bad) / (F.sum("n").over(down) / n)).alias("lift"),
    )


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """``score, n, pos``: one row for each distinct score."""
    y = F.col(label).cast("long")
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """At each distinct score, taken as threshold (``>=``): counts, rates, precision and F1. Ties
    are one point. Running sums are distributed over ranges of the score."""
    s = by_score(df, score, label)
    total = s.agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    c = cumulate(s, "score", {"cum_n": "n", "cum_pos": "pos"}, descending=True).join(F.broadcast(total))  # one row
    tpr, fpr = F.col("cum_pos") / F.col("all_pos"), F.try_divide(F.col("cum_n") - F.col("cum_pos"), F.col("all_n") - F.col("all_pos"))
    precision = F.col("cum_pos") / F.col("cum_n")
    return c.select("score", "n", "pos", "cum_n", "cum_pos", tpr.alias("tpr"), fpr.alias("fpr"), precision.alias("precision"), F.try_divide(2 * precision * tpr, precision + tpr).alias("f1"), (F.col("cum_n") / F.col("all_n")).alias("share"))


def ks(df: DataFrame, score: str, label: str) -> DataFrame:
    """``ks, threshold, share``: the largest distance of the two rates, evaluated after ties."""
    r = roc_points(df, score, label).withColumn("gap", F.col("tpr") - F.col("fpr"))
    return r.agg(F.max("gap").alias("ks"), F.max_by("score", F.struct("gap", "score")).alias("threshold"), F.max_by("share", F.struct("gap", "score")).alias("share"))


def curve_within(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``keys, auc, ks`` of a score within each key (null is a key), exact, ties counting half; null where
    a key has one class.

    Rows without score or label are left out. Scores are counted by key, and running sums are
    distributed over ranges within keys (`core.cumulate_within`): one plan for all keys.
    """
    y = F.col(label).cast("long")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    s = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    return _curves(s, keys, {"n": "n", "pos": "pos"})


def _curves(s: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """``keys, auc, ks`` from counts by key and ``score``: ``n`` and ``pos`` for the AUC, and for the KS those of
    ``counts``."""
    sums = {"cn": "n", "cp": "pos"} | ({"kn": counts["n"], "kp": counts["pos"]} if counts != {"n": "n", "pos": "pos"} else {})
    c = cumulate_within(s, keys, "score", sums)
    kn, kp = (F.col("kn"), F.col("kp")) if "kn" in sums else (F.col("cn"), F.col("cp"))
    neg = F.col("n") - F.col("pos")
    wins = F.sum(F.col("pos").cast("double") * (F.col("cn") - F.col("cp") - neg + neg / 2))
    all_n, all_pos, *names = unused(c, "all_n", "all_pos", *[f"{k}_of" for k in keys])
    total = s.groupBy(*keys).agg(F.sum(counts["n"]).alias(all_n), F.sum(counts["pos"]).alias(all_pos))
    match = F.lit(True)
    for k, o in zip(keys, names):
        match = match & F.col(k).eqNullSafe(F.col(o))
    total = total.select(*[F.col(k).alias(o) for k, o in zip(keys, names)], all_n, all_pos)
    gap = F.abs(F.try_divide(kp, F.col(all_pos)) - F.try_divide(kn - kp, F.col(all_n) - F.col(all_pos)))
    return c.join(total, match).groupBy(*keys).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum(neg)).alias("auc"), F.max(gap).alias("ks"))


def feature_curves(df: DataFrame, columns: list[str], labels: list[str], *keys: str, missing: float = -999) -> DataFrame:
    """``keys, label, feature, auc, ks`` of every column for every label within every key, in one plan:
    AUC with missing values filled and reflected to 0.5 or more, KS of the values there are."""
    cells = [F.struct(F.lit(y).alias("label"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(y).cast("long").alias("y")) for y in labels for c in columns]
    label, feature, value, y = unused(df.select(*keys), "label", "feature", "value", "y")
    long = df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, *[F.col(f"cell.{n}").alias(o) for n, o in zip(("label", "feature", "value", "y"), (label, feature, value, y))])
    filled = long.where(F.col(y).isNotNull()).withColumn("there", F.col(value).isNotNull().cast("long"))
    s = filled.groupBy(*keys, label, feature, F.coalesce(value, F.lit(float(missing))).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum("there").alias("vn"), F.sum(F.col("there") * F.col(y)).alias("vp"))
    out = _curves(s, [*keys, label, feature], {"n": "vn", "pos": "vp"})
    return out.select(*keys, label, feature, F.greatest("auc", 1 - F.col("auc")).alias("auc"), "ks")


def ks_statistic(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``feature, ks``: two-sample statistic of each column between the classes, either sign; all
    columns in one plan."""
    return feature_curves(df, columns, [label]).select("feature", "ks")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``auc``: exact, ties counting half, from counts by distinct score."""
    s = by_score(df, score, label)
    c = cumulate(s, "score", {"cum_n": "n", "cum_pos": "pos"})
    below = F.col("cum_n") - F.col("cum_pos") - (F.col("n") - F.col("pos"))
    wins = F.sum(F.col("pos").cast("double") * (below + (F.col("n") - F.col("pos")) / 2))
    return c.agg((wins / (F.sum("pos").cast("double") * (F.sum("n") - F.sum("pos")))).alias("auc"))


def auc_table(df: DataFrame, columns: list[str], label: str, missing: float = -999) -> DataFrame:
    """``feature, auc``: raw AUC of each column with missing values filled, reflected to 0.5 or more;
    all columns in one plan."""
    return feature_curves(df, columns, [label], missing=missing).select("feature", "auc")


def lift_curve(df: DataFrame, score: str, label: str, cuts: int = 100) -> DataFrame:
    """``band, n, pos, depth, lift``: quantile bands from the highest score down, running response
    over that of all rows."""
    edges = sorted(set(quantiles(df, [score], [i / cuts for i in range(1, cuts)])[score]))
    g = df.groupBy((len(edges) + 2 - bin_column(score, edges)).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    up, whole = W.orderBy("band").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    return g.select("band", "n", "pos", (F.sum("n").over(up) / F.sum("n").over(whole)).alias("depth"), ((F.sum("pos").over(up) / F.sum("n").over(up)) / (F.sum("pos").over(whole) / F.sum("n").over(whole))).alias("lift"))


def lift_at(df: DataFrame, score: str, label: str, tops: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """``top, share, lift``: at the highest threshold that takes a share ``top`` of the rows at least,
    ties taken together, the response over that of all rows."""
    r = roc_points(df, score, label)
    want = F.explode(F.array(*[F.lit(float(t)) for t in tops])).alias("top")
    hit = r.select("*", want).where(F.col("share") >= F.col("top")).groupBy("top").agg(F.min_by(F.struct("share", "precision"), "share").alias("at"))
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double")).alias("base"))
    return hit.join(F.broadcast(base)).select("top", F.col("at.share").alias("share"), F.try_divide(F.col("at.precision"), F.col("base")).alias("lift"))  # one row


def gini(df: DataFrame, actual: str, score: str) -> DataFrame:
    """``gini, gini_norm``: cumulative-loss Gini by score, ties sharing their loss evenly."""

    def one(by):
        s = df.groupBy(F.col(by).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(actual).cast("double")).alias("a"))
        c = cumulate(s, "s", {"cum_n": "n", "cum_a": "a"}, descending=True)
        # the running sums of a tie's n rows rise evenly to the last one
        area = F.sum(F.col("n") * (F.col("cum_a") - F.col("a")) + F.col("a") * (F.col("n") + 1) / 2)
        return c.agg((area / F.sum("a") - (F.sum("n") + 1) / 2).alias("x"), F.sum("n").alias("n")).select((F.col("x") / F.col("n")).alias("gini"))

    a, b = one(score), one(actual).withColumnRenamed("gini", "best")
    return a.join(F.broadcast(b)).select("gini", (F.col("gini") / F.col("best")).alias("gini_norm"))  # one row each


def feature_curve(df: DataFrame, column: str, label: str, *keys: str, few: int = 20, edges: list[float] | None = None) -> DataFrame:
    """``keys, bin, n, rate``: raw levels of a column with at most ``few`` values, else deciles (or
    given edges); bins without rows are there with 0."""
    if edges is None and (not is_numeric(df, column) or distinct_counts(df, [column])[column] <= few):
        return df.groupBy(*keys, F.col(column).cast("string").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    edges = sorted(set(edges if edges is not None else quantiles(df, [column], [i / 10 for i in range(1, 10)])[column]))
    binned = df.select(*keys, bin_column(column, edges).cast("string").alias("bin"), F.col(label).cast("double").alias("y"), F.lit(1).alias("row"))
    bins = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).withColumn("bin", F.explode(F.lit([str(i) for i in range(1, len(edges) + 2)])))
    return _rates(binned.unionAll(bins.select(*keys, "bin", F.lit(None).cast("double"), F.lit(0))), *keys)


def _rates(cells: DataFrame, *keys: str) -> DataFrame:
    """``keys, bin, n, rate`` of cells with ``bin, y`` and ``row``, which is 0 for a place that need not have rows."""
    return cells.groupBy(*keys, "bin").agg(F.sum("row").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("rate"))


def contrast_curves(df: DataFrame, columns: list[str], label: str, part: str, base=None, bins: int = 10, few: int = 20) -> DataFrame:
    """``part, feature, bin, n, rate``: the curves of several columns side by side for every value of ``part``.

    Numeric columns with more than ``few`` values are cut at quantiles of the rows whose ``part`` is
    ``base``, or of all rows without one; other columns keep their levels. A missing value is the bin
    null. Every bin of a column is there in every part, with 0 where it has no rows; columns
    without numbers that have more than ``few`` levels show those that each part has. A null part is a
    part. A base without rows is an error, as its edges would be none. Rows without a label count as
    rows. One plan for all columns and parts; parts never come to the driver. Rows are kept
    while edges and levels are looked for.
    """
    rows = null_nans(df.select(F.col(part).alias("part"), F.col(label).cast("double").alias("y"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    at = {f"c{i}": c for i, c in enumerate(columns)}
    with held(rows):
        of_base = rows if base is None else rows.where(F.col("part") == F.lit(base))
        if base is not None and not of_base.take(1):
            raise ValueError(f"no row has {base!r} in {part}")
        if not columns:
            return rows.select("part", F.lit("").alias("feature"), F.lit("").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("rate")).where(F.lit(False))
        counts = distinct_counts(rows, list(at))
        cut = [c for c in at if counts[c] > few and is_numeric(rows, c)]
        edges = {c: sorted(set(e)) for c, e in quantiles(of_base, cut, [i / bins for i in range(1, bins)]).items()} if cut else {}
        listed = [c for c in at if counts[c] <= few]
        met = rows.agg(*[F.max(F.col(c).isNull()).alias(f"null_{c}") for c in at], *[F.collect_set(F.col(c).cast("string")).alias(c) for c in listed]).first()
    places = {c: [str(i) for i in range(1, len(edges[c]) + 2)] for c in cut} | {c: sorted(met[c]) for c in listed}
    bin_of = {c: F.when(F.col(c).isNotNull(), bin_column(c, edges[c])).cast("string") if c in cut else F.col(c).cast("string") for c in at}
    cells = rows.select("part", "y", F.inline(F.array(*[F.struct(F.lit(at[c]).alias("feature"), b.alias("bin")) for c, b in bin_of.items()])))
    grid = [F.struct(F.lit(at[c]).alias("feature"), F.array_append(F.array(*map(F.lit, p)).cast("array<string>"), F.lit(None).cast("string")).alias("bins") if met[f"null_{c}"] else F.array(*map(F.lit, p)).cast("array<string>").alias("bins")) for c, p in places.items()]
    out = cells.select("part", "feature", "bin", "y", F.lit(1).alias("row"))
    if grid:
        empty = rows.select("part").distinct().select("part", F.inline(F.array(*grid))).select("part", "feature", F.explode("bins").alias("bin"))
        out = out.unionAll(empty.select("part", "feature", "bin", F.lit(None).cast("double"), F.lit(0)))
    return _rates(out, "part", "feature").select("part", "feature", "bin", "n", "rate").withColumnRenamed("part", part)


def pass_curve(df: DataFrame, score: str, label: str, id_col: str) -> DataFrame:
    """``pass_rate`` 0 to 100, ``n`` and ``bad_rate`` of the ``int(pass_rate / 100 * rows)`` rows of
    lowest score; ties by id. Scores are counted and summed over ranges; only the scores at which
    a rate ends are opened."""
    s = by_score(df, score, label)
    c = cumulate(s, "score", {"cum_n": "n", "cum_pos": "pos"})
    total = s.agg(F.sum("n").alias("all_n"))
    want = df.sparkSession.range(0, 101).select(F.col("id").cast("int").alias("pass_rate")).join(F.broadcast(total)).select("pass_rate", F.expr("(pass_rate * all_n) div 100").alias("k"))
    before = c.select("score", (F.col("cum_n") - F.col("n")).alias("lo"), F.col("cum_n").alias("hi"), (F.col("cum_pos") - F.col("pos")).alias("pos_lo"))
    hit = before.join(F.broadcast(want), (F.col("k") > F.col("lo")) & (F.col("k") <= F.col("hi")))  # 101 rows
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("y"), F.col(id_col).alias("id"))
    ends = hit.select("score").distinct()
    inside = rows.join(F.broadcast(ends), "score").withColumn("r", F.row_number().over(W.partitionBy("score").orderBy("id")))
    got = hit.join(inside, "score").where(F.col("r") <= F.col("k") - F.col("lo")).groupBy("pass_rate").agg(F.first("k").alias("n"), (F.first("pos_lo") + F.sum("y")).alias("bad"))
    return want.join(got.select("pass_rate", "bad"), "pass_rate", "left").select("pass_rate", F.col("k").alias("n"), F.when(F.col("k") > 0, F.coalesce("bad", F.lit(0)) / F.col("k")).otherwise(0.0).alias("bad_rate"))


def profit_curve(df: DataFrame, score: str, label: str, id_col: str, gain: float, loss: float, rule_pass: float = 1.0, cost_model: float = 0.0, cost_sell: float = 0.0, cost_rule: float = 0.0) -> DataFrame:
    """Profit at each pass rate: ``rule_pass (gain (1 - r) p - loss p r - cost_model) - cost_sell - cost_rule``."""
    p, r = F.col("pass_rate") / 100, F.col("bad_rate")
    return pass_curve(df, score, label, id_col).withColumn("profit", rule_pass * (gain * (1 - r) * p - loss * p * r - cost_model) - cost_sell - cost_rule)


def best_pass_rate(curve: DataFrame, spec_p: int | None = None) -> DataFrame:
    """``pass_rate, profit, bad_rate`` of a profit curve where profit is largest (of equal ones at the
    smallest pass rate), with ``spec_profit`` at a given pass rate."""
    top = F.max_by(F.struct("pass_rate", "profit", "bad_rate"), F.struct(F.round("profit", 9), -F.col("pass_rate")))
    out = curve.agg(top.alias("b"), F.max(F.when(F.col("pass_rate") == F.lit(spec_p), F.col("profit"))).alias("spec_profit"))
    return out.select("b.pass_rate", "b.profit", "b.bad_rate", "spec_profit")


def rule_metrics(df: DataFrame, rules: list[str], label: str) -> DataFrame:
    """``rule, class, count, hits, precision, recall, f1, lift`` of SQL predicates for both classes;
    one aggregation for all distinct rules."""
    rules = list(dict.fromkeys(rules))
    y = F.col(label).cast("long")
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p1"), *[e for i, r in enumerate(rules) for e in (F.sum(F.when(F.expr(r), 1).otherwise(0)).alias(f"c_{i}"), F.sum(F.when(F.expr(r), y).otherwise(0)).alias(f"h_{i}"))])
    cells = []
    for i, r in enumerate(rules):
        for k in (1, 0):
            hits = F.col(f"h_{i}") if k else F.col(f"c_{i}") - F.col(f"h_{i}")
            size = F.col("p1") if k else F.col("n") - F.col("p1")
            cells.append(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("class"), F.col(f"c_{i}").alias("count"), hits.alias("hits"), F.try_divide(hits, F.col(f"c_{i}")).alias("precision"), F.try_divide(hits, size).alias("recall"), (size / F.col("n")).alias("base")))
    x = a.select(F.inline(F.array(*cells)))
    return x.select("rule", "class", "count", "hits", "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.try_divide(F.col("precision"), F.col("base")).alias("lift"))


def fold_summary(df: DataFrame, metric: str) -> DataFrame:
    """Mean, standard deviation, least and greatest of a metric over folds."""
    return df.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def feature_evaluation(df: DataFrame, columns: list[str], label: str | list[str], hue: str | None = None, bins: int | None = None) -> DataFrame:
    """``(hue,) feature, auc, ks`` of numeric columns, for each value of ``hue`` if given. Several
    labels give a column ``label``; with ``bins`` there is ``iv`` as well, over quantile bins that are
    fitted on all rows. One plan for all columns, labels and values of ``hue``; values of ``hue`` never
    come to the driver."""
    from .binning import ContBinningEncoder

    labels, keys = [label] if isinstance(label, str) else list(label), [hue] if hue else []
    out = feature_curves(df, columns, labels, *keys)
    if bins:
        binner, iv = ContBinningEncoder(bins, "qcut", columns=list(columns)).fit(df), None
        for y in labels:
            one = binned_woe_report(df, binner, y, *keys).groupBy(*keys, "feature").agg(F.first("IV").alias("iv")).withColumn("label", F.lit(y))
            iv = one if iv is None else iv.unionByName(one)
        at = [*keys, "feature", "label"]
        of = dict(zip(at, unused(out, *[f"{k}_of" for k in at])))
        match = F.lit(True)
        for k, o in of.items():
            match = match & F.col(k).eqNullSafe(F.col(o))
        out = out.join(iv.withColumnsRenamed(of), match, "left").drop(*of.values())
    return out.drop("label") if isinstance(label, str) else out
