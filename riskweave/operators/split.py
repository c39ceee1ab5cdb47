"""Splitting into train and test, labels, folds and stratified sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .core import above, cumulate_within, unused


def derive_label(df: DataFrame, label_col: str, label: str) -> DataFrame:
    """Add ``label`` (such as ``'14d'``): the value above that number, where ``label_col`` has more
    than two values; else a copy. The source column goes unless it has that name."""
    many = df.select(label_col).where(F.col(label_col).isNotNull()).distinct().limit(3).count() > 2
    value = F.when(F.col(label_col) > int(label[:-1]), 1).otherwise(0) if many else F.col(label_col)
    out = df.withColumn(label, value.cast("int"))
    return out if label == label_col else out.drop(label_col)


def _moment(df: DataFrame, time_col: str):
    """A time as microseconds, other values as double."""
    timed = dict(df.dtypes)[time_col] in ("timestamp", "timestamp_ntz", "date", "string")
    return F.unix_micros(F.col(time_col).cast("timestamp")) if timed else F.col(time_col).cast("double")


def latest(df: DataFrame, test_size: float, time_col: str, id_cols: list[str]) -> DataFrame:
    """Add ``is_test``: the ``floor(n * test_size)`` latest rows, null times the earliest, ties by id.

    The time and the id of the last row taken are found first; the split is then a comparison
    with them, without a join or a sort of the table.
    """
    (t,) = unused(df, "t")
    x = df.withColumn(t, _moment(df, time_col))
    return x.withColumn("is_test", above(x, t, id_cols, lambda n: math.floor(n * test_size))).drop(t)


def _greatest_in_group(df: DataFrame, group_col: str | Column, order: Column, quota, id_cols: list[str], name: str) -> DataFrame:
    """Add ``name``: in each group the first ``quota(group, rows)`` rows (null takes none) by a numeric
    ``order`` descending, nulls last, ties by id.

    Rows are counted by group and value, and running counts over ranges within groups
    (`core.cumulate_within`) give each group's last value taken; among the rows tied there a whole-number
    id is found the same way, ids of other types are ranked. What joins the table is one row for
    each group; no window sees a group.
    """
    g, o, i, n, c, cum, filled, want, eg, eo, left, last, lg = unused(df, "group", "order", "id_struct", "rows", "count", "upto", "filled", "quota", "edge_group", "edge", "left", "last", "last_group")
    x = df.withColumns({g: F.col(group_col) if isinstance(group_col, str) else group_col, o: order})
    totals = x.groupBy(F.col(g).alias(eg)).agg(F.count(F.lit(1)).alias(n), F.count(o).alias(filled))
    totals = totals.withColumn(want, F.least(quota(F.col(eg), F.col(n)), F.col(n))).where(F.col(want) > 0)
    counted = x.where(F.col(o).isNotNull()).groupBy(g, o).agg(F.count(F.lit(1)).alias(c))
    upto = cumulate_within(counted, [g], o, {cum: c}).join(totals, F.col(g).eqNullSafe(F.col(eg)))
    ahead = F.col(filled) - F.col(cum)  # rows of greater value
    some = upto.where((F.col(want) <= F.col(filled)) & (ahead < F.col(want)) & (ahead + F.col(c) >= F.col(want)))
    edge = some.select(eg, F.col(o).alias(eo), (F.col(want) - ahead).alias(left)).unionAll(totals.where(F.col(want) > F.col(filled)).select(eg, F.lit(None).cast(x.schema[o].dataType), F.col(want) - F.col(filled)))
    tied = x.join(edge, F.col(g).eqNullSafe(F.col(eg)) & F.col(o).eqNullSafe(F.col(eo)))
    if len(id_cols) == 1 and isinstance(df.schema[id_cols[0]].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        k = id_cols[0]
        ids = tied.groupBy(g, F.coalesce(k, F.lit(-(1 << 63))).alias(i)).agg(F.count(F.lit(1)).alias(c), F.first(left).alias(left))
        at = cumulate_within(ids, [g], i, {cum: c})
        ends_at = at.where((F.col(cum) - F.col(c) < F.col(left)) & ((F.col(cum) >= F.col(left)))).select(F.col(g).alias(lg), F.col(i).alias(last))
        first = F.coalesce(k, F.lit(-(1 << 63))) <= F.col(last)
    else:
        ranked = tied.select(g, left, F.struct(*id_cols).alias(i)).withColumn(c, F.row_number().over(W.partitionBy(g).orderBy(i))).where(F.col(c) <= F.col(left))
        ends_at = ranked.groupBy(F.col(g).alias(lg)).agg(F.max(i).alias(last))
        first = F.struct(*id_cols) <= F.col(last)
    ends = edge.join(ends_at, F.col(eg).eqNullSafe(F.col(lg))).select(eg, eo, last)
    over = F.when(F.col(eo).isNull(), F.col(o).isNotNull()).otherwise(F.col(o) > F.col(eo))
    taken = F.col(last).isNotNull() & (F.coalesce(over, F.lit(False)) | (F.col(o).eqNullSafe(F.col(eo)) & first))
    return x.join(ends, F.col(g).eqNullSafe(F.col(eg)), "left").withColumn(name, F.coalesce(taken, F.lit(False))).drop(g, o, eg, eo, last)


def latest_in_group(df: DataFrame, test_size: float, time_col: str, group_col: str, id_cols: list[str]) -> DataFrame:
    """Add ``is_test``: in each group the ``floor(n * test_size)`` latest rows. Of rows that share group,
    time and id all or none are taken."""
    return _greatest_in_group(df, group_col, _moment(df, time_col), lambda g, n: F.floor(n * test_size), id_cols, "is_test")


def at_random(df: DataFrame, test_size: float, id_cols: list[str], seed: int = 7) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(n * test_size)`` rows by a seeded hash of the id, equal hashes by id;
    rows of one id are taken together. The last hash taken is found first, nothing is joined."""
    (h,) = unused(df, "hash")
    x = df.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *id_cols), 12))  # whole as a double
    return x.withColumn("is_test", above(x, h, id_cols, lambda n: math.ceil(n * test_size))).drop(h)


def split(df: DataFrame, method: str, test_size: float, time_col: str | None = None, group_col: str | None = None, id_cols: list[str] = (), drop_cols: list[str] = (), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, test) by ``'oot'`` (latest rows), within groups if given, or ``'random'``; helper columns go."""
    id_cols = list(id_cols)
    if method == "oot":
        marked = latest_in_group(df, test_size, time_col, group_col, id_cols) if group_col else latest(df, test_size, time_col, id_cols)
    elif method == "random":
        marked = at_random(df, test_size, id_cols, seed)
    else:
        raise ValueError(f"unknown split method {method!r}")
    gone = [c for c in (*drop_cols, time_col, group_col, "is_test") if c]
    return marked.where(~F.col("is_test")).drop(*gone), marked.where("is_test").drop(*gone)


def one_class(df: DataFrame, label: str) -> bool:
    """Whether a label has fewer than two values."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2


#: Ranges of the hash in which rows of a class are ranked, each by its own task (a power of 2).
HASH_RANGES = 1 << 12


def fold(df: DataFrame, label: str, n: int, id_cols: list[str], name: str = "fold", seed: int = 7) -> DataFrame:
    """Add the stratified fold number of each row, by rank of a seeded hash of the id in its class.

    Rows are ranked within ranges of the hash and shifted by the rows of the ranges before, a small
    table, so that no task sorts a class.
    """
    h = df.withColumn("__fold_h", F.xxhash64(F.lit(seed), *id_cols)).withColumn("__fold_p", F.shiftright("__fold_h", 64 - int(math.log2(HASH_RANGES))))
    before = h.groupBy(F.col(label).alias("__fold_y"), F.col("__fold_p").alias("__fold_q")).agg(F.count(F.lit(1)).alias("__fold_c"))
    ahead = W.partitionBy("__fold_y").orderBy("__fold_q").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("__fold_y", "__fold_q", F.coalesce(F.sum("__fold_c").over(ahead), F.lit(0)).alias("__fold_b"))
    rank = F.row_number().over(W.partitionBy(label, "__fold_p").orderBy("__fold_h", *id_cols))
    ranked = h.withColumn("__fold_r", rank)
    out = ranked.join(before, F.col(label).eqNullSafe(F.col("__fold_y")) & (F.col("__fold_p") == F.col("__fold_q")))
    return out.withColumn(name, ((F.col("__fold_r") + F.col("__fold_b") - 1) % n).cast("int")).drop("__fold_h", "__fold_p", "__fold_y", "__fold_q", "__fold_b", "__fold_r")


def quotas(available: dict[str, int], ratio: dict[str, float], threshold: float) -> dict[str, int]:
    """Rows to take from each level so that they stand in ``ratio``.

    The level with the largest share is the anchor; a level too scarce for it becomes the anchor,
    provided the sample it implies is not below ``threshold`` (a share of all rows up to 1, a
    number above). Levels are compared as strings; levels in only one of the two are left out.
    """
    have = {str(k): v for k, v in available.items()}
    want = {str(k): v for k, v in ratio.items() if str(k) in have and v > 0}
    if not want:
        return {}
    total, share = sum(have[k] for k in want), sum(want.values())
    if threshold > total:
        raise ValueError("the threshold is above the number of rows")
    least = threshold * total if threshold <= 1 else threshold
    anchor = max(sorted(want), key=want.get)
    for level in sorted(want):
        implied = have[level] / (want[level] / share)
        if have[level] / want[level] < have[anchor] / want[anchor] and implied >= least:
            anchor = level
    return {k: min(have[k], int(have[anchor] * r / want[anchor])) for k, r in want.items()}


def take_newest(df: DataFrame, level_col: str, quota: dict[str, int], sort_col: str, id_cols: list[str]) -> DataFrame:
    """Of each level the quota's rows that are highest in ``sort_col`` (a number, time or date, or text that
    reads as a time), ties by id. Of rows that share level, value and id all or none are taken."""
    if not quota:
        return df.where(F.lit(False))
    of = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    listed = df.where(F.col(level_col).cast("string").isin(list(quota)))
    (taken,) = unused(df, "taken")
    return _greatest_in_group(listed, level_col, _moment(df, sort_col), lambda g, n: F.element_at(of, g.cast("string")), id_cols, taken).where(taken).drop(taken)


def sample(df: DataFrame, level_col: str, sort_col: str, id_cols: list[str], ratio: dict | None = None, base: DataFrame | None = None, threshold: float = 0.1, bins: int = 10, few: int = 20) -> DataFrame:
    """Stratified sample in a given ratio, or in that of another data set's levels. Levels of a
    numeric column with over ``few`` values are the base's quantile bins."""
    from .binning import bin_column, quantiles
    from .core import distinct_counts, is_numeric

    level = F.col(level_col).cast("string")
    if ratio is None and is_numeric(base, level_col) and distinct_counts(base, [level_col])[level_col] > few:
        edges = sorted(set(quantiles(base, [level_col], [i / bins for i in range(1, bins)])[level_col]))
        level = bin_column(F.col(level_col).cast("double"), edges, missing=None).cast("string")
    count = lambda d: {r[0]: r[1] for r in d.select(level.alias("l")).where("l is not null").groupBy("l").count().collect()}
    quota = quotas(count(df), ratio or count(base), threshold)
    (own,) = unused(df, "level")
    return take_newest(df.withColumn(own, level), own, quota, sort_col, id_cols).drop(own)


def cut_off(df: DataFrame, weight_col: str, ratio: float, id_cols: list[str], keep_weight: bool = True) -> DataFrame:
    """The heaviest rows (a share up to 1, else a number), weights brought to mean 1 or dropped."""
    top = df.where(above(df, weight_col, id_cols, lambda n: int(n * ratio) if ratio <= 1 else int(ratio)))
    if not keep_weight:
        return top.drop(weight_col)
    mean = top.agg(F.avg(weight_col)).first()[0]
    return top.withColumn(weight_col, F.col(weight_col) / mean)
