"""Building blocks shared by the operators: long form, schema inference, distributed running sums."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Lookup tables of up to so many rows are broadcast; larger ones are joined by key.
BROADCAST_ROWS = 200_000
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class FeatureSpec:
    """Names of categorical, continuous and other feature columns."""

    cate: list[str] = field(default_factory=list)
    cont: list[str] = field(default_factory=list)
    custom: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.cate, *self.cont, *self.custom]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC)


def null_nans(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns, so that both count as missing."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_long(df: DataFrame, columns: Iterable[str], *keep: str, as_type: str = "string") -> DataFrame:
    """``keep..., feature, value``: one row for each row and column, without a shuffle."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(as_type).alias("value")) for c in columns]
    if not cells:
        return df.select(*keep, F.lit("").alias("feature"), F.lit(None).cast(as_type).alias("value")).where(F.lit(False))
    return df.select(*keep, F.inline(F.array(*cells)))


def coerce_numeric(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """String columns whose every non-null value parses as a number become double; one job."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not strings:
        return df
    seen = df.agg(*[x for c in strings for x in (F.count(c).alias(f"n_{c}"), F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(f"p_{c}"))]).first()
    good = [c for c in strings if seen[f"n_{c}"] and seen[f"n_{c}"] == seen[f"p_{c}"]]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in good}) if good else df


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null values of each column, by one shuffle of (column, value)."""
    rows = to_long(df, columns).where("value is not null").groupBy("feature").agg(F.countDistinct("value").alias("n")).collect() if columns else []
    return {c: 0 for c in columns} | {r["feature"]: r["n"] for r in rows}


def infer_kinds(df: DataFrame, threshold: int = 20, columns: list[str] | None = None) -> FeatureSpec:
    """Categorical: not numeric, or fewer than ``threshold`` distinct values; the rest continuous."""
    columns = columns or df.columns
    numeric = [c for c in columns if is_numeric(df, c)]
    n = distinct_counts(df, numeric)
    cate = [c for c in columns if c not in numeric or n[c] < threshold]
    return FeatureSpec(cate, [c for c in columns if c not in cate])


def auto_spec(df: DataFrame, threshold: int, custom: Iterable[str] = ()) -> FeatureSpec:
    """Columns with fewer than ``threshold`` values are categorical, other numeric ones continuous;
    custom columns are neither, and other strings are left out."""
    custom = list(custom)
    columns = [c for c in df.columns if c not in custom]
    n = distinct_counts(df, columns)
    cate = [c for c in columns if n[c] < threshold]
    return FeatureSpec(cate, [c for c in columns if c not in cate and is_numeric(df, c)], custom)


def declare(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Cast to the declared kinds: categorical to string with null as ``'nan'``, continuous to double."""
    cast = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in spec.cate} | {c: F.col(c).cast("double") for c in spec.cont}
    return df.withColumns(cast) if cast else df


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Columns frozen at fit must be there at transform."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")


def lookup(df: DataFrame, table: DataFrame, rows: int, key: str, table_key: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """Left join of one value by null-safe key; broadcast only where ``rows`` says it is small."""
    side = table.select(F.col(table_key).alias("__key"), F.col(value).alias("__value"))
    side = F.broadcast(side) if rows <= BROADCAST_ROWS else side
    joined = df.join(side, df[key].cast("string").eqNullSafe(F.col("__key")), "left")
    got = F.col("__value") if default is None else F.coalesce(F.col("__value"), default)
    return joined.withColumn(out, got).drop(*[c for c in ("__key", "__value") if c != out])


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """The table, kept by the executors for the jobs of a block, so that its joins (and what they broadcast
    by way of the driver) are made once and not for each job. One that is kept already stays kept."""
    kept = df.storageLevel != StorageLevel.NONE
    if not kept:
        df.persist()
    try:
        yield df
    finally:
        if not kept:
            df.unpersist()


#: Values of a span that one task sorts to find exact ranks in it; larger spans are narrowed first.
SORTED_VALUES = 250_000
#: Parts into which each round of narrowing cuts a span.
PARTS = 64


def _within(x: Column, after, upto, strict: bool) -> Column:
    """Whether a value is in a span: above ``after`` and up to ``upto``, or below it; None is no bound."""
    out = x.isNotNull()
    out = out if after is None else out & (x > F.lit(after))
    return out if upto is None else out & ((x < F.lit(upto)) if strict else (x <= F.lit(upto)))


def _part(x: Column, cuts: list, value, first: int = 0) -> Column:
    """``value(i)`` of the part that a value lies in: up to the i-th cut, the last part beyond all. Halves
    are told apart first, so that a row meets as many cuts as there are halvings."""
    if not cuts:
        return value(first)
    m = len(cuts) // 2
    return F.when(x <= F.lit(cuts[m]), _part(x, cuts[:m], value, first)).otherwise(_part(x, cuts[m + 1 :], value, first + m + 1))


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int] | None = None) -> dict[str, dict[int, object]]:
    """Column to rank to value: the exact values at 0-based ranks among the sorted non-null values
    of numeric columns; ranks outside are left out.

    Values are not shuffled by value. Spans that hold wanted ranks are cut at approximate quantiles
    and counted, all columns in one job, until each holds at most `SORTED_VALUES`, which one task
    sorts. A span keeps about a PARTS-th each round and a value that stands often is settled by its
    count, so a few rounds do for any table. Approximate quantiles are doubles: a span that they do
    not cut, of whole numbers too large for that, is cut by distance from its least. The driver
    gets a row for each part.
    """
    found: dict[str, dict[int, object]] = {c: {} for c in ranks}
    columns = [c for c in ranks if ranks[c]]
    if not columns:
        return found
    counts = counts or df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    spans = [(c, (None, None, False), 0, counts[c], sorted({r for r in ranks[c] if 0 <= r < counts[c]}), 0) for c in columns]
    spans = [s for s in spans if s[4]]
    while wide := [s for s in spans if s[3] > SORTED_VALUES]:
        spans = [s for s in spans if s[3] <= SORTED_VALUES]
        values = [F.when(_within(F.col(c), *bounds), F.col(c)) for c, bounds, *_ in wide]
        cuts = df.agg(*[F.percentile_approx(x - F.lit(s[5]) if s[5] else x, [k / PARTS for k in range(1, PARTS + 1)], 100 * PARTS).alias(f"{i}") for i, (x, s) in enumerate(zip(values, wide))]).first()
        cuts = [sorted({c + s[5] for c in cuts[f"{i}"]}) for i, s in enumerate(wide)]
        cells = [F.when(x.isNotNull(), F.struct(F.lit(i).alias("span"), _part(x, cuts[i], F.lit).alias("part"), x.isin(cuts[i]).cast("long").alias("ends"))) for i, x in enumerate(values)]
        rows = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("span", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("ends").alias("ends")).collect()
        size = {(r["span"], r["part"]): (r["n"], r["ends"]) for r in rows}
        for i, (c, (after, upto, strict), before, all_n, want, base) in enumerate(wide):
            for k, end in enumerate([*cuts[i], None]):
                n, ends = size.get((i, k), (0, 0))
                for r in want:
                    if before + n - ends <= r < before + n:
                        found[c][r] = end  # the part's greatest value, as often as it stands there
                inside = [r for r in want if before <= r < before + n - ends]
                if inside:
                    bounds = (after, upto, strict) if end is None else (after, end, True)
                    stuck = n - ends == all_n
                    if stuck and base:
                        raise ArithmeticError(f"no quantile divides the values of {c}")
                    least = df.agg(F.min(F.when(_within(F.col(c), *bounds), F.col(c)))).first()[0] if stuck else 0
                    spans.append((c, bounds, before, n - ends, inside, least))
                before, after = before + n, end
    if spans:
        lists = [F.sort_array(F.collect_list(F.when(_within(F.col(c), *bounds), F.col(c)))).alias(f"{i}") for i, (c, bounds, *_) in enumerate(spans)]
        picked = df.agg(*lists).select(*[F.array(*[F.col(f"{i}")[r - s[2]] for r in s[4]]).alias(f"{i}") for i, s in enumerate(spans)]).first()
        for i, s in enumerate(spans):
            found[s[0]] |= dict(zip(s[4], picked[f"{i}"], strict=True))
    return found


def _between(values: dict[int, float], place: float) -> float:
    """The value at a place between two ranks; never outside of theirs, so that equal neighbours give
    themselves and quantiles do not fall as their places rise."""
    lo, hi = values[math.floor(place)], values[math.ceil(place)]
    return lo if lo == hi else min(max(lo + (hi - lo) * (place - math.floor(place)), lo), hi)


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]], counts: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Column to its quantiles, interpolated between neighbours; empty for a column without values.
    The columns are kept for the rounds, unless ``df`` is."""
    if not probs:
        return {}
    x = df.select(*[F.col(c).cast("double").alias(c) for c in probs])
    with held(x) if df.storageLevel == StorageLevel.NONE else nullcontext():
        counts = counts or x.agg(*[F.count(c).alias(c) for c in probs]).first().asDict()
        place = {c: [p * (counts[c] - 1) for p in ps] if counts[c] else [] for c, ps in probs.items()}
        got = order_statistics(x, {c: [k for p in ps for k in (math.floor(p), math.ceil(p))] for c, ps in place.items()}, counts)
    return {c: [_between(got[c], p) for p in ps] for c, ps in place.items()}


def above(df: DataFrame, value_col: str, id_cols: list[str], quota: Callable[[int], int]) -> Column:
    """Condition that holds for ``quota(rows)`` rows of greatest value (numeric, null the least), ties
    by smallest id: value and id are compared with those of the last row taken, nothing is joined.

    Rows that share value and id are taken together, the last ones too. Values and ids are kept for
    the jobs that look for the last row.
    """
    with held(df.select(*dict.fromkeys([value_col, *id_cols]))) as rows:
        return _above(rows, value_col, id_cols, quota)


def _above(df: DataFrame, value_col: str, id_cols: list[str], quota: Callable[[int], int]) -> Column:
    x = F.col(value_col)
    n, filled = df.agg(F.count(F.lit(1)), F.count(value_col)).first()
    quota = quota(n)
    if quota <= 0 or quota >= n:
        return F.lit(quota > 0)
    if quota > filled:  # all with a value, and some without
        more, tied, left = x.isNotNull(), x.isNull(), quota - filled
    else:
        at = order_statistics(df, {value_col: [filled - quota]}, {value_col: filled})[value_col][filled - quota]
        more, tied = x > F.lit(at), x == F.lit(at)
        over, equal = df.agg(F.sum(more.cast("long")), F.sum(tied.cast("long"))).first()
        left = quota - (over or 0)
        if left >= equal:
            return F.coalesce(more | tied, F.lit(False))
    ties = df.where(tied)
    if len(id_cols) == 1 and is_numeric(df, id_cols[0]):
        k = id_cols[0]
        nulls = ties.where(F.col(k).isNull()).count()
        last = order_statistics(ties, {k: [left - nulls - 1]})[k].get(left - nulls - 1)
        first = F.col(k).isNull() if last is None else F.col(k).isNull() | (F.col(k) <= F.lit(last))
    else:  # ids of other types: as many structs as are taken, in order
        last = ties.select(F.struct(*id_cols).alias("id")).orderBy("id").limit(left).agg(F.max("id").alias("id"))
        first = F.struct(*id_cols) <= _literal(last, df, id_cols)
    return F.coalesce(more | (tied & first), F.lit(False))


def _literal(one: DataFrame, df: DataFrame, id_cols: list[str]) -> Column:
    """The struct ``id`` of a single row as a literal of the same types."""
    row = one.first()["id"]
    return F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in id_cols])


def cumulate(df: DataFrame, by: str, values: dict[str, str], descending: bool = False, parts: int = 64) -> DataFrame:
    """Running sums over the whole table in order of one numeric column with distinct values.

    ``values`` maps new columns to summed ones. The order is cut into ranges at approximate
    quantiles; each range is summed by its own task and shifted by the sums of the ranges before
    it (a row for each range), so no task sees the whole table.
    """
    x = F.col(by).cast("double")
    cuts = df.agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    cuts = sorted({c for c in cuts or [] if c is not None})
    part = F.lit(0)
    for c in cuts:
        part = part + (x > c).cast("int")
    if descending:
        part = len(cuts) - part
    dealt = df.withColumn("__part", part)
    totals = dealt.groupBy("__part").agg(*[F.sum(v).alias(k) for k, v in values.items()])
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("__part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"__{k}") for k in values])
    order = F.col(by).desc() if descending else F.col(by).asc()
    within = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.join(F.broadcast(totals), "__part")  # at most ``parts`` rows
    return out.withColumns({k: F.sum(v).over(within) + F.col(f"__{k}") for k, v in values.items()}).drop("__part", *[f"__{k}" for k in values])


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cumulate_within(df: DataFrame, keys: list[str], by: str, values: dict[str, str], parts: int = 32) -> DataFrame:
    """Running sums within each key, null a key too, in ascending order of a numeric column whose
    values are distinct within a key.

    As `cumulate`, for all keys in one plan and without a job of its own: each key's values are cut
    at quantiles of a sample of that key's, (key, range) is summed by a task, and the sums of the
    ranges before, at most ``parts`` rows a key, are added. A key that holds most rows is spread like
    any other. Keys, not rows, are what a window sees at once.

    Rows and sums meet by range, and Spark may work the cuts out once for each, or again for a lost
    executor. So the sample hangs on the values alone, the one of least hash in each of ``40 * parts``
    slots of hashes, not on the order in which tasks end, as approximate quantiles do.
    """
    own = unused(df.withColumns({k: F.lit(0) for k in values}), "range", "range_of", "cuts", *[f"{k}_of" for k in keys], *[f"{k}_before" for k in values])
    part, part_of, cuts, names, befores = *own[:3], own[3 : 3 + len(keys)], own[3 + len(keys) :]
    x = F.col(by).cast("double")
    drawn = df.where(x.isNotNull()).groupBy(*keys, F.pmod(F.xxhash64(x), F.lit(40 * parts)).alias(part)).agg(F.min(F.struct(F.xxhash64(x).alias("hash"), x.alias("value"))).alias(cuts))
    drawn = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(cuts)["value"])).alias(cuts))
    ends = F.transform(F.sequence(F.lit(1), F.lit(max(parts, 2) - 1)), lambda i: F.get(cuts, F.floor(i * F.size(cuts) / max(parts, 2)).cast("int")))
    edges = drawn.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.array_distinct(ends).alias(cuts))
    match = F.lit(True)
    for k, n in zip(keys, names):
        match = match & F.col(k).eqNullSafe(F.col(n))
    dealt = df.join(edges, match, "left").withColumn(part, F.coalesce(F.size(F.filter(cuts, lambda c: c < x)), F.lit(0))).drop(cuts, *names)
    totals = dealt.groupBy(*keys, part).agg(*[F.sum(v).alias(b) for b, v in zip(befores, values.values())])
    ahead = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(part).alias(part_of), *[F.coalesce(F.sum(b).over(ahead), F.lit(0)).alias(b) for b in befores])
    within = W.partitionBy(*keys, part).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = dealt.withColumns({k: F.sum(v).over(within) for k, v in values.items()}).join(totals, match & (F.col(part) == F.col(part_of)))
    return out.withColumns({k: F.col(k) + F.col(b) for k, b in zip(values, befores)}).drop(part, part_of, *befores, *names)


def best_first(root, gain: Callable, children: Callable, splits: int, depth: int) -> list:
    """Nodes that a best-first tree splits, in order: the open one of largest ``gain`` (None splits
    nothing), of equal ones the one met first; at most ``splits``, none below ``depth`` levels."""
    heap, out, met = [], [], 0

    def meet(node, level: int) -> None:
        nonlocal met
        g = gain(node)
        if g is not None:
            heapq.heappush(heap, (-g, met, node, level))
            met += 1

    meet(root, 0)
    while heap and len(out) < splits:
        _, _, node, level = heapq.heappop(heap)
        out.append(node)
        if level + 1 < depth:
            for child in children(node):
                meet(child, level + 1)
    return out


def stack_datasets(**parts: DataFrame) -> DataFrame:
    """Rows of several data sets with their name in ``dataset``."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def round6(df: DataFrame) -> DataFrame:
    """Doubles at 6 decimals, without a negative zero."""
    return df.withColumns({f.name: F.round(f.name, 6) + 0.0 for f in df.schema if isinstance(f.dataType, T.DoubleType)}) if any(isinstance(f.dataType, T.DoubleType) for f in df.schema) else df
