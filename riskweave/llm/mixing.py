"""Mixing sources to target weights by subset sums.

Documents are counted by exact length within each source. Each source's target is met by whole
passes over the source and, for the rest, by a number of documents of each length: a draw in
proportion to the counts, then a bounded-knapsack dynamic programme over the lengths still free
for what rounding leaves. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, n_words_col

#: Budget that the dynamic programme may span; larger rests are first filled by whole documents.
DP_BUDGET = 1 << 16
#: Parts (a power of 2) into which the documents of a source and length are dealt by their hash.
HASH_PARTS = 1024


def knapsack(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """size -> number taken, at most its count, whose total is the largest not above ``budget``.

    Bit ``b`` of a Python integer says whether ``b`` can be reached; counts are split into powers
    of two. It stops as soon as the budget itself is reached.
    """
    mask, reach, steps = (1 << (budget + 1)) - 1, 1, []
    for size, count in zip(sizes, counts, strict=True):
        count, k = min(count, budget // size), 1
        while count > 0:
            take = min(k, count)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            count, k = count - take, k * 2
        if reach >> budget & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            at -= size * take
            out[size] = out.get(size, 0) + take
    return out


def fit_counts(sizes, counts, target: float, max_passes: int, seed: int) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and for each length how many documents more."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    more = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, more
    passes = min(int(target / total + 1e-9), max_passes)
    budget = int(round(target - passes * total))
    if passes >= max_passes or budget <= 0:
        return passes, more
    more = np.floor(counts * (budget / total)).astype(np.int64)
    more[sizes == 0] = 0
    more = np.minimum(more, counts)
    rest = budget - int((sizes * more).sum())
    order = [int(i) for i in np.argsort(sizes, kind="stable") if sizes[i] > 0]
    random.Random(seed).shuffle(order)
    added = True
    while rest > DP_BUDGET and added:
        added = False
        for i in order:
            if more[i] < counts[i] and sizes[i] <= rest - DP_BUDGET // 2:
                more[i] += 1
                rest -= int(sizes[i])
                added = True
    free = [i for i in order if more[i] < counts[i] and sizes[i] <= rest]
    at = {int(sizes[i]): i for i in free}
    if rest > DP_BUDGET and free:  # what is left to take is longer than half the rest, so one of them at most fits
        more[max(free, key=lambda i: sizes[i])] += 1
    elif rest > 0 and free:
        for size, n in knapsack([int(sizes[i]) for i in free], [int(counts[i] - more[i]) for i in free], rest).items():
            more[at[size]] += n
    return passes, more


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """``source, source_size, target`` from one row (``source, source_size``) for each source.

    Sources in code-point order, null last, weigh ``weights`` repeating. All share ``share``
    times all sizes by weight; a target stops at ``max_passes`` times its source's size and what
    is above is shared again by weight. The level at which sources stop is found with running
    sums over sources ordered by size for weight: one row for each source.
    """
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(n)).cast("int") + 1)
    by_level = W.orderBy("stop", "rank")
    x = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_passes)).withColumn("stop", F.col("cap") / F.col("w"))
    x = x.withColumn("before", F.sum("cap").over(by_level) - F.col("cap")).withColumn("left", F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("level", (F.sum("source_size").over(W.partitionBy()) * share - F.col("before")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(W.partitionBy())["level"]
    return x.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def mix_classes(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_passes: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    """``id, size, source, source_size, target, carry, rows, passes, extra``: for each class of rows that
    agree in id, source, size and ``carry`` (by default a hash of the text) their number, the passes
    that take all of them, and how many are taken once more.

    Rows of a class are alike, so they are counted, never ranked: a much repeated row is one row here.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    carried = F.xxhash64(F.col(text_col)) if carry is None else carry
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words_col(F.col(text_col)).alias("size"), carried.alias("carry"))
    rank_hash = F.xxhash64(F.lit(seed), F.col("id"), F.col("carry"))
    rows = sized.groupBy("id", "source", "size", "carry").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(rows.withColumn("key", key).withColumn("h", rank_hash).withColumn("part", F.shiftrightunsigned("h", 54).cast("int")), "mixing-sizes")
    parts = rows.groupBy("key", "source", "size", "part").agg(F.sum("n").alias("n"))
    lengths = parts.groupBy("key", "source", "size").agg(F.sum("n").alias("n"))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_passes).withColumn("key", key)

    def fit(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        passes, more = fit_counts(pdf["size"], pdf["n"], float(pdf["target"].iloc[0]), max_passes, seed)
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"], "source_size": pdf["source_size"], "target": pdf["target"], "passes": passes, "more": more})

    quota = (
        lengths.select("key", "size", "n").join(goal.select("key", "source_size", "target"), "key")
        .groupBy("key").applyInPandas(fit, "key string, size long, source_size long, target double, passes long, more long")
    )
    quota = materialise(quota, "mixing-quota")
    running = F.sum("n").over(W.partitionBy("key", "size").orderBy("part")) - F.col("n")
    by_part = parts.withColumn("before", running).join(quota, ["key", "size"]).withColumn("quota", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("before"))))
    upto = F.sum("n").over(W.partitionBy("key", "size", "part").orderBy("h", "id", "carry").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    out = rows.withColumn("ahead", upto).join(by_part.select("key", "size", "part", "source_size", "target", "passes", "quota"), ["key", "size", "part"])
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("ahead"))).cast("long")
    return out.select("id", "size", "source", "source_size", "target", "carry", F.col("n").alias("rows"), "passes", extra.alias("extra"))


def repeated(df: DataFrame, times: Column, number: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1; in two steps, so that no long array is built."""
    step = 1000
    block = F.explode(F.sequence(F.lit(0), ((times - 1) / step).cast("long")))
    blocks = df.where(times > 0).select("*", block.alias(number))
    own = F.sequence(F.col(number) * step + 1, F.least((F.col(number) + 1) * step, times))
    return blocks.select(*df.columns, F.explode(own).alias(number))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_passes: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``<id>, size, source, source_size, target, times, taken``: how often the mix takes each row.

    ``size`` counts words, null texts have 0; ``taken`` is ``times * size``. Null is a source of
    its own, last. The choice depends on the seed, ids, texts and sizes alone, so reruns agree;
    repeated rows are rows of their own. An empty table gives no row. Texts are only measured and
    hashed where they are read, however long; columns besides the three are not read, so their
    names do not matter. Only narrow rows move, written once to the shared folder; a hot source or
    length is dealt over HASH_PARTS, a null or hot id by the hash of its texts.
    """
    classes = mix_classes(docs, weights, share, max_passes, seed, id_col, text_col, source_col)
    each = repeated(classes, F.col("rows"), "at")
    times = (F.col("passes") + (F.col("at") <= F.col("extra")).cast("long")).alias("times")
    return each.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", times, (times * F.col("size")).alias("taken"))
