"""Nearest neighbours by largest inner product with multiprobe p-stable hashing.

Vectors get one more component so that all have the same length; the largest inner product is
then the smallest distance. Each table hashes by floor((a.x + b) / w) with Gaussian ``a``. A query
visits the cells of each table in the order of the estimated chance that a neighbour lies in them,
until the chances add up to what the tables together need for the wanted recall. How many tables
there are is decided by what they cost: the share of all vectors that a query meets, estimated on a
sample, so that where little can be left out one table is searched and no vector is met twice. A cell's vectors
and the queries that visit it meet in blocks of bounded size, are ranked by exact inner products,
and the tables' candidates are merged.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Vectors and queries of a cell that are compared in memory at once.
BLOCK = 4096


@dataclass
class Index:
    """Hash functions and the distribution of neighbours they were fitted to."""

    a: np.ndarray  # (tables, functions, dimensions + 1)
    b: np.ndarray  # (tables, functions)
    width: float  # in units of the common length
    length: float  # common length after the added component
    rho: float  # typical cosine between a query and its last wanted neighbour
    chance: float  # chance that each table has to cover
    share: float = 1.0  # share of all vectors that a query meets, over all tables, on a sample

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections (rows, tables, functions), in units of the common length."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            full = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
        else:
            full = np.hstack([x, np.sqrt(np.maximum(self.length**2 - norm**2, 0))[:, None]]) / self.length
        return np.einsum("nd,tkd->ntk", full, self.a)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.floor((self.project(x, False) + self.b) / self.width).astype(np.int64)

    def visits(self, projected: np.ndarray, table: int) -> list[tuple[int, ...]]:
        """Cells of one table for one query, likeliest first, until ``chance`` is covered."""
        ways, spread = [], math.sqrt(max(1e-9, 1 - self.rho**2))
        for p, b in zip(projected, self.b[table], strict=True):
            centre, at = self.rho * p + b, math.floor((self.rho * p + b) / self.width)
            reach = int(math.ceil(4 * spread / self.width)) + 1
            edge = [0.5 * math.erfc(-(c * self.width - centre) / (spread * math.sqrt(2))) for c in range(at - reach, at + reach + 2)]
            ways.append(sorted(((hi - lo, at - reach + i) for i, (lo, hi) in enumerate(zip(edge, edge[1:])) if hi - lo > 1e-9), reverse=True))
        start = (0,) * len(ways)
        heap, seen, out, covered = [(-math.prod(w[0][0] for w in ways), start)], {start}, [], 0.0
        while heap and covered < self.chance:
            minus, where = heapq.heappop(heap)
            covered -= minus
            out.append(tuple(w[i][1] for w, i in zip(ways, where, strict=True)))
            for j, i in enumerate(where):
                nxt = where[:j] + (i + 1,) + where[j + 1 :]
                if i + 1 < len(ways[j]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (-math.prod(w[n][0] for w, n in zip(ways, nxt, strict=True)), nxt))
        return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: vectors without null or non-finite components that are not zero, repeated rows once."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False))).dropDuplicates(["id", "v"])


def _share(index: Index, x: np.ndarray, queries: int = 24) -> float:
    """Share of the sample's vectors in the cells that its first vectors visit, over all tables."""
    cells, asked = index.cells(x), index.project(x[:queries], True)
    met = 0
    for t in range(cells.shape[1]):
        held: dict[tuple, int] = {}
        for c in map(tuple, cells[:, t].tolist()):
            held[c] = held.get(c, 0) + 1
        met += sum(held.get(c, 0) for p in asked[:, t] for c in index.visits(p, t))
    return met / (len(asked) * len(x))


def fit(v: DataFrame, k: int = 20, tables: int | None = None, recall: float = 0.97, sample: int = 4096, seed: int = 7) -> Index | None:
    """Choose the functions from the count and length of all vectors and a sample of them.

    The sample (about ``sample`` rows by a hash of the id, whatever the table's size) serves only
    to estimate how near the k-th neighbour is and, unless ``tables`` are given, of how many a query
    meets the fewest vectors. The number of functions grows with the logarithm of the count, so
    that cells keep their size. None for an empty table.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, length, dim = v.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return None
    v.select(F.assert_true(F.size("v") == dim, "vectors differ in dimension")).write.format("noop").mode("overwrite").save()
    rows = v.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))).select("v").toPandas()["v"]
    x = np.stack(rows.to_numpy()) if len(rows) else np.eye(1, dim)
    size = np.linalg.norm(x, axis=1)
    cos = (x[:256] / size[:256, None]) @ x.T / length
    np.fill_diagonal(cos, -1)
    rank = min(len(x) - 1, max(1, math.ceil(k * len(x) / n)))
    rho = float(np.clip(np.quantile(np.sort(cos, axis=1)[:, -rank], 0.1), 0.0, 0.99)) if len(x) > 1 else 0.0
    width, functions = 1.2, max(2, math.ceil(math.log(max(n / BLOCK, 1)) / math.log(4)))
    made = []
    for t in (tables,) if tables else (1, 2, 4):
        rng = np.random.default_rng(seed)
        index = Index(rng.standard_normal((t, functions, dim + 1)), rng.uniform(0, width, (t, functions)), width, float(length), rho, 1 - (1 - recall) ** (1 / t))
        index.share = _share(index, x)
        made.append(index)
    return min(made, key=lambda i: i.share)


def _top(k: int):
    def run(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, m = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(q) and len(m):
            m = m.sort_values("id", kind="stable")
            qx, mx, qi, mi = np.stack(q["v"].to_numpy()), np.stack(m["v"].to_numpy()), q["id"].to_numpy(), m["id"].to_numpy()
            start = np.flatnonzero(np.r_[True, mi[1:] != mi[:-1]])  # an id with several vectors has its best one's place
            for i in range(0, len(q), 512):
                s = qx[i : i + 512] @ mx.T
                s[qi[i : i + 512, None] == mi[None]] = -np.inf
                by_id = s if len(start) == len(mi) else np.maximum.reduceat(s, start, axis=1)
                least = np.partition(by_id, -k, axis=1)[:, -k] if by_id.shape[1] > k else np.full(len(s), -np.inf)
                a, b = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))
                exact = np.einsum("ij,ij->i", qx[i + a], mx[b])  # equal vectors get equal scores
                order = np.lexsort((mi[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                once = np.sort(np.unique(np.stack([a, mi[b]]), axis=1, return_index=True)[1]) if len(start) < len(mi) else slice(None)
                a, b, exact = a[once], b[once], exact[once]
                first = np.searchsorted(a, a)
                keep = np.arange(len(a)) - first < k
                out.append(pd.DataFrame({"query_id": qi[i + a[keep]], "vec_id": mi[b[keep]], "score": exact[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    return run


def search(vectors: DataFrame, is_query, k: int = 20, tables: int | None = None, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for each row where ``is_query``.

    ``is_query`` is a condition on ``id``. Score is the inner product in double precision; ties
    go to the smaller id. A query is no candidate of its own. Null, zero and non-finite vectors
    and null ids take no part; rows with equal ids and vectors count once; no usable vector, no
    row. Every vector is indexed; cells of any size are searched whole, in blocks. Other columns are
    not read, so their names do not matter; vectors of differing length are an error.
    """
    spark = vectors.sparkSession
    v = materialise(usable(vectors, id_col, vector_col), "ann-vectors")
    index = fit(v, k, tables, recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(index)  # tables x functions x dimensions numbers
    schema = "side int, cell string, id long, v array<double>"

    def matrix(column):
        return column.values.to_numpy().reshape(len(column), -1)

    def emit(side, cells, owner, b):
        owner = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), side, np.int32)), pa.array(cells, pa.string()), b.column(0).take(owner), b.column(1).take(owner)], ["side", "cell", "id", "v"])

    def members(batches):
        for b in batches:
            if b.num_rows:
                cells = held.value.cells(matrix(pa.concat_arrays([b.column(1)])))
                names = [f"{t}:{','.join(map(str, c))}" for row in cells.tolist() for t, c in enumerate(row)]
                yield emit(1, names, np.repeat(np.arange(b.num_rows), cells.shape[1]), b)

    def visits(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b, names, owner = whole.slice(i, 256), [], []
                index = held.value
                for r, row in enumerate(index.project(matrix(pa.concat_arrays([b.column(1)])), True)):
                    for t, p in enumerate(row):
                        got = index.visits(p, t)
                        names += [f"{t}:{','.join(map(str, c))}" for c in got]
                        owner += [r] * len(got)
                yield emit(0, names, owner, b)

    inside = v.mapInArrow(members, schema)
    asked = v.where(is_query).mapInArrow(visits, schema)
    blocks = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / BLOCK).cast("int")
    of = materialise(inside.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "ann-cells").join(materialise(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("q")), "ann-visits"), "cell").select("cell", blocks(F.col("m")).alias("ms"), blocks(F.col("q")).alias("qs"))
    mine = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.col(n)).cast("int")
    cols = ["cell", "q", "m", "side", "id", "v"]
    left = asked.join(of, "cell").withColumn("q", mine("qs", 1)).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    right = inside.join(of, "cell").withColumn("m", mine("ms", 2)).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    found = left.select(cols).union(right.select(cols)).groupBy("cell", "q", "m").applyInPandas(_top(k), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
