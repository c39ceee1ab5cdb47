"""Registered queries over the whole tables, each beside the SQL that gives the same rows.

`M` is the modelling table: orders with their customers, a label, and nulls put into two columns.
Train and test are the earlier three quarters and the latest quarter (`R`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import binning, drift, encoders, rfm, select, split, stats
from ..operators.core import round6
from ..sources import io

QUERIES: dict = {}
SQL: dict[str, str] = {}
CATE, CONT = ["priority", "status", "segment"], ["amount", "balance"]

M = """WITH m AS (SELECT o_orderkey AS id, o_orderdate AS t, o_totalprice AS amount, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y,
 o_orderpriority AS priority, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_acctbal END AS balance, c_nationkey AS nation
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
R = M + """, r AS (SELECT *, row_number() OVER (ORDER BY t DESC, id) <= floor(count(*) OVER () * 0.25) AS is_test FROM m),
 tr AS (SELECT * FROM r WHERE NOT is_test), te AS (SELECT * FROM r WHERE is_test)"""
LONG = "long AS (SELECT y, 'priority' AS feature, priority AS level FROM {0} UNION ALL SELECT y, 'status', status FROM {0} UNION ALL SELECT y, 'segment', segment FROM {0})"
WOE = """SELECT feature, level, n, pos, CASE WHEN pos = 0 THEN -4.6 WHEN pos = n THEN 4.6 ELSE ln((pos / tp) / ((n - pos) / tn)) END AS woe, pos / tp - (n - pos) / tn AS d, n / tt AS share, pos / n AS rate
 FROM (SELECT *, sum(pos) OVER (PARTITION BY feature)::DOUBLE AS tp, sum(n - pos) OVER (PARTITION BY feature)::DOUBLE AS tn, sum(n) OVER (PARTITION BY feature)::DOUBLE AS tt
 FROM (SELECT feature, level, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM {0} GROUP BY ALL))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("y"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"),
    )


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    marked = split.latest(model(spark, sf_dir), 0.25, "t", ["id"])
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: round6(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# profiles


@query(M + " SELECT feature, round((n - v) / n, 6) + 0.0 AS missing, round(v / n, 6) AS cover, round(v / s, 6) AS saturation FROM (SELECT 'segment' AS feature, count(segment)::DOUBLE v, count(*)::DOUBLE n, count(coalesce(segment, balance::VARCHAR))::DOUBLE s FROM m UNION ALL SELECT 'balance', count(balance), count(*), count(coalesce(segment, balance::VARCHAR)) FROM m)")
def missing_stats(spark, sf_dir):
    return stats.missing_stats(model(spark, sf_dir), ["segment", "balance"])


@query(M + ", " + LONG.format("m") + ", g AS (SELECT feature, coalesce(level, 'nan') AS v, count(*) AS n FROM long GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS k FROM g) SELECT feature, sum(n)::BIGINT AS count, count(*) AS \"unique\", max(CASE WHEN k = 1 THEN v END) AS top, max(CASE WHEN k = 1 THEN n END) AS freq, round(max(CASE WHEN k = 1 THEN n END) / sum(n), 6) AS freq_ratio FROM w GROUP BY feature")
def freq_stats(spark, sf_dir):
    return stats.freq_stats(model(spark, sf_dir), CATE)


def _desc(col):
    return f"SELECT '{col}' AS feature, count({col}) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std, min({col})::DOUBLE AS min, round(quantile_cont({col}, 0.25), 6) AS p25, round(quantile_cont({col}, 0.5), 6) AS p50, round(quantile_cont({col}, 0.75), 6) AS p75, max({col})::DOUBLE AS max FROM m"


@query(M + f" {_desc('amount')} UNION ALL {_desc('balance')}")
def desc_stats(spark, sf_dir):
    return stats.desc_stats(model(spark, sf_dir), CONT)


def _stats():
    cells = [f"SELECT '{c}' AS feature, {c}::VARCHAR AS v, coalesce(priority, status, segment, amount::VARCHAR, balance::VARCHAR) IS NOT NULL AS has FROM m" for c in [*CATE, *CONT]]
    return ", cells AS (" + " UNION ALL ".join(cells) + "), miss AS (SELECT feature, count(*)::DOUBLE AS n, count(v)::DOUBLE AS v, sum(has::INTEGER)::DOUBLE AS s FROM cells GROUP BY 1), g AS (SELECT feature, coalesce(v, 'nan') AS v, count(*) AS n FROM cells GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS k FROM g), freq AS (SELECT feature, sum(n)::BIGINT AS count, count(*) AS \"unique\", max(CASE WHEN k = 1 THEN v END) AS top, max(CASE WHEN k = 1 THEN n END) AS freq FROM w GROUP BY feature), d AS (" + " UNION ALL ".join(_desc(c) for c in CONT) + ")"


@query(M + _stats() + " SELECT miss.feature, round((n - v) / n, 6) + 0.0 AS missing, round(v / n, 6) AS cover, round(v / s, 6) AS saturation, freq.count, \"unique\", top, freq, round(freq / freq.count, 6) AS freq_ratio, mean, std, min, p25, p50, p75, max, CASE WHEN miss.feature IN ('amount', 'balance') THEN 'cont' ELSE 'cate' END AS type FROM miss JOIN freq USING (feature) LEFT JOIN d USING (feature)")
def data_stats(spark, sf_dir):
    return stats.data_stats(model(spark, sf_dir), [*CATE, *CONT], dict.fromkeys(CATE, "cate") | dict.fromkeys(CONT, "cont"))


@query(M + ", " + LONG.format("m") + ", g AS (SELECT feature, level, count(*)::DOUBLE AS n FROM long GROUP BY ALL) SELECT feature, round(coalesce(sum(CASE WHEN level IS NULL THEN n END), 0) / sum(n), 6) AS missing, round(max(CASE WHEN level IS NOT NULL THEN n END) / sum(n), 6) AS same, round(count(level) / sum(n), 6) AS \"unique\" FROM g GROUP BY feature")
def same_value_ratio(spark, sf_dir):
    return select.column_quality(model(spark, sf_dir), CATE)


@query(M + ", " + LONG.format("m") + ", g AS (SELECT feature, level, count(*)::DOUBLE AS n FROM long GROUP BY ALL), f AS (SELECT feature, coalesce(sum(CASE WHEN level IS NULL THEN n END), 0) AS nulls, count(level) AS u, max(CASE WHEN level IS NOT NULL THEN n END) AS top, sum(n) AS n FROM g GROUP BY feature) SELECT feature, round(nulls / n, 6) AS null_ratio, round(1 - nulls / n, 6) AS cover, round(u / n, 6) AS unique_ratio, round(top / n, 6) AS same_ratio FROM f UNION ALL SELECT 'dataset', round(sum(nulls) / sum(n), 6), round(1 - sum(nulls) / sum(n), 6), NULL, NULL FROM f")
def cover_stats(spark, sf_dir):
    return stats.cover_stats(model(spark, sf_dir), CATE)


@query(M + " SELECT status, round(avg(y), 6) AS rate, min(t) AS first_time, max(t) AS last_time, count(*) AS n FROM m GROUP BY status")
def target_stats(spark, sf_dir):
    return stats.target_stats(model(spark, sf_dir), "y", "t", "status")


@query(M + ", e AS (SELECT quantile_cont(balance, 0.05) AS lo, quantile_cont(balance, 0.95) AS hi FROM m) SELECT 'balance' AS feature, CASE WHEN balance IS NULL THEN 'missing' ELSE (CASE WHEN balance <= lo THEN 0 WHEN balance > lo + (hi - lo) * 20 / 20 THEN 21 ELSE (SELECT count(*) FROM range(0, 21) x(i) WHERE balance > lo + (hi - lo) * i / 20) END)::VARCHAR END AS bin, count(*) AS n FROM m, e GROUP BY ALL")
def distribution(spark, sf_dir):
    return stats.distribution(model(spark, sf_dir), ["balance"])


@query(M + ", " + LONG.format("m") + " SELECT feature, coalesce(level, 'missing') AS bin, count(*) AS n FROM long GROUP BY ALL")
def distribution_levels(spark, sf_dir):
    return stats.distribution(model(spark, sf_dir), CATE)


# splits and samples


@query(R + " SELECT is_test, count(*) AS n, sum(y)::BIGINT AS pos, min(t) AS lo, max(t) AS hi, sum(id)::BIGINT AS ids FROM r GROUP BY is_test")
def oot_split(spark, sf_dir):
    marked = split.latest(model(spark, sf_dir), 0.25, "t", ["id"])
    return marked.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("id").alias("ids"))


@query(M + ", r AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY t DESC, id) <= floor(count(*) OVER (PARTITION BY priority) * 0.2) AS is_test FROM m) SELECT priority, is_test, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY ALL")
def group_oot_split(spark, sf_dir):
    marked = split.latest_in_group(model(spark, sf_dir), 0.2, "t", "priority", ["id"])
    return marked.groupBy("priority", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(M + " SELECT count(*) AS rows, ceil(count(*) * 0.3)::BIGINT AS test FROM m")
def random_split_size(spark, sf_dir):
    marked = split.at_random(model(spark, sf_dir), 0.3, ["id"])
    return marked.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_test").cast("long")).alias("test"))


@query("WITH q(k, v) AS (VALUES ('1-URGENT', 40), ('2-HIGH', 30), ('5-LOW', 500)) SELECT id, priority FROM (SELECT o_orderkey AS id, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) JOIN q ON k = priority WHERE r <= v")
def stratified_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("t"))
    return split.take_newest(o, "priority", {"1-URGENT": 40, "2-HIGH": 30, "5-LOW": 500}, "t", ["id"]).select("id", "priority")


@query(M + ", w(priority, r) AS (VALUES ('1-URGENT', 3.0::DOUBLE), ('2-HIGH', 2.0), ('5-LOW', 1.0)), x AS (SELECT w.priority, r, n, n / r AS q FROM w JOIN (SELECT priority, count(*)::DOUBLE AS n FROM m GROUP BY 1) USING (priority)), a AS (SELECT arg_min(n, q) AS an, arg_min(r, q) AS ar FROM x WHERE priority = '1-URGENT' OR q * 6 >= 0.1 * (SELECT sum(n) FROM x)) SELECT priority, least(n, floor(an * r / ar))::BIGINT AS count FROM x, a")
def stratified_sample(spark, sf_dir):
    return split.sample(model(spark, sf_dir), "priority", "t", ["id"], {"1-URGENT": 3, "2-HIGH": 2, "5-LOW": 1}).groupBy("priority").count()


@query("SELECT CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_derivation(spark, sf_dir):
    x = split.derive_label(table(spark, sf_dir, "lineitem"), "l_quantity", "30d")
    return x.groupBy(F.col("30d").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(M + " SELECT y, k::INTEGER AS fold, (n - 1 - k) // 5 + 1 AS n FROM (SELECT y, count(*) AS n FROM m GROUP BY y), range(0, 5) f(k)")
def stratified_folds(spark, sf_dir):
    m = split.fold(model(spark, sf_dir), "y", 5, ["id"])
    return m.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT c_custkey AS id, c_acctbal + 1000 AS w FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY w DESC, id) AS r, floor(count(*) OVER () * 0.1) AS q FROM x), p AS (SELECT * FROM k WHERE r <= q) SELECT id, round(w / avg(w) OVER (), 6) AS w FROM p")
def cut_off_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 1000).alias("w"))
    return split.cut_off(c, "w", 0.1, ["id"])


# bins


def _binned(cuts: dict, df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), binning.bin_column(F.col(c).cast("double"), x).alias("bin")) for c, x in cuts.items()]
    return df.select("y", F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))


@query(M + ", e AS (SELECT min(balance) AS lo, max(balance) AS hi FROM m) SELECT 'balance' AS feature, CASE WHEN balance IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM range(1, 10) x(i) WHERE balance > lo + (hi - lo) * i / 10) END::INTEGER AS bin, count(*) AS n, sum(y)::BIGINT AS pos FROM m, e GROUP BY ALL")
def cut_bins(spark, sf_dir):
    m = model(spark, sf_dir)
    return _binned(binning.equal_width(m, ["balance"], 10), m)


@query(M + ", e AS (SELECT unnest(quantile_cont(balance, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM m) SELECT 'balance' AS feature, CASE WHEN balance IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM e WHERE balance > q) END::INTEGER AS bin, count(*) AS n, sum(y)::BIGINT AS pos FROM m GROUP BY ALL")
def qcut_bins(spark, sf_dir):
    m = model(spark, sf_dir)
    return _binned(binning.cut_points(m, ["balance"], "qcut", 10), m)


@query("WITH x AS (SELECT CASE WHEN l_quantity <= 20 THEN 5 ELSE l_quantity END AS v FROM lineitem), h AS (SELECT v FROM x GROUP BY v HAVING count(*) >= 0.05 * (SELECT count(*) FROM x)), e AS (SELECT v FROM h UNION SELECT unnest(quantile_cont(v, [i / 9.0 for i in range(0, 10)])) FROM x WHERE v NOT IN (SELECT v FROM h)) SELECT round(v, 6) AS edge FROM e")
def heavy_edges(spark, sf_dir):
    q = F.col("l_quantity")
    x = table(spark, sf_dir, "lineitem").select(F.when(q <= 20, 5.0).otherwise(q).alias("v"))
    return spark.createDataFrame([(float(e),) for e in binning.heavy_quantiles(x, ["v"], 10)["v"]], "edge double")


@query()
def tree_bins(spark, sf_dir):
    m = model(spark, sf_dir)
    return _binned(binning.cut_points(m, ["balance", "nation"], "dt", 8, "y"), m)


@query()
def monotonic_bins(spark, sf_dir):
    m = model(spark, sf_dir)
    return _binned(binning.cut_points(m, ["balance", "amount"], "monot", label="y"), m)


@query(M + ", e AS (SELECT unnest(quantile_cont(balance, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM m) SELECT (1 + (SELECT count(*) FROM e WHERE balance > q))::VARCHAR AS bin, status, count(*) AS n, round(avg(y), 6) AS rate FROM m WHERE balance IS NOT NULL GROUP BY ALL")
def bin_rates(spark, sf_dir):
    m = model(spark, sf_dir).where("balance IS NOT NULL")
    return stats.feature_curve(m, "balance", "y", "status")


_DECILES = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"


def _contrast(base):
    return f""", p AS (SELECT *, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM r),
 e AS (SELECT 'amount' AS feature, unnest(quantile_cont(amount, {_DECILES})) AS q FROM {base} UNION ALL SELECT 'balance', unnest(quantile_cont(balance, {_DECILES})) FROM {base}),
 x AS (SELECT part, y, 'amount' AS feature, amount AS v, NULL AS level FROM p UNION ALL SELECT part, y, 'balance', balance, NULL FROM p UNION ALL SELECT part, y, 'segment', NULL, segment FROM p),
 b AS (SELECT part, y, feature, CASE WHEN feature = 'segment' THEN level WHEN v IS NOT NULL THEN (1 + (SELECT count(*) FROM e WHERE e.feature = x.feature AND x.v > e.q))::VARCHAR END AS bin FROM x),
 g AS (SELECT * FROM (SELECT DISTINCT part FROM b), (SELECT DISTINCT feature, bin FROM b))
 SELECT g.part, g.feature, g.bin, count(b.y) AS n, round(coalesce(avg(b.y), 0), 6) AS rate FROM g LEFT JOIN b ON g.part = b.part AND g.feature = b.feature AND g.bin IS NOT DISTINCT FROM b.bin GROUP BY ALL"""


def _in_parts(spark, sf_dir):
    marked = split.latest(model(spark, sf_dir), 0.25, "t", ["id"])
    return marked.withColumn("part", F.when(F.col("is_test"), "test").otherwise("train"))


@query(R + _contrast("tr"))
def contrast_rates(spark, sf_dir):
    return stats.contrast_curves(_in_parts(spark, sf_dir), ["amount", "balance", "segment"], "y", "part", base="train")


@query(R + _contrast("m"))
def rates_by_part(spark, sf_dir):
    return stats.contrast_curves(_in_parts(spark, sf_dir), ["amount", "balance", "segment"], "y", "part")


@query(R + ", e AS (SELECT DISTINCT unnest(quantile_cont(balance, [i / 20.0 for i in range(1, 20)])) AS q FROM tr), b AS (SELECT CASE WHEN balance IS NULL THEN 'missing' ELSE (1 + (SELECT count(*) FROM e WHERE balance > q))::VARCHAR END AS k FROM te) SELECT k, count(*) AS n FROM b GROUP BY k")
def histogram(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    h = binning.HistogramEncoder().fit(train, ["balance"])
    number = {v: str(k) for k, v in binning.bin_labels(h.cuts["balance"]).items()}
    names = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    return h.transform(test).select(F.coalesce(F.element_at(names, F.col("bin")), F.col("bin")).alias("k"), "n")


# encoders


@query(R + ", g AS (SELECT segment, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS v FROM tr GROUP BY segment) SELECT te.id, round(coalesce(v, 0), 6) AS segment_count FROM te LEFT JOIN g ON te.segment IS NOT DISTINCT FROM g.segment")
def count_encode(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return encoders.CountEncoder(columns=["segment"]).fit(train).transform(test).select("id", "segment_count")


@query(R + ", g AS (SELECT status, ln(count(*) + 1.0) AS v FROM tr GROUP BY status) SELECT te.id, round(coalesce(v, 0), 6) AS status_count FROM te LEFT JOIN g ON te.status IS NOT DISTINCT FROM g.status")
def log_count_encode(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return encoders.CountEncoder(columns=["status"], mode="log_count").fit(train).transform(test).select("id", "status_count")


@query(R + ", " + LONG.format("tr") + ", w AS (" + WOE.format("long") + ") SELECT feature, level, n::BIGINT AS n, pos::BIGINT AS pos, round(woe, 6) + 0.0 AS woe, round(d * woe, 6) + 0.0 AS iv FROM w")
def woe_iv(spark, sf_dir):
    """Flagship: weight of evidence and information value on the out-of-time split's train part."""
    train, _ = parts(spark, sf_dir)
    return encoders.woe_table(train, CATE, "y").select("feature", "level", "n", "pos", "woe", "iv")


@query(R + ", " + LONG.format("tr") + ", w AS (" + WOE.format("long") + ") SELECT te.id, round(coalesce(w.woe, 0), 6) + 0.0 AS segment_woe FROM te LEFT JOIN w ON w.feature = 'segment' AND te.segment IS NOT DISTINCT FROM w.level")
def woe_transform(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return encoders.WOEEncoder(columns=["segment"]).fit(train, "y").transform(test).select("id", "segment_woe")


@query(R + ", " + LONG.format("te") + ", w AS (" + WOE.format("long") + ") SELECT feature, level, n::BIGINT AS total_sample_num, pos::BIGINT AS overdue_sample_num, round(rate, 6) AS overdue_ratio, round(share, 6) AS group_sample_ratio, round(woe, 6) + 0.0 AS woe, round(sum(d * woe) OVER (PARTITION BY feature), 6) + 0.0 AS \"IV\" FROM w")
def woe_report(spark, sf_dir):
    return stats.woe_report(parts(spark, sf_dir)[1], CATE, "y")


def _binned_levels(part, name):
    bins = lambda c: f"CASE WHEN {c} IS NULL THEN '0' ELSE (1 + (SELECT count(*) FROM e WHERE c = '{c}' AND {c} > q))::VARCHAR END"
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {bins(c)} AS level FROM {part}" for c in CONT) + ")"


EDGES = R + ", e AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, unnest(quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM tr" for c in CONT) + "), "


@query(EDGES + _binned_levels("te", "long") + ", w AS (" + WOE.format("long") + ") SELECT feature, level, n::BIGINT AS total_sample_num, pos::BIGINT AS overdue_sample_num, round(rate, 6) AS overdue_ratio, round(share, 6) AS group_sample_ratio, round(woe, 6) + 0.0 AS woe, round(sum(d * woe) OVER (PARTITION BY feature), 6) + 0.0 AS \"IV\" FROM w")
def woe_report_of_bins(spark, sf_dir):
    """Report of test over quantile bins that are fitted on train."""
    train, test = parts(spark, sf_dir)
    return stats.binned_woe_report(test, binning.ContBinningEncoder(10, "qcut", columns=CONT).fit(train), "y")


@query(EDGES + _binned_levels("tr", "l1") + ", " + _binned_levels("te", "l2") + ", a AS (" + WOE.format("l1") + "), b AS (" + WOE.format("l2") + ") SELECT coalesce(a.feature, b.feature) AS feature, " + ", ".join(f"round(sum((coalesce(a.{c}, 0) - coalesce(b.{c}, 0)) * ln((coalesce(a.{c}, 0) + 0.01) / (coalesce(b.{c}, 0) + 0.01))), 6) + 0.0 AS {k}" for c, k in (("share", "v_psi"), ("rate", "l_psi"))) + " FROM a FULL JOIN b ON a.feature = b.feature AND a.level = b.level GROUP BY 1")
def psi_of_bins(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return drift.binned_psi(train, test, binning.ContBinningEncoder(10, "qcut", columns=CONT).fit(train), "y")


@query(M + ", l AS (SELECT concat_ws('|', coalesce(priority, 'nan'), coalesce(segment, 'nan')) AS level, 'priority+segment' AS feature, y FROM m), w AS (" + WOE.format("l") + ") SELECT feature, round(sum(d * woe), 6) + 0.0 AS iv FROM w GROUP BY feature")
def combined_iv(spark, sf_dir):
    return encoders.combined_iv(model(spark, sf_dir), ["priority", "segment"], "y")


@query(M + ", l AS (SELECT status AS hue, segment AS level, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM m GROUP BY ALL), w AS (SELECT *, pos / sum(pos) OVER (PARTITION BY hue) AS p, (n - pos) / sum(n - pos) OVER (PARTITION BY hue) AS q FROM l) SELECT hue AS status, 'segment' AS feature, round(sum((p - q) * CASE WHEN p = 0 THEN -4.6 WHEN q = 0 THEN 4.6 ELSE ln(p / q) END), 6) + 0.0 AS iv FROM w GROUP BY hue")
def iv_by_group(spark, sf_dir):
    return encoders.information_value(model(spark, sf_dir), ["segment"], "y", "status")


@query(R + ", g AS (SELECT segment, row_number() OVER (ORDER BY segment)::DOUBLE AS v FROM (SELECT DISTINCT segment FROM tr WHERE segment IS NOT NULL)) SELECT te.id, coalesce(v, 0.0) AS segment_label FROM te LEFT JOIN g USING (segment)")
def label_encode(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return encoders.LabelEncoder(columns=["segment"]).fit(train).transform(test).select("id", "segment_label")


@query(M + " SELECT id, (status = 'F')::INTEGER AS status_1_onehot, (status = 'O')::INTEGER AS status_2_onehot, (status = 'P')::INTEGER AS status_3_onehot FROM m")
def onehot_encode(spark, sf_dir):
    m = model(spark, sf_dir)
    return encoders.OneHotEncoder(columns=["status"]).fit(m).transform(m).select("id", *[f"status_{i}_onehot" for i in (1, 2, 3)])


@query(R + ", p AS (SELECT avg(y) AS p FROM tr), g AS (SELECT segment, (sum(y) + 0.1 * count(*) * max(p)) / (count(*) * 1.1) AS v FROM tr, p GROUP BY segment) SELECT te.id, round(coalesce(v, p), 6) AS segment_target FROM te CROSS JOIN p LEFT JOIN g ON te.segment IS NOT DISTINCT FROM g.segment")
def target_encode(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return encoders.TargetEncoder(columns=["segment"]).fit(train, "y").transform(test).select("id", "segment_target")


@query(M + " SELECT id, coalesce(balance, -999.0) AS balance, coalesce(segment, '-999') AS segment FROM m")
def impute(spark, sf_dir):
    return encoders.ImputeEncoder(-999, ["balance", "segment"]).fit(model(spark, sf_dir)).transform(model(spark, sf_dir)).select("id", "balance", "segment")


@query(M + " SELECT id, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM m)), 6) AS balance FROM m")
def impute_median(spark, sf_dir):
    m = model(spark, sf_dir)
    return encoders.ContImputerEncoder("median", ["balance"]).fit(m).transform(m).select("id", "balance")


@query(M + ", q AS (SELECT quantile_cont(balance, 0.025) AS lo, quantile_cont(balance, 0.975) AS hi FROM m), x AS (SELECT id, CASE WHEN balance IS NOT NULL THEN greatest(lo, least(hi, balance)) END AS v FROM m, q) SELECT id, round(v * 0.4 / (SELECT stddev_pop(v) FROM x), 6) + 0.0 AS balance FROM x")
def fried_scale(spark, sf_dir):
    m = model(spark, sf_dir)
    return encoders.FriedScale(columns=["balance"]).fit(m).transform(m).select("id", "balance")


APPS = {"red": "warm", "blue": "cold", "small": "size", "large": "size", "ring": "thing", "bolt": "thing", "widget": "thing"}


@query("WITH d(w, c) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in APPS.items()) + "), x AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS l FROM part), y AS (SELECT id, " + ", ".join(f"(SELECT count(*) FROM unnest(l) u(w) JOIN d USING (w) WHERE c = '{c}')::INTEGER AS app_{c}" for c in sorted(set(APPS.values()))) + " FROM x) SELECT *, " + ", ".join(f"round(app_{c} / nullif(app_cold + app_size + app_thing + app_warm, 0)::DOUBLE, 6) AS app_{c}_ratio" for c in sorted(set(APPS.values()))) + " FROM y")
def app_categories(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return encoders.AppCateEncoder(APPS, " ").fit().transform(p, "p_name").drop("p_name")


@query(M + ", l AS (SELECT status, row_number() OVER (ORDER BY status) AS k FROM (SELECT DISTINCT status FROM m)) SELECT id, '[0, ' || (1 + k) || ']' AS idx, round(coalesce(balance, 0.0), 6) AS v FROM m JOIN l USING (status)")
def index_value(spark, sf_dir):
    m = model(spark, sf_dir)
    x = encoders.IndexValueEncoder(["status"], ["balance"]).fit(m).transform(m)
    return x.select("id", F.concat(F.lit("["), F.array_join(F.col("idx").cast("array<string>"), ", "), F.lit("]")).alias("idx"), F.col("val")[0].alias("v"))


@query(R + ", " + LONG.format("tr") + ", p AS (SELECT avg(y) AS p FROM tr) SELECT 'segment' AS feature, level, round(CASE WHEN level IS NULL THEN greatest(-20, least(20, ln(((pos + floor(n_all * p * 0.01)) / (n_all * p)) / ((n - pos + floor(n_all * (1 - p) * 0.01)) / (n_all * (1 - p)))))) ELSE woe END, 6) + 0.0 AS value FROM (" + WOE.format("long") + "), p, (SELECT count(*) AS n_all FROM tr) WHERE feature = 'segment'")
def smoothed_woe(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    return encoders.WOEEncoder(columns=["segment"], woe_min=-20, woe_max=20, null_policy="smoothed").fit(train, "y").table


# scores


@query(M + ", e AS (SELECT DISTINCT unnest(quantile_cont(balance, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM m WHERE balance IS NOT NULL), b AS (SELECT (1 + (SELECT count(*) FROM e WHERE balance > q))::INTEGER AS band, count(*)::DOUBLE AS n, avg(balance) AS ms, sum(y)::DOUBLE AS bad FROM m WHERE balance IS NOT NULL GROUP BY 1), w AS (SELECT *, sum(n) OVER (ORDER BY band) AS cn, sum(bad) OVER (ORDER BY band) AS cb, sum(n) OVER () AS tn, sum(bad) OVER () AS tb FROM b) SELECT band, n::BIGINT AS n, round(n / tn, 6) AS ratio, round(cn / tn, 6) AS cum_ratio, round(ms, 6) AS mean_score, bad::BIGINT AS bad_n, round(bad / tb, 6) AS bad_share, cb::BIGINT AS cum_bad_n, round(cb / tb, 6) AS cum_bad_share, round(bad / n, 6) AS bad_rate, round(cb / tn, 6) AS cum_bad_of_all, round(cb / cn, 6) AS cum_bad_rate, round((cn - cb) / (tn - tb), 6) AS cum_good_share, round(((tb - cb + bad) / tb) / ((tn - cn + n) / tn), 6) AS lift FROM w")
def score_bands(spark, sf_dir):
    m = model(spark, sf_dir).where("balance IS NOT NULL")
    return stats.score_bands(m, "balance", "y", stats.score_edges(m, "balance")).drop("interval")


ROC = M + ", s AS (SELECT balance AS score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM m WHERE balance IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM s WINDOW w AS (ORDER BY score DESC)), p AS (SELECT score, n, pos, cn, cp, cp / tp AS tpr, (cn - cp) / (tn - tp) AS fpr, cp / cn AS pr, cn / tn AS share FROM c)"


@query(ROC + " SELECT score, n::BIGINT AS n, pos::BIGINT AS pos, cn::BIGINT AS cum_n, cp::BIGINT AS cum_pos, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(pr, 6) AS precision, round(2 * pr * tpr / nullif(pr + tpr, 0), 6) AS f1, round(share, 6) AS share FROM p")
def roc_points(spark, sf_dir):
    return stats.roc_points(model(spark, sf_dir), "balance", "y")


@query(ROC + " SELECT round(tpr - fpr, 6) AS ks, score AS threshold, round(share, 6) AS share FROM p ORDER BY tpr - fpr DESC, score DESC LIMIT 1")
def ks_curve(spark, sf_dir):
    return stats.ks(model(spark, sf_dir), "balance", "y")


@query(ROC + " SELECT 'balance' AS feature, round(max(abs(tpr - fpr)), 6) AS ks FROM p")
def ks_statistic(spark, sf_dir):
    return stats.ks_statistic(model(spark, sf_dir), ["balance"], "y")


@query(M + ", s AS (SELECT balance AS score, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM m WHERE balance IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(n - pos) OVER (ORDER BY score) - (n - pos) AS below FROM s) SELECT round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS auc FROM c")
def auc_exact(spark, sf_dir):
    return stats.auc(model(spark, sf_dir), "balance", "y")


@query(M + ", x AS (SELECT status, 'balance' AS feature, balance AS v, y FROM m UNION ALL SELECT status, 'nation', nation, y FROM m), s AS (SELECT status, feature, coalesce(v, -999) AS v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM x GROUP BY ALL), c AS (SELECT *, sum(n - pos) OVER (PARTITION BY status, feature ORDER BY v) - (n - pos) AS below FROM s), a AS (SELECT status, feature, sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)) AS a FROM c GROUP BY ALL), k AS (SELECT status, feature, max(abs(cp / tp - (cn - cp) / (tn - tp))) AS ks FROM (SELECT status, feature, sum(n) OVER o AS cn, sum(pos) OVER o AS cp, sum(n) OVER p AS tn, sum(pos) OVER p AS tp FROM (SELECT status, feature, v, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM x WHERE v IS NOT NULL GROUP BY ALL) WINDOW o AS (PARTITION BY status, feature ORDER BY v), p AS (PARTITION BY status, feature)) GROUP BY ALL) SELECT status, feature, round(greatest(a, 1 - a), 6) AS auc, round(ks, 6) AS ks FROM a JOIN k USING (status, feature)")
def feature_evaluation(spark, sf_dir):
    return stats.feature_evaluation(model(spark, sf_dir), ["balance", "nation"], "y", "status")


@query(M + ", e AS (SELECT DISTINCT unnest(quantile_cont(balance, [i / 20.0 for i in range(1, 20)])) AS q FROM m WHERE balance IS NOT NULL), b AS (SELECT ((SELECT count(*) FROM e) + 1 - (SELECT count(*) FROM e WHERE balance > q))::INTEGER AS band, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM m WHERE balance IS NOT NULL GROUP BY 1) SELECT band, n::BIGINT AS n, pos::BIGINT AS pos, round(sum(n) OVER (ORDER BY band) / sum(n) OVER (), 6) AS depth, round((sum(pos) OVER (ORDER BY band) / sum(n) OVER (ORDER BY band)) / (sum(pos) OVER () / sum(n) OVER ()), 6) AS lift FROM b")
def lift_curve(spark, sf_dir):
    return stats.lift_curve(model(spark, sf_dir).where("balance IS NOT NULL"), "balance", "y", 20)


PASS = M + ", s AS (SELECT y, row_number() OVER (ORDER BY balance, id) AS r, count(*) OVER () AS n FROM m WHERE balance IS NOT NULL), k AS (SELECT i::INTEGER AS pass_rate, (i * (SELECT max(n) FROM s)) // 100 AS k FROM range(0, 101) x(i)), p AS (SELECT pass_rate, k, coalesce((SELECT sum(y) FROM s WHERE r <= k), 0) / CASE WHEN k > 0 THEN k ELSE 1 END::DOUBLE AS bad_rate FROM k)"


@query(PASS + " SELECT pass_rate, k AS n, round(bad_rate, 6) AS bad_rate FROM p")
def pass_curve(spark, sf_dir):
    return stats.pass_curve(model(spark, sf_dir).where("balance IS NOT NULL"), "balance", "y", "id")


@query(PASS + " SELECT pass_rate, round(0.8 * (10 * (1 - bad_rate) * pass_rate / 100 - 6 * pass_rate / 100 * bad_rate - 0.1) - 0.2 - 0.05, 6) + 0.0 AS profit FROM p")
def profit_curve(spark, sf_dir):
    return stats.profit_curve(model(spark, sf_dir).where("balance IS NOT NULL"), "balance", "y", "id", 10, 6, 0.8, 0.1, 0.2, 0.05).select("pass_rate", "profit")


@query(ROC + ", t(top) AS (VALUES (0.01::DOUBLE), (0.05), (0.1)) SELECT top, round(min(share), 6) AS share, round(arg_min(pr, share) / (SELECT avg(y) FROM m WHERE balance IS NOT NULL), 6) AS lift FROM p JOIN t ON share >= top GROUP BY top")
def lift_at_top(spark, sf_dir):
    return stats.lift_at(model(spark, sf_dir), "balance", "y")


@query(PASS + ", c AS (SELECT pass_rate, bad_rate, 0.8 * (10 * (1 - bad_rate) * pass_rate / 100 - 6 * pass_rate / 100 * bad_rate - 0.1) - 0.2 - 0.05 AS profit FROM p) SELECT pass_rate, round(profit, 6) + 0.0 AS profit, round(bad_rate, 6) AS bad_rate, (SELECT round(profit, 6) + 0.0 FROM c WHERE pass_rate = 40) AS spec_profit FROM c ORDER BY round(profit, 9) DESC, pass_rate LIMIT 1")
def best_pass_rate(spark, sf_dir):
    curve = stats.profit_curve(model(spark, sf_dir).where("balance IS NOT NULL"), "balance", "y", "id", 10, 6, 0.8, 0.1, 0.2, 0.05)
    return stats.best_pass_rate(curve, 40)


@query("SELECT c_custkey AS id, round(greatest(350, least(950, 473.48 - 72.14 * ln(p / (1 - p)))), 4) AS score FROM (SELECT c_custkey, (c_acctbal + 1000) / 12000 AS p FROM customer)")
def prob_to_score(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), scalars.prob_to_score((F.col("c_acctbal") + 1000) / 12000).alias("score"))


@query(M + " SELECT round(423.82 - 72.14 * ln(20) + 72.14 * ln(avg(y) / (1 - avg(y))), 6) AS a FROM m")
def score_offset(spark, sf_dir):
    return scalars.new_offset(model(spark, sf_dir), "y", 20)


def _gini_sql(by):
    return f"(SELECT (sum(n * (ca - a) + a * (n + 1) / 2) / sum(a) - (sum(n) + 1) / 2) / sum(n) AS g FROM (SELECT *, sum(a) OVER (ORDER BY s DESC) AS ca FROM (SELECT {by} AS s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS a FROM x GROUP BY 1)))"


@query(M + ", x AS (SELECT * FROM m WHERE balance IS NOT NULL), a AS " + _gini_sql("balance") + ", b AS " + _gini_sql("y") + " SELECT round(a.g, 6) + 0.0 AS gini, round(a.g / b.g, 6) + 0.0 AS gini_norm FROM a, b")
def gini(spark, sf_dir):
    return stats.gini(model(spark, sf_dir).where("balance IS NOT NULL"), "y", "balance")


RULES = ["amount > 400000", "balance <= 0", "status = 'F' AND nation < 10"]


@query(M + ", u AS (" + " UNION ALL ".join(f"SELECT '{r.replace(chr(39), chr(39) * 2)}' AS rule, coalesce({r}, false) AS h, y FROM m" for r in RULES) + "), a AS (SELECT rule, k AS class, sum(h::INTEGER)::BIGINT AS count, sum((h AND y = k)::INTEGER)::BIGINT AS hits, sum((y = k)::INTEGER)::DOUBLE AS size, count(*)::DOUBLE AS n FROM u, (VALUES (0), (1)) v(k) GROUP BY ALL) SELECT rule, class, count, hits, round(hits / count, 6) AS precision, round(hits / size, 6) AS recall, round(2 * (hits / count) * (hits / size) / nullif(hits / count + hits / size, 0), 6) AS f1, round((hits / count) / (size / n), 6) AS lift FROM a")
def rule_metrics(spark, sf_dir):
    return stats.rule_metrics(model(spark, sf_dir), RULES, "y")


@query(M + ", x AS (SELECT y, 'balance' AS feature, coalesce(balance, -999) AS v FROM m UNION ALL SELECT y, 'nation', nation FROM m), g AS (SELECT feature, y, count(*)::DOUBLE AS n, sum(v) AS s, var_pop(v) AS vp FROM x GROUP BY ALL) SELECT feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))), 6) AS f, (count(*) - 1)::BIGINT AS df1, (sum(n) - count(*))::BIGINT AS df2 FROM g GROUP BY feature")
def anova_f(spark, sf_dir):
    return select.anova(model(spark, sf_dir), ["balance", "nation"], "y").select("feature", "f", F.col("df1").cast("long").alias("df1"), F.col("df2").cast("long").alias("df2"))


# drift


@query(R + ", q AS (SELECT quantile_cont(balance, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) AS q FROM tr), e AS (SELECT q[1] - 0.2 * (q[11] - q[1]) AS lo, q[11] + 0.2 * (q[11] - q[1]) AS hi, q FROM q), c AS (SELECT k, b, count(*)::DOUBLE AS n FROM (SELECT k, CASE WHEN v < lo OR v > hi THEN 0 ELSE 1 + (SELECT count(*) FROM range(2, 11) x(i) WHERE v > q[i]) END AS b FROM (SELECT 'e' AS k, balance AS v FROM tr UNION ALL SELECT 'a', balance FROM te), e WHERE v IS NOT NULL) GROUP BY ALL), f AS (SELECT i AS b, coalesce((SELECT n FROM c WHERE k = 'e' AND b = i), 0) AS e, coalesce((SELECT n FROM c WHERE k = 'a' AND b = i), 0) AS a FROM range(0, 11) x(i)), s AS (SELECT b, e / (SELECT sum(e) FROM f WHERE b > 0) AS pe, (a + 0.0001) / (SELECT sum(a) + 10 * 0.0001 FROM f WHERE b > 0) AS pa FROM f WHERE b > 0) SELECT 'balance' AS feature, round(sum((pa - pe) * CASE WHEN pe = 0 THEN 10 ELSE greatest(-10, least(10, ln(pa / pe))) END), 6) AS psi, round((SELECT sum(CASE WHEN b = 0 THEN a ELSE 0 END) / sum(a) FROM f), 6) AS extreme_ratio FROM s")
def psi(spark, sf_dir):
    return drift.psi(*parts(spark, sf_dir), ["balance"])


def _report_psi(value):
    return R + ", " + LONG.format("tr").replace("long AS", "l1 AS") + ", " + LONG.format("te").replace("long AS", "l2 AS") + ", a AS (" + WOE.format("l1") + "), b AS (" + WOE.format("l2") + f") SELECT coalesce(a.feature, b.feature) AS feature, round(sum((coalesce(a.{value}, 0) - coalesce(b.{value}, 0)) * ln((coalesce(a.{value}, 0) + 0.01) / (coalesce(b.{value}, 0) + 0.01))), 6) + 0.0 AS psi FROM a FULL JOIN b ON a.feature = b.feature AND a.level IS NOT DISTINCT FROM b.level GROUP BY 1"


@query(_report_psi("share"))
def v_psi(spark, sf_dir):
    return drift.volume_psi(*parts(spark, sf_dir), CATE, "y")


@query(_report_psi("rate"))
def l_psi(spark, sf_dir):
    return drift.label_psi(*parts(spark, sf_dir), CATE, "y")


@query(R + ", a AS (SELECT coalesce(segment, 'nan') AS b, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS p FROM tr GROUP BY 1), c AS (SELECT coalesce(segment, 'nan') AS b, count(*) / (SELECT count(*) FROM te)::DOUBLE AS q FROM te GROUP BY 1) SELECT 'segment' AS feature, round(sum((coalesce(p, 0) - coalesce(q, 0)) * ln((coalesce(p, 0) + 0.01) / (coalesce(q, 0) + 0.01))), 6) + 0.0 AS psi FROM a FULL JOIN c USING (b)")
def h_psi(spark, sf_dir):
    return drift.histogram_psi(*parts(spark, sf_dir), ["segment"])


@query(R + " SELECT 'balance' AS feature, CASE WHEN is_test THEN 'test' ELSE 'train' END AS dataset, count(balance) AS n, (count(*) - count(balance))::BIGINT AS nulls, round(avg(balance), 6) AS mean, round(var_pop(balance), 4) AS var FROM r GROUP BY is_test")
def moments_two_sample(spark, sf_dir):
    return drift.moments(*parts(spark, sf_dir), ["balance"]).withColumn("var", F.round("var", 4))


@query(R + ", g AS (SELECT balance AS x, sum((NOT is_test)::INTEGER)::DOUBLE AS a, sum(is_test::INTEGER)::DOUBLE AS b FROM r WHERE balance IS NOT NULL GROUP BY 1) SELECT round(max(abs(ca / ta - cb / tb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM g)")
def ks_two_sample(spark, sf_dir):
    return drift.ks_two_sample(*parts(spark, sf_dir), "balance").select("ks")


@query()
def consistency_tests(spark, sf_dir):
    return drift.consistency_tests(*parts(spark, sf_dir), ["balance", "amount"])


def _perturbed(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))


PAIRS = "WITH p AS (SELECT o_orderkey AS k, round(o_totalprice, 3) AS x1, round(CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 3) AS x2, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS s1, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s2 FROM orders)"


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return drift.common_rows(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus"))), _perturbed(o), "o_orderkey")


@query(PAIRS + " SELECT 'o_totalprice' AS feature, round(avg((x1 = x2)::INTEGER), 6) AS raw, round(avg((x1 = x2)::INTEGER), 6) AS filled FROM p UNION ALL SELECT 'o_orderstatus', round(avg(coalesce(s1 = s2, false)::INTEGER), 6), round(avg((s1 IS NOT DISTINCT FROM s2)::INTEGER), 6) FROM p")
def consistency_ratio(spark, sf_dir):
    return drift.consistency_ratio(_pairs(spark, sf_dir), ["o_totalprice", "o_orderstatus"])


@query(PAIRS + " SELECT k AS o_orderkey, CASE WHEN s1 IS DISTINCT FROM s2 THEN 'a:' || coalesce(s1, 'null') || ', b:' || coalesce(s2, 'null') END AS o_orderstatus FROM p")
def difference_values(spark, sf_dir):
    return drift.difference_values(_pairs(spark, sf_dir), "o_orderkey", ["o_orderstatus"])


def _three(spark, sf_dir):
    """Orders as they are with their customers, with nulls, and with zeros for those and other names."""
    o, k, x = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    a = o.select("o_orderkey", F.when(k % 9 != 0, x).alias("o_totalprice"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    b = o.select(k.alias("ORDER_ID"), F.when(k % 9 == 0, 0.0).when(k % 10 == 0, x + 1).otherwise(x).alias("Price"), F.when(k % 6 != 0, F.col("o_orderstatus")).alias("STATE"))
    c = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", "o_orderstatus", "c_acctbal")
    names = {"order_id": "o_orderkey", "PRICE": "o_totalprice", "state": "o_orderstatus"}
    return drift.compare_all("o_orderkey", {"a": a, "b": b, "c": c}, {"b": names}, beside={"whole": o})


THREE = """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice, 3) END AS xa, CASE WHEN o_orderkey % 9 = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 10 = 0 THEN round(o_totalprice + 1, 3) ELSE round(o_totalprice, 3) END AS xb, round(o_totalprice, 3) AS xc,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS sa, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS sb, o_orderstatus AS sc FROM orders JOIN customer ON o_custkey = c_custkey)"""
_RATES = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS rows, round(avg(coalesce({x}{a} = {x}{b}, false)::INT), 6) AS raw, round(avg(({zero})::INT), 6) AS at_zero, round(avg(({missing})::INT), 6) AS at_missing, round(avg(({zero})::INT) - avg(({missing})::INT), 6) + 0.0 AS zero_or_null, sum(({zero})::INT) = sum(({missing})::INT) AS consistent FROM p"
    for a, b in ("ab", "ac", "bc") for f, x in (("o_totalprice", "x"), ("o_orderstatus", "s"))
    for zero, missing in [[f"coalesce(x{a}, {v}) = coalesce(x{b}, {v})" for v in (0, -999)] if x == "x" else [f"s{a} IS NOT DISTINCT FROM s{b}"] * 2]
)


@query(THREE + " " + _RATES)
def three_way_rates(spark, sf_dir):
    return _three(spark, sf_dir)["rates"]


@query(THREE + " SELECT k AS key, 'o_orderstatus' AS feature, sa AS a, sb AS b, sc AS c FROM p WHERE sa IS DISTINCT FROM sb OR sa IS DISTINCT FROM sc")
def three_way_differences(spark, sf_dir):
    return _three(spark, sf_dir)["differences"].where("feature = 'o_orderstatus'")


@query(THREE + " SELECT 'o_totalprice' AS feature, round(avg(xa), 6) AS a, round(avg(xb), 6) AS b, round(avg(xc), 6) AS c, (SELECT round(avg(o_totalprice), 6) FROM orders) AS whole FROM p")
def three_way_means(spark, sf_dir):
    return _three(spark, sf_dir)["means"]


@query(R + ", a AS (SELECT status AS feature, avg(balance) AS tr FROM tr GROUP BY 1), b AS (SELECT status AS feature, avg(balance) * 1.5 AS te FROM te GROUP BY 1) SELECT feature, 'mean' AS metric, round(tr, 6) AS train, round(te, 6) AS test, round(1 - (te + 0.01) / (tr + 0.01), 6) AS difference FROM a JOIN b USING (feature) WHERE abs(1 - (te + 0.01) / (tr + 0.01)) >= 0.2")
def drift_warnings(spark, sf_dir):
    a, b = (p.groupBy(F.col("status").alias("feature")).agg((F.avg("balance") * k).alias("mean")) for p, k in zip(parts(spark, sf_dir), (1.0, 1.5), strict=True))
    return drift.drift_warnings(a, b, ["mean"])


@query(R + " SELECT f AS feature, round(avg(CASE WHEN NOT is_test THEN v END), 6) AS train, round(avg(CASE WHEN is_test THEN v END), 6) AS test FROM (SELECT is_test, 'amount' AS f, amount AS v FROM r UNION ALL SELECT is_test, 'balance', balance FROM r) GROUP BY f")
def compare_means(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return drift.compare_means(CONT, train=train, test=test)


@query(M + ", p AS (SELECT avg(balance) AS m, stddev_pop(balance) AS s FROM m) SELECT round(m + s * (i * (6.0 / 100) - 3), 6) + 0.0 AS x, round(exp(-0.5 * pow(i * (6.0 / 100) - 3, 2)) / (s * sqrt(2 * pi())), 6) AS density FROM p, range(0, 101) r(i)")
def normal_curve(spark, sf_dir):
    return drift.normal_curve(model(spark, sf_dir), "balance")


@query("SELECT p_partkey AS id, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS names FROM part")
def list_canonicalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), drift.canonical_list(F.col("p_name"), " ").alias("names"))


# events


EVENTS = "WITH e AS (SELECT user_id, event_id, event_type, value, (1706745600000000 - epoch_us(ts)) / 86400000000.0 AS age, (event_type = 'click')::INTEGER AS click FROM events)"


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "event_type", "value", ((F.lit(1706745600000000) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400000000.0).alias("age"), (F.col("event_type") == "click").cast("int").alias("click"))


@query(EVENTS + " SELECT user_id, " + ", ".join(f"round({f}(value) FILTER (click = 1 AND age < {s}), 6) AS value_{n}_by_span_{s}_by_click" for s in (7, 20) for n, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"))) + " FROM e GROUP BY user_id")
def rfm_cont(spark, sf_dir):
    return rfm.cont_features(_events(spark, sf_dir), "user_id", ["click"], ["value"], "age", {"span": [7, 20]})


@query(EVENTS + ", k AS (SELECT *, row_number() OVER (PARTITION BY user_id, click ORDER BY age) AS r FROM e) SELECT user_id, " + ", ".join(f"round({f}(value) FILTER (click = 1 AND r <= {s}), 6) + 0.0 AS value_{n}_by_rank_{s}_by_click" for s in (1, 3) for n, f in (("mean", "avg"), ("max", "max"))) + " FROM k GROUP BY user_id")
def rfm_rank(spark, sf_dir):
    return rfm.cont_features(_events(spark, sf_dir), "user_id", ["click"], ["value"], "age", {"rank": [1, 3]}, ("mean", "max"))


@query(EVENTS + ", g AS (SELECT user_id, event_type AS v, count(*)::DOUBLE AS n, min(age) AS s FROM e GROUP BY ALL), b AS (SELECT user_id, sum(n) AS total, max(n) AS mode, arg_min(n, (s, v)) AS base FROM g GROUP BY user_id) SELECT user_id, base::BIGINT AS event_type_base_count, round(base / total, 6) AS event_type_base_ratio, (mode - base)::BIGINT AS event_type_mode_diff, round((mode - base) / total, 6) AS event_type_mode_ratio_diff FROM b")
def cate_stat(spark, sf_dir):
    return rfm.cate_features(_events(spark, sf_dir), "user_id", "event_type", "age")


@query(EVENTS + ", d AS (SELECT user_id, value - lag(value) OVER w - first_value(value) OVER w AS d, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY age, event_id)) SELECT user_id, round(avg(d), 6) + 0.0 AS value_delta_mean, round(median(d), 6) + 0.0 AS value_delta_median, round(max(d), 6) + 0.0 AS value_delta_max, round(min(d), 6) + 0.0 AS value_delta_min, round(stddev_pop(d), 6) AS value_delta_std FROM d WHERE r > 1 GROUP BY user_id")
def delta_stat(spark, sf_dir):
    return rfm.delta_features(_events(spark, sf_dir), "user_id", "value", "age", "event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 0::INTEGER AS _ERROR_ FROM events")
def json_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return scalars.flatten_json(e, "props", "k int").select("event_id", "k", "_ERROR_")


@query("WITH r AS (SELECT event_id AS id, ts, user_id FROM events WHERE event_type = 'click'), s AS (SELECT event_id AS id, 'm' || (event_id % 2) AS model_id, 't' || (event_id % 3) AS task_id, value AS score FROM events) SELECT r.id, r.user_id, s.score FROM r LEFT JOIN s ON r.id = s.id AND s.model_id = 'm1' AND s.task_id = 't2' WHERE substr(r.ts::VARCHAR, 1, 10) = '2024-01-09'")
def sandbox_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    requests = e.where("event_type = 'click'").select(F.col("event_id").alias("id"), "ts", "user_id")
    scores = e.select(F.col("event_id").alias("id"), F.concat(F.lit("m"), F.col("event_id") % 2).alias("model_id"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("task_id"), F.col("value").alias("score"))
    return io.sandbox(scores, requests, "m1", "t2", "2024-01-09").select("id", "user_id", "score")


@query("WITH v AS (SELECT w, row_number() OVER (ORDER BY w)::INTEGER AS i FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)), t AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS ws FROM part) SELECT id, (SELECT i FROM v WHERE w = ws[1]) AS a, coalesce((SELECT i FROM v WHERE w = ws[2]), 0) AS b, 0::INTEGER AS d FROM t")
def token_numbers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("ws"))
    return scalars.number_tokens(p, "id", "ws", 3).select("id", F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"), F.col("ids")[2].alias("d"))


# models: rows only


def _numbers(spark, sf_dir):
    return model(spark, sf_dir).select("id", "y", "balance", "nation", (F.col("amount") * 0 + F.pmod(F.hash("id", "y"), F.lit(100)) + 20 * F.col("y")).alias("noisy"))


@query(M + ", x AS (SELECT y, 'balance' AS feature, coalesce(balance, -999) AS v FROM m UNION ALL SELECT y, 'nation', nation FROM m UNION ALL SELECT y, 'id', id FROM m), g AS (SELECT feature, y, count(*)::DOUBLE AS n, sum(v) AS s, var_pop(v) AS vp FROM x GROUP BY ALL), f AS (SELECT feature, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))) AS f FROM g GROUP BY feature), k AS (SELECT *, row_number() OVER (ORDER BY f DESC, feature)::INT AS ranking FROM f) SELECT 1 AS step, 'SelectKBest' AS filter, feature, ranking <= 2 AS support, ranking, round(f, 6) AS score FROM k")
def filter_report(spark, sf_dir):
    """One p-value for one F, as all columns have the same degrees of freedom: SQL ranks by F."""
    chosen = select.SelectKBest(k=2).fit(model(spark, sf_dir), "y", ["balance", "nation", "id"])
    return select.features_table(spark, [chosen]).select("step", "filter", "feature", "support", "ranking", "score")


@query()
def select_kbest(spark, sf_dir):
    return spark.createDataFrame([(c, float(f), float(p)) for c, f, p in select.SelectKBest(k=2).fit(_numbers(spark, sf_dir), "y", ["balance", "nation", "noisy"]).report], "feature string, f double, p double")


@query()
def stepwise_columns(spark, sf_dir):
    f = select.LRFilter("stepwise").fit(_numbers(spark, sf_dir), "y", ["balance", "nation", "noisy"])
    return spark.createDataFrame([(c,) for c in f.columns], "feature string")


@query()
def trained_scores(spark, sf_dir):
    from ..operators.models import ModelTrainer

    t = ModelTrainer("LogisticRegression", folds=3).fit(_numbers(spark, sf_dir), "y", "id", ["balance", "nation", "noisy"])
    return t.out_of_fold.select("id", "y_true", "y_pred")


@query()
def covariate_shift(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return drift.detect_covariate_shift(train, test, ["balance", "amount"], "id")[0].select("id", "weight")


@query()
def rule_fit(spark, sf_dir):
    from ..operators.rules import RuleFit

    r = RuleFit().fit(_numbers(spark, sf_dir), "y", ["balance", "nation", "noisy"])
    return r.transform(_numbers(spark, sf_dir)).select("id", "y", "y_pred")


@query()
def ripper_rules(spark, sf_dir):
    from ..operators.rules import Ripper

    r = Ripper().fit(_numbers(spark, sf_dir), "y", ["nation", "noisy"], "id")
    return spark.createDataFrame([(x["rule"], x["pos"], x["neg"]) for x in r.rules], "rule string, pos long, neg long")


@query()
def reduced_columns(spark, sf_dir):
    m = model(spark, sf_dir)
    return encoders.ReduceGen("PCA", 2, columns=["balance", "amount", "nation"]).fit(m).transform(m).select("id", "reduce_0", "reduce_1")


@query()
def binning_woe(spark, sf_dir):
    train, test = parts(spark, sf_dir)
    return binning.BinningWOEEncoder().fit(train, "y", ["balance", "segment", "status"]).transform(test).select("id", "balance_binwoe", "segment_binwoe", "status_binwoe")


def _levels(part: str) -> str:
    return " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {c}::VARCHAR AS level FROM {part}" for c in ("priority", "status", "segment", "nation"))


REPORT = R + f", la AS ({_levels('tr')}), lb AS ({_levels('te')}), a AS ({WOE.format('la')}), b AS ({WOE.format('lb')}), ia AS (SELECT feature, sum(d * woe) AS iv FROM a GROUP BY 1), ib AS (SELECT feature, sum(d * woe) AS iv, row_number() OVER (ORDER BY sum(d * woe) DESC, feature) AS k FROM b GROUP BY 1)"


@query(REPORT + " SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.level, b.level, 'missing') AS level, a.n::BIGINT AS n_train, b.n::BIGINT AS n_test, round(a.rate, 6) AS rate_train, round(b.rate, 6) AS rate_test, round(a.share, 6) AS share_train, round(b.share, 6) AS share_test, round(a.woe, 6) AS woe_train, round(b.woe, 6) AS woe_test, round(ia.iv, 6) AS iv_train, round(ib.iv, 6) AS iv_test, ib.k::INTEGER AS feature_rank, coalesce(a.level, b.level) IS NULL AS level_missing, TRY_CAST(coalesce(a.level, b.level) AS DOUBLE) AS level_number FROM a FULL JOIN b ON a.feature = b.feature AND a.level IS NOT DISTINCT FROM b.level JOIN ia ON ia.feature = coalesce(a.feature, b.feature) JOIN ib ON ib.feature = ia.feature")
def level_report(spark, sf_dir):
    from . import reports

    train, test = (d.withColumn("nation", F.col("nation").cast("string")) for d in parts(spark, sf_dir))
    return reports.level_report(train, test, ["priority", "status", "segment", "nation"], "y").drop("auc_train", "auc_test", "ks_train", "ks_test")


@query(R + ", x AS (SELECT 'balance' AS feature, balance AS v, 0 AS k FROM tr UNION ALL SELECT 'amount', amount, 0 FROM tr UNION ALL SELECT 'balance', balance, 1 FROM te UNION ALL SELECT 'amount', amount, 1 FROM te), s AS (SELECT feature, v, sum(1 - k)::DOUBLE AS a, sum(k)::DOUBLE AS b FROM x WHERE v IS NOT NULL GROUP BY ALL), c AS (SELECT feature, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS d FROM s WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)), d AS (SELECT feature, max(abs(d)) AS ks FROM c GROUP BY 1), n AS (SELECT feature, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE k = 0) AS a, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE k = 1) AS b FROM x GROUP BY 1) SELECT feature, round(ks, 4) AS ks, round(a, 4) AS null_train, round(b, 4) AS null_test FROM d JOIN n USING (feature)")
def consistency_distances(spark, sf_dir):
    return drift.consistency_tests(*parts(spark, sf_dir), ["balance", "amount"]).select("feature", "ks", "null_train", "null_test")
