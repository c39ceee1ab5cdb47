"""Quality rules at host level, in DataFrame functions only.

Every document is measured and judged by a few rules. Failures are added up for each host (here
the source), each host's failure rates are shrunk towards those of all hosts with a beta prior
fitted to the hosts by moments, and the verdict on the host goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, words_col

#: The signs counted as symbols.
SYMBOLS = "#*$%&|<>"


def _let(value, body):
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words):
    """Words lying in 3-word windows that occur twice or more in the text."""
    n = F.size(words)

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(hashes):
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(e):
            m = F.size(e)
            same = F.filter(e, lambda x, k: F.coalesce((k > 0) & (F.get(e, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((k + 1 < m) & (F.get(e, k + 1)["h"] == x["h"]), F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        return _let(by_hash, lambda e: F.aggregate(again(e), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"]))

    counted = _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 4, F.lit(0)).otherwise(counted).cast("long")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of whole texts.

    Null and empty texts have zeros. Windows are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    words = _let(words_col(F.col(text_col)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again")))  # split once
    return docs.withColumn("__words", words).withColumns(
        {
            "n_words": F.col("__words")["n"],
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col("__words")["again"],
        }
    ).drop("__words")


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, F.Column]:
    """Rule name to the condition under which a document fails it."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
    }


def host_verdicts(measured: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row for each host: ``docs``, shrunk failure rates and ``host_ok``.

    For each rule a beta prior is fitted by moments to the hosts' rates (hosts weigh alike); a
    host with few documents lies near the prior's mean, one with many near its own rate. A host
    is refused when a shrunk rate is above ``max_rate``. Where hosts do not vary, the prior is
    worth all documents of an average host. Null is a host like any other.
    """
    names = list(rules())
    hosts = measured.groupBy(host_col).agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.when(c, 1).otherwise(0)).alias(f"f_{k}") for k, c in rules().items()])
    moments = hosts.agg(F.avg("docs").alias("m_docs"), *[f(F.col(f"f_{k}") / F.col("docs")).alias(f"{a}_{k}") for k in names for a, f in (("mu", F.avg), ("var", F.var_pop))])
    joined = hosts.join(F.broadcast(moments))  # one row
    rate = {}
    for k in names:
        mu, var = F.col(f"mu_{k}"), F.col(f"var_{k}")
        weight = F.when((var > 0) & (mu * (1 - mu) > var), F.least(mu * (1 - mu) / var - 1, F.lit(1e6))).otherwise(F.when(var > 0, F.lit(1.0)).otherwise(F.col("m_docs")))
        rate[k] = (F.col(f"f_{k}") + weight * mu) / (F.col("docs") + weight)
    return joined.select(host_col, "docs", *[r.alias(f"rate_{k}") for k, r in rate.items()], (F.greatest(*rate.values()) <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, carry: list[str] | tuple = ()) -> DataFrame:
    """One row for each document: ``carry`` columns, measures, ``base_failed``, its host's ``host_ok`` and ``kept``.

    ``kept`` is false for documents that fail the base rules and for those of refused hosts.
    The measures are written once to the shared folder; only these narrow rows meet the hosts'
    verdicts, and hosts, however many, are joined by key, where Spark splits a hot one.
    Empty tables give no row; repeated rows are judged once each; other columns are ignored.
    Null texts have no words and fail; texts of any length are measured whole.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), *carry)
    m = materialise(measure(named).drop("text"), "rules")
    v = host_verdicts(m, "host", max_rate)
    out = m.alias("m").join(v.select(F.col("host").alias("v_host"), "host_ok", *[f"rate_{k}" for k in rules()]), F.col("m.host").eqNullSafe(F.col("v_host")), "left").drop("v_host")
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True)))
    return out.withColumnsRenamed({"doc_id": id_col, "host": host_col})
