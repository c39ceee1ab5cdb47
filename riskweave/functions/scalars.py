"""Column expressions: scores, smoothing, JSON, texts and lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Scale and bounds of the score, and texts that stand for a missing value.
SCORE_A, SCORE_B, SCORE_LOW, SCORE_HIGH, NEW_A = 473.48, 72.14, 350.0, 950.0, 423.82
NULL_WORDS = ("none", "null", "nan")


def prob_to_score(p: Column, a: float = SCORE_A, b: float = SCORE_B) -> Column:
    """``a - b ln(p / (1 - p))`` within the score's bounds, at 4 decimals."""
    s = F.lit(a) - F.lit(b) * F.log(F.try_divide(p, 1 - p))
    s = F.when(p <= 0, SCORE_HIGH).when(p >= 1, SCORE_LOW).otherwise(s)
    return F.round(F.greatest(F.lit(SCORE_LOW), F.least(F.lit(SCORE_HIGH), s)), 4)


def new_offset(df: DataFrame, label: str, real_odds: float) -> DataFrame:
    """``a``: the score's offset for the real odds and the data set's label rate."""
    m = F.avg(F.col(label).cast("double"))
    return df.agg((F.lit(NEW_A - SCORE_B * math.log(real_odds)) + SCORE_B * F.log(m / (1 - m))).alias("a"))


def relative_difference(train: Column, test: Column, smooth: float = 0.01) -> Column:
    return 1 - (test + smooth) / (train + smooth)


def round3(x: Column) -> Column:
    return F.round(x, 3)


def clean_null_words(x: Column) -> Column:
    """Null for the words that stand for a missing value, whatever their case."""
    return F.when(~F.lower(F.trim(x)).isin(*NULL_WORDS), x)


def date_prefix(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, 10)


def age_in_years(birth: Column, at: Column) -> Column:
    return F.floor(F.datediff(at, birth) / 365.25)


def pad_tokens(tokens: Column, vocabulary: Column, length: int) -> Column:
    """Numbers of the tokens (0 if unknown), cut or padded with 0 at the end."""
    ids = F.transform(tokens, lambda t: F.coalesce(F.element_at(vocabulary, t), F.lit(0)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def number_tokens(df: DataFrame, id_col: str, tokens_col: str, length: int) -> DataFrame:
    """``<id>, ids``: ranks (from 1) of the first ``length`` tokens among all distinct tokens of the
    column, padded with 0; a null list gives zeros. Ids are unique. Tokens are ranked in ranges of
    their first two letters and met by a join, so neither driver nor task holds the vocabulary."""
    words = df.select(F.explode(tokens_col).alias("w")).where("w is not null").distinct().withColumn("p", F.substring("w", 1, 2))
    ahead = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)  # a row for each two letters
    before = words.groupBy("p").agg(F.count(F.lit(1)).alias("c")).select("p", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("p").orderBy("w"))
    numbers = words.withColumn("r", rank).join(before, "p").select("w", (F.col("r") + F.col("before")).cast("int").alias("number"))
    first = df.select(id_col, F.posexplode_outer(F.slice(tokens_col, 1, length)).alias("k", "w")).join(numbers, "w", "left")
    lists = first.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("k", "number")))).alias("n"))
    return lists.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.element_at("n", i), F.lit(0))).alias("ids"))


def one_hot_label(label: Column, classes: int) -> Column:
    return F.array(*[(label == i).cast("int") for i in range(classes)])


def flatten_struct(df: DataFrame, column: str, separator: str = "_") -> DataFrame:
    """Fields of a nested struct as columns with the joined path as name; arrays stay whole."""

    def leaves(path: list[str], kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from leaves([*path, f.name], f.dataType)
        else:
            yield path

    paths = list(leaves([column], df.schema[column].dataType))
    return df.select(*[c for c in df.columns if c != column], *[F.col(".".join(f"`{x}`" for x in p)).alias(separator.join(p[1:])) for p in paths])


def flatten_json(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """A JSON text with a known schema as flat columns; ``_ERROR_`` is 1 where it cannot be parsed.

    Doubled backslashes are taken as single ones.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = F.replace(F.col(column), F.lit("\\\\"), F.lit("\\"))
    parsed = df.withColumn("__j", F.from_json(text, kind)).withColumn("_ERROR_", (F.col(column).isNotNull() & F.try_parse_json(text).isNull()).cast("int"))
    return flatten_struct(parsed.drop(column), "__j")


def flatten_variant(column: Column, depth: int = 4) -> Column:
    """A JSON text of unknown schema as a map from path joined by ``_`` to text; lists stay whole, and
    so do objects nested more than ``depth`` deep, as JSON text: nothing is lost."""
    text = F.replace(column, F.lit("\\\\"), F.lit("\\"))
    as_map = lambda x: F.from_json(x, "map<string,string>")
    out = F.map_entries(as_map(text))
    for _ in range(depth):
        def open_one(e):
            inner = F.when(e["value"].startswith("{"), as_map(e["value"]))
            return F.when(inner.isNotNull(), F.transform(F.map_entries(inner), lambda i: F.struct(F.concat(e["key"], F.lit("_"), i["key"]).alias("key"), i["value"].alias("value")))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))
        out = F.flatten(F.transform(out, open_one))
    bad = F.create_map(F.lit("_ERROR_"), F.lit("1"))
    return F.when(column.isNull(), F.lit(None)).when(F.try_parse_json(text).isNull(), bad).otherwise(F.map_from_entries(out))
