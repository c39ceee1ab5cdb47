"""The mix takes repeated rows, rows without an id and very long documents to its targets."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, w="w"):
    return " ".join([w] * n)


def test_long_documents_are_not_left_out():
    for sizes, counts, target in (([290_000, 40], [1, 3], 300_000), ([300_000, 310_000, 290_000], [1, 1, 1], 305_000), ([400_000, 90_000, 500], [2, 1, 1], 950_000)):
        passes, more = mixing.fit_counts(sizes, counts, target, 2, 7)
        total = sum(s * c for s, c in zip(sizes, counts))
        got = passes * total + sum(s * m for s, m in zip(sizes, more))
        assert got <= target and all(m <= c for m, c in zip(more, counts))
        best = mixing.knapsack(sizes, counts, target - passes * total)
        assert target - got <= max(1000, target - passes * total - sum(s * n for s, n in best.items()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, words(90), "en", "a", 1)] * 6 + [(1, words(40), "en", "a", 1)] + [(2, words(30), "en", "b", 1)] * 5 + [(2, words(30, "v"), "de", "b", 1), (3, words(7), None, None, 1), (4, None, "en", "a", 0), (5, words(30), "en", "b", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_the_stage_takes_what_the_mix_takes(spark, docs):
    mixed = mixing.mix(docs).collect()
    want, target = Counter(), {}
    for r in mixed:
        want[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert len(mixed) == docs.count()
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["source"]] += len((r["text"] or "").split())
    assert abs(sum(got.values()) - sum(want.values())) <= 90 * len(target)
    for s, t in target.items():
        assert t - 90 < got[s] <= t + 1 and t - 90 < want[s] <= t + 1
    rows = lambda d: Counter(tuple(r) for r in d.collect())
    once = rows(docs)
    assert all(n <= 2 * once[k] for k, n in rows(out).items())
    assert rows(out) == rows(corpus_pipeline.mix_sources(spark, docs.repartition(5), ""))


def test_a_much_repeated_row_is_one_class(spark):
    df = spark.createDataFrame([(None, "a b c", "en", "s", 1)], DOCS).crossJoin(spark.range(4000)).drop("id").unionAll(spark.createDataFrame([(i, words(5), "en", f"t{i}", 1) for i in range(3)], DOCS))
    classes = mixing.mix_classes(df)
    assert classes.where("source = 's'").count() == 1
    assert mixing.mix(df).count() == 4003
    taken = corpus_pipeline.mix_sources(spark, df, "").where("source = 's'").count() * 3
    assert abs(taken - classes.where("source = 's'").first()["target"]) <= 3


def test_repeated_rows_come_in_number(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2500), ("d", 1000)], "k string, n long")
    got = mixing.repeated(df, F.col("n"), "i").groupBy("k").agg(F.count("i").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()
    assert {tuple(r) for r in got} == {("b", 1, 1, 1), ("c", 2500, 1, 2500), ("d", 1000, 1, 1000)}
