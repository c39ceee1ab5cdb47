"""A worker's tokenizer does not hold a task's words through the steps that follow."""

from pyspark.sql import functions as F

from riskweave.llm import tokens
from riskweave.llm.queries import vocabulary


def _held(spark, path, texts):
    """Tokens of each text, and the words that the worker holds after that task."""
    made = tokens.tokenise(texts, path, 1).orderBy("doc_id").collect()

    def run(batches):
        import pyarrow as pa

        tok = tokens.tokenizer(path)
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tok.known)]), pa.array([len(tok.cores)])], ["known", "cores"])

    return made, spark.range(1, numPartitions=1).mapInArrow(run, "known long, cores long").first()


def test_words_of_an_ended_task_are_given_back(spark):
    path = vocabulary("byte_bpe_50k.json")
    letters = F.translate(F.hex(F.xxhash64("id")), "0123456789", "ghijklmnop")
    many = spark.range(0, 240_000, numPartitions=1).select((F.col("id") % 240).alias("doc_id"), letters.alias("w")).groupBy("doc_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("w"))).alias("text")).coalesce(1)
    made, held = _held(spark, path, many)
    assert len(made) == 240 and min(r["n_tokens"] for r in made) > 1000
    assert held["known"] <= tokens.KEPT_WORDS and held["cores"] <= tokens.KEPT_CORES
    again, _ = _held(spark, path, many)
    assert [r["ids"] for r in again] == [r["ids"] for r in made]
    few = spark.createDataFrame([(1, "some few words that stay")], "doc_id long, text string").coalesce(1)
    assert _held(spark, path, few)[1]["cores"] > 0
