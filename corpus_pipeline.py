"""From raw documents to packed sequences: five stages, each calling one operator on all that its
predecessor kept. The first four return the columns of documents, as they came: columns that
operators add have names that the documents do not use. An empty table goes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import jaccard, langid, mixing, packing, rules
from riskweave.llm.common import drop_shared, materialise
from riskweave.llm.queries import vocabulary

#: A document whose most probable language is less sure than this is rejected.
LEAST_SURE = 0.5


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) or without a sure language. Rows are
    judged one by one, repeated ones alike; a null id or null language is no reason to go. Where no
    text has a language to learn from, every text with a letter stays."""
    model = langid.train(docs.where(~langid.held_out() & F.col("doc_id").isNotNull()), vocabulary("piece_bpe_32k.model"))
    lang, score = _unused(docs, "lang_pred", "score")
    found = langid.identify(docs, model, lang_name=lang, score_name=score)
    sure = (F.col(lang) != "und") & (F.col(score) >= LEAST_SURE) if model.languages else F.col("text").rlike(r"\p{L}")
    return found.where(sure).select(docs.columns)


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or come from a refused host. Null and empty texts
    fail; a null source is a host. Rows of one id, or of no id, are judged each by its own text."""
    key, host, text = _unused(docs, "kept_id", "kept_host", "text_hash")
    hashed = docs.withColumn(text, F.xxhash64("text"))
    kept = rules.judge(hashed, carry=[text]).where("kept").select(F.col("doc_id").alias(key), F.col("source").alias(host), text).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(host)) & (F.xxhash64("text") == F.col(text))
    return docs.join(kept, same, "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (sets of five-word shingles, 0.8). Of
    several rows of that id the one with the smallest hash of all its columns stays; rows without
    an id stay, as links cannot name them. A text without words is no copy of another."""
    groups = jaccard.link(docs, width=5, num=80, den=100)
    first = groups.where("doc_id = component_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    if first.groupBy("doc_id").count().where("count > 1").limit(1).count():
        hashed, least = _unused(docs, "row_hash", "least_hash")
        rows = kept.withColumn(hashed, F.xxhash64(*docs.columns))
        least_of = rows.groupBy("doc_id").agg(F.min(hashed).alias(least))
        kept = rows.join(least_of, "doc_id").where(F.col(hashed) == F.col(least)).dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.unionAll(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; one that it does not take goes. Rows alike
    in all columns are one class: if it is taken unevenly, its first row stands for all of them, as
    often as they are taken together. Null texts, ids and sources are values like others."""
    row, key, times, rows, copy = _unused(docs, "row_hash", "mix_row", "times", "mix_rows", "copy")
    hashed = docs.withColumn(row, F.xxhash64(*docs.columns))
    total = F.col("rows") * F.col("passes") + F.col("extra")
    even = (F.col("extra") == 0) | (F.col("extra") == F.col("rows"))
    classes = mixing.mix_classes(hashed, carry=F.col(row)).select(F.col("carry").alias(key), F.when(even, total / F.col("rows")).otherwise(total).cast("long").alias(times), even.alias(rows)).where(F.col(times) > 0)
    classes = materialise(classes, "pipeline-mix")
    taken = hashed.join(classes.where(rows), F.col(row) == F.col(key))
    uneven = hashed.join(classes.where(~F.col(rows)), F.col(row) == F.col(key)).dropDuplicates([row])
    return mixing.repeated(taken.unionAll(uneven), F.col(times), copy).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids. Every row is packed, null
    and empty texts as a single end; copies follow as rows of their own."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), seq_len=2048, end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", check_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Neither language models nor subset sums nor tokenizers can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder, read again by the next
    and deleted once that is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = materialise(made, f"pipeline-{i}")
        drop_shared(docs)  # packing has written its tokens before it returns
        docs = made
    return docs
