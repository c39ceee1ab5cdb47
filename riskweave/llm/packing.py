"""Packing documents into sequences: concatenate and cut.

Two passes. The first tokenises every document once and writes ids with running offsets inside
each task's partition. The sums of the partitions, one small row for each, are added up to give
each document its offset in the concatenation. The second pass cuts at multiples of the sequence
length; a document that crosses a multiple yields a boundary record for each sequence it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise
from .tokens import tokenise

#: Partition sums are broadcast up to this many partitions (16 bytes each); beyond it they are joined.
MAX_BROADCAST_PARTS = 1_000_000


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all rows before, from ``part``, ``local_start`` and ``n_tokens``."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    if len(tokens.inputFiles()) <= MAX_BROADCAST_PARTS:
        before = F.broadcast(before)  # a row for each task that wrote: bounded by the check above
    return tokens.join(before, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents with their ids, filling sequences of ``seq_len`` without a gap.

    Returns ``<id>, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian
    uint32)``; ``start`` counts the document's ids before the piece. Only the last sequence is
    shorter than ``seq_len``. A null or empty text is the single id ``end_id``; a null id stays
    null; repeated rows are packed once each; a text of any length is packed whole, over as many
    sequences as it fills; an empty table gives no piece; further columns are ignored.
    """
    if seq_len < 1:
        raise ValueError("seq_len must be positive")
    tokens = materialise(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "packing-tokens")
    first = F.floor(F.col("start") / seq_len)
    last = F.floor((F.col("start") + F.col("n_tokens") - 1) / seq_len)

    def piece(seq):
        begin = F.greatest(F.col("start"), seq * seq_len)
        end = F.least(F.col("start") + F.col("n_tokens"), (seq + 1) * seq_len)
        at = (begin - F.col("start")).cast("long")
        return F.struct(
            at.alias("start"),
            (end - begin).cast("long").alias("length"),
            seq.cast("long").alias("sequence_id"),
            (begin - seq * seq_len).cast("long").alias("offset"),
            F.substring("ids", (at * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
        )

    pieces = with_starts(tokens).select(id_col, F.col("n_tokens").alias("doc_tokens"), F.inline(F.transform(F.sequence(first, last), piece)))
    return pieces.select(id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
