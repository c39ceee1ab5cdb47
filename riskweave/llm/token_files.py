"""Token ids in ORC files, in ascending order of document id.

ORC keeps each column of a stripe with integer run-length encoding, a row index for every
``row_index_stride`` rows and a Bloom filter on the document id, so a reader takes whole stripes
in parallel, skips those whose ranges or filters exclude an id, and reads only the columns asked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import with_starts
from .tokens import tokenise


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 16 << 20, row_index_stride: int = 1000) -> None:
    """Write ``part, local_start, <id>, n_tokens, ids array<int>`` as ORC, ids ascending.

    Rows are dealt out by range of the id and sorted, so the file of part ``i`` precedes that of
    ``i+1``. A null or empty text is the single id ``end_id``; null ids come first; repeated ids
    keep one row each, next to each other in an order that is fixed by the file. A text of any
    length is one row; an empty table gives files without rows; further columns are not written.
    """
    ranged = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first())
    (
        tokenise(ranged, tokenizer_path, end_id, id_col, text_col, as_array=True)
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", row_index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.compress", "SNAPPY")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``<id>, start, n_tokens, ids array<int>`` of what `write_tokens` wrote.

    Filters on the id reach the stripes' statistics and Bloom filters. ``start`` comes from the
    running counts in the rows and one sum for each file, which reads two columns.
    """
    return with_starts(spark.read.orc(path)).select(id_col, "start", "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """The token rows of a few documents, skipping stripes by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col(id_col).isin(ids)).select(id_col, "n_tokens", "ids")


def digest(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id>, start, n_tokens, ids_crc32``: the count and the CRC of the ids that were read."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids = b.column(2)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return tokens.select(id_col, "start", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
