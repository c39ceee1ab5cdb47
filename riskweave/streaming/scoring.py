"""Fitted encoders on streams, and stability by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import psi


def score_stream(stream: DataFrame, encoders: list) -> DataFrame:
    """Apply fitted encoders to a streaming frame: expressions and joins with small tables."""
    for e in encoders:
        stream = e.transform(stream)
    return stream


def watch_stability(stream: DataFrame, train: DataFrame, columns: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's PSI against train to a Parquet table."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        if batch.limit(1).count():
            psi(train, batch, columns).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(stream: DataFrame, time_col: str, label: str, *keys: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and label rate of each time window and key, with a watermark for late rows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, length), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
