"""An extension: quality figures of an unbounded stream of reads, by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import gc_count, mean_quality


def windowed_quality(reads: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """reads: ts, sequence, quality. start, n, bases, gc, mean_quality_sum for each window. Works on batches and on streams alike."""
    df = reads.withWatermark("ts", late) if reads.isStreaming else reads
    grouped = df.groupBy(F.window("ts", window).alias("w"))
    sums = grouped.agg(
        F.count("*").alias("n"), F.sum(F.length("sequence")).cast("long").alias("bases"),
        F.sum(gc_count(F.col("sequence"))).cast("long").alias("gc"), F.sum(mean_quality(F.col("quality"))).cast("long").alias("mean_quality_sum"),
    )
    return sums.select(F.col("w.start").alias("start"), "n", "bases", "gc", "mean_quality_sum")
