"""The stateless read filters on streams, and depth in event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MASK = 3844  # fixed value: unmapped, secondary, failed, duplicate, supplementary


def filter_reads(reads: DataFrame, mask: int = DEFAULT_MASK, least_mapq: int = 0, longest: int | None = None) -> DataFrame:
    """RD-01, RD-02, RD-04: works alike on a stream and on a table."""
    kept: Column = (F.col("flag").bitwiseAND(F.lit(mask)) == 0) & (F.col("mapq") >= least_mapq)
    if longest is not None:
        kept &= F.col("end_") - F.col("start_") + 1 <= longest
    return reads.filter(kept)


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window and columns; rows later than the watermark are left out of closed windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")
