"""The time-bucket count of event bundles as a stream: the same aggregation, closed by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bundles(events: DataFrame, keys: Sequence[str], at: str, minutes: int = 2, minimum: int = 3,
                   late: str = "10 minutes") -> DataFrame:
    """(keys, bucket start, size) of buckets with at least ``minimum`` events, for batch or streaming input."""
    width = F.window(F.col(at), f"{minutes} minutes")
    sized = events.withWatermark(at, late).groupBy(*keys, width.alias("w")).agg(F.count(F.lit(1)).alias("bundle_size"))
    return sized.where(F.col("bundle_size") >= minimum).select(*keys, F.col("w.start").alias("bucket_start"), "bundle_size")
