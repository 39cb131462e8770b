"""Bucket aggregates of a readings stream, with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rollup import MINUTE, crowd_buckets, queue_buckets

# Fixed value: buckets older than this are not refreshed.
LATENESS = "10 minutes"


def crowd_bucket_stream(readings: DataFrame, width: str = MINUTE, lateness: str = LATENESS) -> DataFrame:
    """Buckets per zone; a bucket is emitted once, when the watermark has passed it.

    Readings later than ``lateness`` no longer change a bucket; the raw table keeps
    them all the same. Aggregation state is one row per open bucket and zone.
    """
    return crowd_buckets(readings.withWatermark("time", lateness), width)


def queue_bucket_stream(readings: DataFrame, width: str = MINUTE, lateness: str = LATENESS) -> DataFrame:
    return queue_buckets(readings.withWatermark("time", lateness), width)


def start(buckets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append closed buckets to a Parquet table, every minute unless told otherwise."""
    return (
        buckets.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": MINUTE}))
        .start()
    )
