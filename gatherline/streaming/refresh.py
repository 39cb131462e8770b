"""Bucket tables kept by a refresh policy.

A refresh runs at every whole minute and takes what has been received by then. It sets the buckets
that lie between ten minutes and one minute before it, as a whole; the newest minute is not
told yet, and a bucket does not change any more once it is older. What a bucket holds follows from when
its readings were received, so that it is the same for any micro-batches: a reading counts if it was received before
the last refresh of its bucket, and is late otherwise.

A micro-batch stands for all refreshes up to its newest receipt. It rewrites the hours of the table
that its readings touch, or that were still open, and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators.rollup import MINUTE
from ..sources.tables import Snapshots, append_batch, read_table
from .delivery import RECEIVED

# A refresh reaches back to the first and up to the second before it.
START_OFFSET, END_OFFSET = "10 minutes", "1 minute"


def _hour(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHH")


class RefreshedBuckets:
    """Buckets (of :func:`~gatherline.operators.rollup.crowd_buckets` or ``queue_buckets``) of a stream of readings with ``received``.

    Under ``root``: ``timely`` (readings that count, by batch and hour), ``late`` (the others, by batch), ``buckets``
    (by hour). A batch that is tried again writes the same. State between batches: the time of the last refresh and
    the hours that were open then.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        buckets: Callable[[DataFrame, str], DataFrame],
        start_offset: str = START_OFFSET,
        end_offset: str = END_OFFSET,
        width: str = MINUTE,
    ):
        self.spark, self.root, self.buckets, self.width = spark, root, buckets, width
        self.start_offset, self.end_offset = (F.expr(f"INTERVAL '{o}'") for o in (start_offset, end_offset))
        self.schema: StructType | None = None  # of the table, once a batch has run
        self.refreshes = Snapshots(spark, f"{root}/refreshes", "refreshed_at timestamp, hour string")

    def start(self, readings: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return (
            readings.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/_checkpoint/refresh")
            .trigger(**(trigger or {"processingTime": MINUTE}))
            .start()
        )

    def process(self, readings: DataFrame, n: int) -> None:
        rows = readings.withColumn("bucket", F.window("time", self.width)["start"]).persist()
        try:
            self._process(rows, n)
        finally:
            rows.unpersist()

    def _process(self, rows: DataFrame, n: int) -> None:
        # The last refresh of a bucket is the last whole minute that still reaches back to its start.
        in_time = F.col(RECEIVED) <= F.date_trunc("minute", F.col("bucket") + self.start_offset)
        timely = rows.where(in_time).withColumn("hour", _hour(F.col("bucket")))
        timely.write.mode("overwrite").partitionBy("hour").parquet(f"{self.root}/timely/batch={n}")
        append_batch(rows.where(~F.coalesce(in_time, F.lit(False))).drop("bucket"), f"{self.root}/late", n)

        before = self.refreshes.read(n - 1)
        newest = rows.agg(F.max(RECEIVED).alias("t")).unionByName(before.agg(F.max("refreshed_at").alias("t")))
        now = newest.agg(F.date_trunc("minute", F.max("t")).alias("t")).first()["t"]
        if now is None:
            self.refreshes.write(before, n)
            return
        now = F.lit(now)
        hours = timely.select("hour").unionByName(before.where("hour IS NOT NULL").select("hour")).distinct()
        # Partitions of other hours are pruned: the hours of a batch are few.
        known = self._timely(timely.schema.add("batch", IntegerType())).join(F.broadcast(hours), "hour").persist()
        told = self.buckets(known.where(F.col(RECEIVED) <= now), self.width)
        self.schema = told.schema.add("hour", StringType())
        ended = F.col("bucket") + F.expr(f"INTERVAL '{self.width}'") <= now - self.end_offset
        (
            told.where(ended)
            .withColumn("hour", _hour(F.col("bucket")))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("hour")
            .parquet(f"{self.root}/buckets")
        )
        open_hours = known.where(~ended | (F.col(RECEIVED) > now)).select("hour").distinct()
        # One row at least, for the time of the refresh.
        state = open_hours.select(now.alias("refreshed_at"), "hour").unionByName(
            self.spark.range(1).select(now.alias("refreshed_at"), F.lit(None).cast("string").alias("hour"))
        )
        self.refreshes.write(state, n)
        known.unpersist()

    def _timely(self, schema: StructType) -> DataFrame:
        """Timely readings of all batches; the schema is given, as a batch may have none."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/timely").drop("batch")

    def table(self) -> DataFrame:
        """The buckets told so far."""
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.root}/buckets").drop("hour")

    def late(self) -> DataFrame:
        return read_table(self.spark, f"{self.root}/late").drop("date")
