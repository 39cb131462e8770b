"""Append tables partitioned by date, and small versioned snapshot tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uuid_from
from ..functions.times import at


def _by_date(df: DataFrame, time: str) -> DataFrame:
    """Rows of a date together, so that a task writes few files; the rebalancing
    shuffle splits a date that is too large for one task."""
    return df.withColumn("date", F.to_date(time)).hint("rebalance", "date")


def append(df: DataFrame, path: str, time: str = "time") -> None:
    """Append rows to a table partitioned by the date of ``time``."""
    _by_date(df, time).write.mode("append").partitionBy("date").parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int, time: str = "time") -> None:
    """Append a micro-batch; a retried batch replaces what it wrote before."""
    (
        _by_date(df, time)
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(f"{path}/batch={batch_id}")
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop(*[c for c in ("batch",) if c in df.columns])


def between(df: DataFrame, start: datetime, end: datetime, time: str = "time") -> DataFrame:
    """Rows with start < time <= end; the date bound prunes partitions."""
    rows = df.where((F.col(time) > at(start)) & (F.col(time) <= at(end)))
    if "date" in df.columns:
        rows = rows.where(F.col("date").between(_day(start), _day(end)))
    return rows


def _day(at: datetime) -> Column:
    return F.lit(date(at.year, at.month, at.day))


def with_alert_defaults(alerts: DataFrame, *source_key: str) -> DataFrame:
    """Id, time and resolved flag of new alerts.

    The id is a hash of the alert's source, so a replayed batch writes the same
    alerts again instead of new ones.
    """
    return alerts.select(
        "time",
        uuid_from(*[F.col(c) for c in (source_key or ("time", "category", "message"))]).alias("alert_id"),
        "severity",
        "category",
        "zone",
        "stand_id",
        "message",
        F.lit(False).alias("resolved"),
    )


class Snapshots:
    """A small keyed table kept as one complete Parquet folder per version.

    Version n is written from version n-1 only, so writing it again after a
    failure gives the same result; readers never see a half-written version
    because Spark commits a folder as a whole. Two versions back are enough to
    repeat a failed batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={version}")

    def write(self, df: DataFrame, version: int) -> None:
        # A shuffle of the few rows: coalesce(1) would run the plan's last stage, of all partitions, in one task.
        df.repartition(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
