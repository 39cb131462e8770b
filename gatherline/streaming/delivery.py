"""Messages that come twice, and messages that never come.

A consumer that commits its offsets now and then may be handed messages again, or lose
some. Three means work together:

* :func:`once` leaves one copy of a message inside a micro-batch;
* :class:`Ledger` keeps, per batch, the next offset of every source partition, drops what
  an earlier batch has taken, and lists the offsets that were passed over. It holds a row per
  source partition, whatever the number of messages, and forgets nothing;
* :func:`once_within` does the same for sources without offsets: message ids wait in the
  state store until the watermark of the time of receipt has passed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.messages import OFFSET_BITS
from ..sources.tables import Snapshots

RECEIVED = "received"


def once(messages: DataFrame, key: str = "tie") -> DataFrame:
    """One of the copies of every message of a batch; messages without a key all stay."""
    # One pass: a message without a key gets one. Shuffled before copies are looked for, so that rows are sorted once.
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return messages.withColumn("_alone", alone).repartition(key, "_alone").dropDuplicates([key, "_alone"]).drop("_alone")


def once_within(stream: DataFrame, within: str, keys: tuple[str, ...] = ("tie",), received: str = RECEIVED) -> DataFrame:
    """The first of the copies of a message that arrive within ``within`` of each other.

    ``received``: the time at which the source got the message, the same for its copies. Messages that
    are older than the watermark of that time are dropped; the time of a reading plays no part,
    so that late readings stay. State is kept for ``within`` only.
    """
    return stream.withWatermark(received, within).dropDuplicatesWithinWatermark(list(keys))


def _partition() -> Column:
    return F.shiftright("tie", OFFSET_BITS).cast("int")


def _offset() -> Column:
    return F.col("tie").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


class Ledger:
    """The offsets of every source partition that batches have taken, under ``path``.

    Batch n reads version n-1 and writes version n, so that a batch that is tried again
    takes the same messages again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.taken = Snapshots(spark, f"{path}/offsets", "partition int, next_offset long")

    def admit(self, messages: DataFrame, n: int) -> DataFrame:
        """Messages at offsets that no batch before ``n`` has passed. A row per partition is broadcast."""
        before = self.taken.read(n - 1).select(F.col("partition").alias("_p"), F.col("next_offset").alias("_next"))
        known = messages.join(F.broadcast(before), _partition() == F.col("_p"), "left")
        fresh = F.col("tie").isNull() | F.col("_next").isNull() | (_offset() >= F.col("_next"))
        return known.where(fresh).drop("_p", "_next")

    def record(self, admitted: DataFrame, n: int) -> None:
        """What batch ``n`` took of each partition, and where the next one has to go on."""
        before = self.taken.read(n - 1)
        got = (
            admitted.where(F.col("tie").isNotNull())
            .groupBy(_partition().alias("partition"))
            .agg(F.min(_offset()).alias("first_offset"), F.max(_offset()).alias("last_offset"), F.count("*").alias("taken"))
        )
        both = got.join(before, "partition", "full_outer").persist()
        try:
            expected = F.coalesce("next_offset", "first_offset")
            both.where("taken IS NOT NULL").select(
                F.lit(n).alias("batch_id"),
                "partition",
                expected.alias("expected_offset"),
                "first_offset",
                "last_offset",
                "taken",
                (F.col("last_offset") + 1 - expected - F.col("taken")).alias("missing"),
            ).repartition(1).write.mode("overwrite").parquet(f"{self.path}/deliveries/batch={n}")
            self.taken.write(both.select("partition", F.coalesce(F.col("last_offset") + 1, "next_offset").alias("next_offset")), n)
        finally:
            both.unpersist()

    def deliveries(self) -> DataFrame:
        """(batch_id, partition, expected_offset, first_offset, last_offset, taken, missing) of all batches.

        ``missing`` offsets were passed over: lost messages, or ones that the source never shows.
        A partition's first batch expects what it got first.
        """
        return self.spark.read.parquet(f"{self.path}/deliveries").drop("batch")
