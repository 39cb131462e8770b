"""Order stream: check, price, estimate, publish and store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import stand_key
from ..operators.orders import STATE_AT_ORDER, checked, decided, latest_order_zone, place_orders
from ..operators.routes import density_maps
from ..operators.wait import default_forecast
from ..sources import messages, venue
from ..sources.tables import append_batch
from .keyed import keyed_store, last_before


class OrderStream:
    """Order requests to ``fan_orders``, ``rejected`` and ``messages`` under ``root``.

    ``forecasts`` and ``snapshots`` give the current wait forecasts and zone
    densities (functions, because these tables grow while the stream runs).
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        forecasts: Callable[[], DataFrame],
        snapshots: Callable[[], DataFrame],
        tick: str,
        orders: Callable[[], DataFrame] | None = None,
    ):
        self.spark, self.root, self.tick = spark, root, tick
        self.forecasts, self.snapshots, self.orders = forecasts, snapshots, orders

    def start(self, stream: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/_checkpoint/orders")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def process(self, requests: DataFrame, n: int) -> None:
        accepted, rejected = place_orders(
            requests,
            self.forecasts(),
            default_forecast(venue.stands(self.spark)),
            self.snapshots(),
            self.tick,
            self.orders() if self.orders else None,
        )
        _write(accepted, rejected, self.root, n)


def _write(accepted: DataFrame, rejected: DataFrame, root: str, n: int) -> None:
    accepted = accepted.persist()
    append_batch(accepted, f"{root}/fan_orders", n, "placed_at")
    messages.orders_as_messages(accepted.drop("tie")).write.mode("overwrite").json(f"{root}/messages/batch={n}")
    rejected.withColumn("reason", F.array_join("reasons", "; ")).drop("reasons").write.mode("overwrite").json(
        f"{root}/rejected/batch={n}"
    )
    accepted.unpersist()


class JoinedOrderStream:
    """Order messages joined with a stream of wait forecasts, to ``fan_orders``, ``rejected`` and ``messages`` under ``root``.

    An order waits in the state store until the ``tick`` in which it was placed is over, and gets the last forecast
    of its stand before it. A batch reads the densities of its own ticks only. ``densities``: the table (bucket, zone,
    avg_density) that a bucket stream of the same tick writes; ``zones``: (seat_id, ordered_zone) of orders stored
    before, as :func:`~gatherline.operators.orders.latest_order_zone` gives it. Messages that cannot be read are
    rejected with the others, without waiting.
    """

    FIELDS = ["seat_id", "stand_id", "items", "special_instructions", "value", "reasons"]

    def __init__(self, spark: SparkSession, root: str, densities: str, tick: str, zones: DataFrame | None = None, lateness: str = "10 minutes"):
        self.spark, self.root, self.tick, self.lateness = spark, root, tick, lateness
        self.densities, self.zones = densities, zones

    def start(self, orders: DataFrame, forecasts: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """``orders``: a stream of (value, tie) messages; ``forecasts``: one of forecasts with is_open."""
        asked = messages.parse_orders(orders).withColumn("stand_key", F.coalesce(stand_key(F.col("stand_id")), F.lit("")))
        told = last_before(
            # Without a time there is nothing to wait for.
            asked.withColumn("placed_at", F.coalesce("placed_at", F.timestamp_seconds(F.lit(0)))),
            forecasts.withColumn("stand_key", F.col("stand_id")),
            "stand_key",
            "placed_at",
            F.window("placed_at", self.tick)["end"],
            self.FIELDS,
            STATE_AT_ORDER,
            self.lateness,
        )
        with keyed_store(self.spark):
            return (
                told.writeStream.foreachBatch(self.process)
                .option("checkpointLocation", f"{self.root}/_checkpoint/orders")
                .trigger(**(trigger or {"availableNow": True}))
                .start()
            )

    def process(self, told: DataFrame, n: int) -> None:
        told = told.drop("stand_key").persist()
        try:
            ticks = told.select(F.window("placed_at", self.tick)["start"].alias("t")).agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
            unread = told.where(F.size("reasons") > 0)
            rows = checked(told.where(F.size("reasons") == 0).drop("reasons", "value"))
            faulty = rows.where(F.size("reasons") > 0).select("placed_at", "tie", "seat_id", "stand_id", "reasons")
            accepted, rejected = decided(
                faulty.unionByName(unread.select(*faulty.columns)),
                rows.where(F.size("reasons") == 0),
                default_forecast(venue.stands(self.spark)),
                self._snapshots(ticks["low"], ticks["high"]),
                self.tick,
                known_zones=self.zones,
            )
            _write(accepted, rejected, self.root, n)
        finally:
            told.unpersist()

    def _snapshots(self, low, high) -> DataFrame:
        """Densities of the ticks from ``low`` to ``high``; the bounds reach the scan."""
        rows = self.spark.read.parquet(self.densities).where(F.col("bucket").between(F.lit(low), F.lit(high)))
        return density_maps(rows.select(F.col("bucket").alias("snapshot"), "zone", F.col("avg_density").alias("density")), ["snapshot"])


def known_zones(orders: DataFrame, path: str) -> DataFrame:
    """The zone of every seat's latest stored order, written to ``path`` once and read from there."""
    latest_order_zone(orders).write.mode("overwrite").parquet(path)
    return orders.sparkSession.read.parquet(path)
