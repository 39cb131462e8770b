"""Readings, order requests and stored orders derived from the sample tables.

``events`` stands in for sensors: the zone, stand, beacon or camera follows from
``user_id``, the measures from ``value`` and ``props.k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crowd import seat_zone
from . import venue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _stand_columns(df: DataFrame, index: Column) -> DataFrame:
    """Join stand attributes by their position in the stand list."""
    dims = venue.stands(df.sparkSession).drop("tills", "service_rate")
    return (
        df.withColumn("stand_order", index.cast("int"))
        .join(F.broadcast(dims), "stand_order")
        .drop("stand_order")
    )


def crowd(events: DataFrame) -> DataFrame:
    density = F.col("k") / 100.0
    return (
        events.select("ts", "event_id", "user_id", "value", _k().alias("k"))
        .withColumn("zone", _pick(venue.ZONES, F.col("user_id") % 12))
        .select(
            F.col("ts").cast("timestamp").alias("time"),
            F.col("event_id").alias("tie"),
            F.concat(F.lit("CS-"), "zone", F.lit("-"), (F.col("user_id") % 2 + 1).cast("string")).alias(
                "sensor_id"
            ),
            "zone",
            density.alias("density"),
            (F.col("k") * 10).alias("headcount"),
            F.col("value").alias("flow_rate"),
            F.when(density > 0.75, "outbound").when(density < 0.3, "inbound").otherwise("mixed").alias(
                "direction"
            ),
        )
    )


def queues(events: DataFrame) -> DataFrame:
    rows = _stand_columns(events.select("ts", "event_id", "user_id", "value"), F.col("user_id") % 8)
    length = F.floor(F.col("value") / 10).cast("int")
    return rows.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("tie"),
        F.concat(F.lit("QS-"), "stand_id").alias("sensor_id"),
        "stand_id",
        "stand_name",
        "zone",
        length.alias("queue_length"),
        (F.floor(F.col("value") / 4) / 3.5).alias("wait_minutes"),
        F.least(F.lit(1.0), length / F.col("capacity")).alias("capacity_pct"),
        (F.col("event_id") % 50 != 0).alias("is_open"),
    )


def ble(events: DataFrame) -> DataFrame:
    beacon = F.concat(F.lit("BLE-"), (F.col("user_id") % 15 + 1).cast("string"))
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("tie"),
        beacon.alias("beacon_id"),
        F.concat(F.lit("Beacon "), (F.col("user_id") % 15 + 1).cast("string")).alias("location_label"),
        _pick(venue.ZONES, F.col("user_id") % 12).alias("zone"),
        (_k() * 10).alias("active_devices"),
        (F.lit(-55.0) - _k() / 10.0).alias("rssi_avg"),
        F.col("value").alias("dwell_time_avg"),
    )


def cctv(events: DataFrame) -> DataFrame:
    detected = F.col("event_type") == "error"
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("tie"),
        F.concat(F.lit("CAM-"), (F.col("user_id") % 12 + 1).cast("string")).alias("camera_id"),
        _pick(venue.ZONES, F.col("user_id") % 12).alias("zone"),
        (_k() * 10).alias("headcount_estimate"),
        (_k() / 100.0).alias("motion_intensity"),
        detected.alias("anomaly_detected"),
        F.when(detected, _pick(venue.ANOMALY_TYPES, _k() % 5)).alias("anomaly_type"),
    )


def _seat(index: Column) -> Column:
    return F.concat(_pick(["V", "U", "L"], index % 3), index.cast("string"))


def order_requests(events: DataFrame) -> DataFrame:
    """Orders as fans send them, some invalid, some for an unknown stand."""
    stands = [s[0] for s in venue.STANDS] + ["ZZ99"]
    k = _k()
    item = F.struct(
        F.lit("Item").alias("name"), (k % 22).alias("quantity"), F.col("value").alias("price")
    )
    return events.where("event_type = 'purchase'").select(
        F.col("ts").cast("timestamp").alias("placed_at"),
        F.col("event_id").alias("tie"),
        _seat(F.col("user_id")).alias("seat_id"),
        _pick(stands, k % 9).alias("stand_id"),
        F.array(item).alias("items"),
        F.lit(None).cast("string").alias("special_instructions"),
    )


def stored_orders(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order history. Items are grouped by order before anything else is joined,
    so the only large shuffles are the two on the order key."""
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(
        part.select("p_partkey", "p_name", "p_retailprice"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    quantity = (F.col("l_quantity").cast("int") - 1) % 20 + 1
    items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "l_linenumber",
                        F.col("p_name").alias("name"),
                        quantity.alias("quantity"),
                        F.col("p_retailprice").alias("price"),
                    )
                )
            ),
            lambda line: F.struct(
                line["name"].alias("name"),
                line["quantity"].alias("quantity"),
                line["price"].alias("price"),
            ),
        ).alias("items")
    )
    seat = _seat(F.col("o_custkey"))
    joined = _stand_columns(orders.join(items, "o_orderkey", "left"), F.col("o_custkey") % 8)
    return joined.select(
        F.col("o_orderdate").cast("timestamp").alias("placed_at"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        seat.alias("seat_id"),
        "stand_id",
        "stand_name",
        # One order in five was stored without a zone, one for a stay in a concourse.
        F.when(F.col("o_orderkey") % 5 == 1, "Concourse-A")
        .when(F.col("o_orderkey") % 5 != 0, seat_zone(seat))
        .alias("zone"),
        F.coalesce("items", F.array().cast("array<struct<name:string,quantity:int,price:double>>")).alias(
            "items"
        ),
        F.when(F.col("o_orderstatus") == "O", "placed")
        .when(F.col("o_orderstatus") == "P", "preparing")
        .otherwise("delivered")
        .alias("status"),
    )
