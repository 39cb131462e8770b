"""Latest state per key, and updates of it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crowd import congestion_band
from ..schemas import STAND_STATE_COLUMNS, ZONE_STATE_COLUMNS
from ..sources import venue

EVENT_TIME = ["time", "tie"]
ARRIVAL = ["arrival"]


def latest_per_key(
    df: DataFrame, keys: list[str], columns: list[str], order: list[str] | None = None
) -> DataFrame:
    """The last row of every key. ``max_by`` combines on the map side, so a hot
    key costs one row per task instead of a shuffle of its history."""
    order = order or EVENT_TIME
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return df.groupBy(*keys).agg(last).select(*keys, "s.*")


def last_rows(df: DataFrame, keys: list[str], n: int, order: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows of every key. Ranks are limited before the shuffle, so a hot key costs ``n`` rows per task."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order or EVENT_TIME])
    return df.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= n).drop("_place")


def zone_state(crowd: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per zone: its last reading and the band of that reading."""
    state = latest_per_key(crowd, ["zone"], ["time", *ZONE_STATE_COLUMNS[:-1]], order)
    return state.withColumn("congestion_level", congestion_band(F.col("density"))).withColumnRenamed(
        "time", "last_updated"
    )


def stand_state(queues: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per stand. Name and zone keep the value they had first; every listed
    stand exists with zero state before it has a reading."""
    by = order or EVENT_TIME
    seen = (
        queues.groupBy("stand_id")
        .agg(
            F.max_by(F.struct("time", *STAND_STATE_COLUMNS), F.struct(*by)).alias("s"),
            F.min_by(F.struct("stand_name", "zone"), F.struct(*by)).alias("first"),
        )
        .select("stand_id", F.col("first.stand_name").alias("seen_name"), F.col("first.zone").alias("seen_zone"), "s.*")
    )
    seed = venue.stands(queues.sparkSession).select("stand_id", "stand_name", "zone")
    return seen.join(F.broadcast(seed), "stand_id", "full_outer").select(
        "stand_id",
        F.coalesce("stand_name", "seen_name").alias("stand_name"),
        F.coalesce("zone", "seen_zone").alias("zone"),
        F.col("time").alias("last_updated"),
        F.coalesce("queue_length", F.lit(0)).alias("queue_length"),
        F.coalesce("wait_minutes", F.lit(0.0)).alias("wait_minutes"),
        F.coalesce("capacity_pct", F.lit(0.0)).alias("capacity_pct"),
        F.coalesce("is_open", F.lit(True)).alias("is_open"),
    )


def merge_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update_existing(state: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` of the rows that exist; never adds a row."""
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = state.join(fresh, key, "left")
    for c in columns:
        new = F.col(f"_new_{c}")
        joined = joined.withColumn(c, F.coalesce(new, c) if c in state.columns else new)
    return joined.drop(*[f"_new_{c}" for c in columns])


def zone_sensor_state(ble: DataFrame, cctv: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Devices, camera headcount and anomaly flag per zone, from the last reading
    of every beacon and camera of the zone."""
    by = order or EVENT_TIME
    devices = (
        latest_per_key(ble, ["beacon_id", "zone"], ["active_devices"], by)
        .groupBy("zone")
        .agg(F.sum("active_devices").cast("int").alias("ble_active_devices"))
    )
    cameras = (
        latest_per_key(cctv, ["camera_id", "zone"], ["headcount_estimate", "anomaly_detected"], by)
        .groupBy("zone")
        .agg(
            F.sum("headcount_estimate").cast("int").alias("cctv_headcount"),
            F.bool_or("anomaly_detected").alias("anomaly_active"),
        )
    )
    return devices.join(cameras, "zone", "full_outer")


def with_sensor_state(zones: DataFrame, sensors: DataFrame) -> DataFrame:
    return zones.join(sensors, "zone", "left").withColumn(
        "anomaly_active", F.coalesce("anomaly_active", F.lit(False))
    )


def state_per_tick(
    readings: DataFrame,
    key: str,
    columns: list[str],
    tick: str,
    order: list[str] | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """The state of every key at the end of every tick (a duration such as "1 hour").

    A tick without a reading keeps the state of the tick before. Readings are
    reduced to one row per (key, tick) with map-side combining first; the gaps are
    then filled on that small table, whose size depends on the time span only.
    ``tick`` in the result is the end of the tick: state of readings before it. The
    last state is kept up to the tick ``until``, by default the last one seen.
    """
    ends = readings.withColumn("tick", F.window("time", tick)["end"])
    seen = latest_per_key(ends, [key, "tick"], columns, order)
    final = until if until is not None else last_tick([readings], tick)
    history = Window.partitionBy(key).orderBy("tick")
    step = F.expr(f"INTERVAL '{tick}'")
    until = F.coalesce(F.lead("tick").over(history) - step, F.lit(final).cast("timestamp"))
    return seen.withColumn("_until", until).where("tick <= _until").withColumn(
        "tick", F.explode(F.sequence("tick", "_until", step))
    ).drop("_until")


def last_tick(tables: list[DataFrame], tick: str) -> datetime | None:
    """End of the tick of the newest reading of all ``tables``."""
    times = [t.agg(F.max("time").alias("time")) for t in tables]
    newest = reduce(DataFrame.unionByName, times).agg(F.max("time").alias("time"))
    found = newest.where("time IS NOT NULL").select(F.window("time", tick)["end"].alias("end")).first()
    return found["end"] if found else None


def by_wait(stands: DataFrame) -> DataFrame:
    """Shortest wait first, unknown waits last."""
    return stands.orderBy(F.asc_nulls_last("wait_minutes"), "stand_id")


def shortest_waits(readings: DataFrame, top_n: int = 3) -> DataFrame:
    """The ``top_n`` readings with the shortest wait; ties in stand order."""
    place = venue.stands(readings.sparkSession).select("stand_id", "stand_order")
    return (
        readings.join(F.broadcast(place), "stand_id", "left")
        .orderBy("wait_minutes", F.asc_nulls_last("stand_order"), "stand_id")
        .limit(top_n)
        .drop("stand_order")
    )


def open_stands(stands: DataFrame) -> DataFrame:
    return stands.where(F.coalesce("is_open", F.lit(True)))


def one_zone(df: DataFrame, zone: str) -> DataFrame:
    return df.where(F.col("zone") == zone)


def one_stand(df: DataFrame, stand_id: str) -> DataFrame:
    return df.where(F.col("stand_id") == F.upper(F.lit(stand_id)))


def anomalies(cctv: DataFrame) -> DataFrame:
    return cctv.where("anomaly_detected")
