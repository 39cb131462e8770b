"""Venue snapshots: the latest reading of every sensor, attendance, congestion and
alert texts, at one time or at the end of every tick."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crowd import congestion_band
from ..functions.numbers import exact_mean
from ..functions.times import at
from .alerts import sensor_alerts
from .latest import last_tick, latest_per_key, state_per_tick

_CROWD = ["zone", "time", "density", "headcount", "flow_rate", "direction"]
_QUEUE = ["stand_id", "stand_name", "zone", "time", "queue_length", "wait_minutes", "capacity_pct", "is_open"]
_BLE = ["location_label", "zone", "time", "active_devices", "rssi_avg", "dwell_time_avg"]
_CCTV = ["zone", "time", "headcount_estimate", "motion_intensity", "anomaly_detected", "anomaly_type"]
_KINDS = {"crowd": ("sensor_id", _CROWD), "queue": ("sensor_id", _QUEUE), "ble": ("beacon_id", _BLE), "cctv": ("camera_id", _CCTV)}


def sensor_fields(kind: str) -> tuple[str, list[str]]:
    """The sensor column of readings of a kind (crowd, queue, ble, cctv), and the fields a snapshot shows of them."""
    return _KINDS[kind]


def venue_density(crowd: DataFrame, keys: list[str]) -> DataFrame:
    """Mean density over sensors (not zones); 0 without readings."""
    mean = F.coalesce(exact_mean(F.col("density")), F.lit(0.0))
    return crowd.groupBy(*keys).agg(mean.alias("density")).withColumn(
        "venue_congestion_level", congestion_band(F.col("density"))
    )


def attendance(ble: DataFrame, keys: list[str]) -> DataFrame:
    """Half of all active devices, rounded down."""
    return ble.groupBy(*keys).agg(
        F.floor(F.coalesce(F.sum("active_devices"), F.lit(0)) / 2).alias("total_attendance")
    )


def _listed(df: DataFrame, name: str) -> DataFrame:
    sensor, fields = _KINDS[name]
    return df.groupBy("tick").agg(
        F.sort_array(F.collect_list(F.struct(sensor, *fields))).alias(name)
    )


def assemble(latest: dict[str, DataFrame]) -> DataFrame:
    """One row per tick from the latest readings per sensor and tick.

    Every list is as long as there are sensors of its kind.
    """
    alerts = sensor_alerts(
        latest["queue"].withColumn("tie", F.lit(0)).withColumn("time", F.col("tick")),
        latest["crowd"].withColumn("tie", F.lit(0)).withColumn("time", F.col("tick")),
        latest["cctv"].withColumn("tie", F.lit(0)).withColumn("time", F.col("tick")),
    )
    texts = alerts.groupBy(F.col("time").alias("tick")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("source_order", "message"))), lambda a: a["message"]
        ).alias("alerts")
    )
    rows = (
        venue_density(latest["crowd"], ["tick"])
        .drop("density")
        .join(attendance(latest["ble"], ["tick"]), "tick", "full_outer")
    )
    for name in _KINDS:
        rows = rows.join(_listed(latest[name], name), "tick", "full_outer")
    rows = rows.join(texts, "tick", "left")
    return rows.select(
        F.col("tick").alias("time"),
        F.coalesce("total_attendance", F.lit(0)).alias("total_attendance"),
        F.coalesce("venue_congestion_level", F.lit("low")).alias("venue_congestion_level"),
        *[
            F.coalesce(F.col(n), F.array().cast(rows.schema[n].dataType)).alias(alias)
            for n, alias in (("crowd", "crowd_sensors"), ("queue", "queue_sensors"), ("ble", "ble_beacons"), ("cctv", "cctv_cameras"))
        ],
        F.coalesce("alerts", F.array().cast("array<string>")).alias("alerts"),
    )


def snapshots_per_tick(readings: dict[str, DataFrame], tick: str) -> DataFrame:
    """Snapshots at the end of every tick. ``readings``: crowd, queue, ble, cctv."""
    until = last_tick([readings[name] for name in _KINDS], tick)
    return assemble(
        {
            name: state_per_tick(readings[name], key, fields, tick, until=until)
            for name, (key, fields) in _KINDS.items()
        }
    )


def snapshot_at(readings: dict[str, DataFrame], as_of: datetime) -> DataFrame:
    """The snapshot at one time."""
    now = at(as_of)
    return assemble(
        {
            name: latest_per_key(readings[name].where(F.col("time") <= now), [key], fields).withColumn("tick", now)
            for name, (key, fields) in _KINDS.items()
        }
    )
