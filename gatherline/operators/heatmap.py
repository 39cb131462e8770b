"""Zones with their stands nested, and totals over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crowd import is_blocked
from ..functions.numbers import round_half_up
from ..functions.text import iso_time

_STAND = [
    "stand_id", "stand_name", "queue_length", "wait_minutes", "capacity_pct",
    "predicted_wait_5min", "is_open", "halftime_spike_expected",
]


def heatmap(zones: DataFrame, stands: DataFrame) -> DataFrame:
    """One row per zone with an array of its stands, shortest wait first.

    A zone without stands has an empty array; a zone known only from its stands
    has no state. Both inputs hold one row per zone or stand.
    """
    two = lambda c: round_half_up(F.col(c), 2).alias(c)
    shown = stands.select(
        "zone",
        F.col("wait_minutes").isNull().alias("_unknown"),
        F.col("wait_minutes").alias("_wait"),
        "stand_id",
        "stand_name",
        "queue_length",
        two("wait_minutes"),
        two("capacity_pct"),
        two("predicted_wait_5min"),
        F.coalesce("is_open", F.lit(False)).alias("is_open"),
        F.coalesce("halftime_spike_expected", F.lit(False)).alias("halftime_spike_expected"),
    )
    nested = shown.groupBy("zone").agg(
        F.sort_array(F.collect_list(F.struct("_unknown", "_wait", *_STAND))).alias("s")
    ).select("zone", F.transform("s", lambda s: F.struct(*[s[c].alias(c) for c in _STAND])).alias("stands"))
    none = F.array().cast(nested.schema["stands"].dataType)
    known = zones.withColumn("_known", F.lit(True))
    return known.join(nested, "zone", "full_outer").select(
        "zone",
        round_half_up(F.col("density"), 4).alias("density"),
        "headcount",
        round_half_up(F.col("flow_rate"), 2).alias("flow_rate"),
        "congestion_level",
        F.coalesce("anomaly_active", F.lit(False)).alias("anomaly_active"),
        iso_time(F.col("last_updated")).alias("last_updated"),
        F.coalesce("stands", none).alias("stands"),
        F.col("_known").isNull().alias("stand_only"),
        F.coalesce(is_blocked(F.col("density")), F.lit(False)).alias("is_critical"),
    )


def in_display_order(heat: DataFrame) -> DataFrame:
    """Known zones by name, then zones known only from stands."""
    return heat.orderBy("stand_only", "zone")


def totals(heat: DataFrame) -> DataFrame:
    return heat.agg(
        F.count("*").alias("total_zones"),
        F.coalesce(F.sum(F.size("stands")), F.lit(0)).alias("total_stands"),
        F.sort_array(F.collect_set(F.when(F.col("is_critical"), F.col("zone")))).alias("critical_zones"),
    )


def stand_rows(heat: DataFrame) -> DataFrame:
    """The nested stands as flat rows, with their place inside the zone."""
    return heat.select("zone", F.posexplode("stands").alias("place", "s")).select("zone", "place", "s.*")
