"""Alert rules, their union, the alert queue, resolution and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_prefix, canonical_uuid, is_uuid, iso_time, whole_number, whole_percent
from ..schemas import ALERT_ENVELOPE, FLOW_ENVELOPE, WAIT_ENVELOPE
from ..sources import venue

# Limits of the sensor rules.
LONG_WAIT = 15
MODERATE_WAIT = 10
HIGH_DENSITY = 0.85

_COLUMNS = ["time", "tie", "source_order", "severity", "category", "zone", "stand_id", "message"]


def _alert(df: DataFrame, order: int, severity: str | None, category: str, message: Column) -> DataFrame:
    def has(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None)

    return df.select(
        has("time").cast("timestamp").alias("time"),
        has("tie").cast("long").alias("tie"),
        F.lit(order).alias("source_order"),
        F.lit(severity).cast("string").alias("severity"),
        F.lit(category).alias("category"),
        has("zone").cast("string").alias("zone"),
        has("stand_id").cast("string").alias("stand_id"),
        message.alias("message"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def queue_alerts(queues: DataFrame) -> DataFrame:
    wait = F.col("wait_minutes")
    text = F.when(
        wait > LONG_WAIT,
        F.concat(
            F.lit("Long queue at "),
            "stand_name",
            F.lit(" ("),
            whole_number(wait),
            F.lit(" min wait) — consider opening reserve stand"),
        ),
    ).otherwise(
        F.concat(F.lit("Moderate queue at "), "stand_name", F.lit(" ("), whole_number(wait), F.lit(" min wait)"))
    )
    return _alert(queues.where(wait > MODERATE_WAIT), 1, None, "queue", text)


def crowd_alerts(crowd: DataFrame) -> DataFrame:
    density = F.col("density")
    text = F.concat(
        F.lit("High crowd density in "),
        "zone",
        F.lit(" ("),
        whole_percent(density),
        F.lit(") — activate crowd management"),
    )
    return _alert(crowd.where(density > HIGH_DENSITY), 2, None, "crowd", text)


def camera_alerts(cctv: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("Anomaly detected by "),
        "camera_id",
        F.lit(" in "),
        "zone",
        F.lit(": "),
        F.coalesce("anomaly_type", F.lit("None")),
    )
    return _alert(cctv.where("anomaly_detected"), 3, None, "cctv", text)


def sensor_alerts(queues: DataFrame, crowd: DataFrame, cctv: DataFrame) -> DataFrame:
    """Queue, crowd and camera alerts; ``source_order`` keeps that order."""
    return union([queue_alerts(queues), crowd_alerts(crowd), camera_alerts(cctv)])


def critical_crowd_alerts(flow: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit("CRITICAL congestion in "),
        "zone",
        F.lit(" (density="),
        whole_percent(F.col("current_density")),
        F.lit(") — activate crowd management"),
    )
    return _alert(flow.where("congestion_risk = 'critical'"), 4, "critical", "crowd", text)


def spike_alerts(forecasts: DataFrame, category: str = "queue") -> DataFrame:
    """One alert per flagged spike. Live views label the category "intelligence"."""
    rows = forecasts.where("halftime_spike_expected").drop("zone")
    return _alert(rows, 5, "warning", category, F.col("recommendation"))


def live_alerts(sensor: DataFrame, intelligence: DataFrame) -> DataFrame:
    return union(
        [
            sensor.withColumn("kind", F.lit("sensor")),
            intelligence.withColumn("kind", F.lit("intelligence")),
        ]
    )


def alert_totals(live: DataFrame) -> DataFrame:
    return live.agg(
        F.count_if(F.col("kind") == "sensor").alias("sensor_alerts"),
        F.count_if(F.col("kind") == "intelligence").alias("intelligence_alerts"),
        F.count("*").alias("total"),
    )


def unresolved(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.coalesce("resolved", F.lit(False)))


def newest_unresolved(alerts: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return unresolved(alerts).orderBy(F.desc("time"), "alert_id").limit(limit)


def unresolved_critical(alerts: DataFrame) -> DataFrame:
    return unresolved(alerts).agg(
        F.count_if(F.col("severity") == "critical").alias("unresolved_critical_alerts")
    )


def resolve(alerts: DataFrame, resolutions: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply resolutions: rows with ``alert_id`` (any UUID spelling) and, if named, a column of their order.

    Returns the updated alerts and one outcome row per resolution: resolved (the first
    request for an alert), not_found (no such unresolved alert, or resolved by an earlier
    request) or invalid_id. Requests that share the first place of the order, and all
    requests for an alert if no order is named, count as made at once: each is resolved.
    A NULL place comes first.
    """
    asked = resolutions.withColumn("_id", canonical_uuid(F.col("alert_id")))
    ids = asked.where(F.col("_id").isNotNull()).select(F.col("_id").alias("alert_id")).distinct()
    marked = alerts.join(ids.withColumn("_hit", F.lit(True)), "alert_id", "left")
    updated = marked.withColumn("resolved", F.coalesce("_hit", "resolved")).drop("_hit")
    place = F.struct(F.col(order) if order else F.lit(0))  # a struct, so that NULL is a least place
    open_ids = unresolved(alerts).select(F.col("alert_id").alias("_id")).distinct()
    first = asked.groupBy("_id").agg(F.min(place).alias("_first")).join(open_ids, "_id")
    outcome = (
        F.when(~is_uuid(F.col("alert_id")), "invalid_id")
        .when(F.col("_first").isNotNull() & place.eqNullSafe(F.col("_first")), "resolved")
        .otherwise("not_found")
    )
    outcomes = asked.join(first, "_id", "left").withColumn("outcome", outcome).drop("_id", "_first")
    return updated, outcomes


def with_stand_zone(alerts: DataFrame) -> DataFrame:
    """Zone of the stand an alert names, as ``stand_zone``; NULL if unknown."""
    places = venue.stands(alerts.sparkSession).select(
        F.col("stand_id").alias("_stand"), F.col("zone").alias("stand_zone")
    )
    return alerts.join(F.broadcast(places), F.upper(F.col("stand_id")) == F.col("_stand"), "left").drop("_stand")


def _complete(payload: Column, schema, optional: tuple[str, ...] = ()) -> Column:
    """Whether a payload has every field of ``schema``, in its type."""
    needed = [
        F.try_variant_get(payload, f"$.{f.name}", f.dataType.simpleString()).isNotNull()
        for f in schema.fields
        if f.name not in optional
    ]
    return reduce(lambda a, b: a & b, needed)


def route_messages(messages: DataFrame) -> DataFrame:
    """Audiences of every message: one row per (message, room).

    Input: topic, key, value. Adds ``room``, ``type``, ``routed_at`` (the message's
    own values where it has them) and ``valid``: whether the message has all fields
    its receivers declare. The full payload is passed on either way, also where it is no
    JSON at all. It is parsed once, whatever its type. Stateless, so it serves streams as well.
    """
    payload = F.col("_payload")

    def field(name: str) -> Column:
        # Empty text counts as absent.
        found = F.try_variant_get(payload, f"$.{name}", "string")
        return F.when(found != "", found)

    is_alert = F.col("topic") == venue.ALERTS_TOPIC
    rows = with_stand_zone(
        messages.withColumn("_payload", F.try_parse_json("value")).withColumns(
            {"seat_id": field("seat_id"), "zone": field("zone"), "stand_id": field("stand_id")}
        )
    )
    flow_zone = after_prefix(F.col("key"), "flow:")
    is_wait = F.col("key").startswith("wait:")
    zone_room = lambda z: F.concat(F.lit("zone:"), z)
    special = (
        F.when(is_alert & F.col("seat_id").isNotNull(), F.concat(F.lit("fan:"), "seat_id"))
        .when(is_alert & F.col("zone").isNotNull(), zone_room(F.col("zone")))
        .when(is_alert, zone_room(F.col("stand_zone")))
        .otherwise(zone_room(flow_zone))
    )
    kind = (
        F.when(is_alert, "alert")
        .when(flow_zone.isNotNull(), "flow_intelligence")
        .when(is_wait, "wait_intelligence")
        .otherwise("intelligence")
    )
    valid = (
        F.when(is_alert, _complete(payload, ALERT_ENVELOPE, ("seat_id", "zone", "stand_id")))
        .when(flow_zone.isNotNull(), _complete(payload, FLOW_ENVELOPE))
        .when(is_wait, _complete(payload, WAIT_ENVELOPE))
        .otherwise(F.lit(False))
    )
    told = rows.withColumns(
        {
            "_rooms": F.array_compact(F.array(special, F.lit("ops"))),
            "type": F.coalesce(F.try_variant_get(payload, "$._type", "string"), kind),
            "routed_at": F.coalesce(
                F.try_variant_get(payload, "$._routed_at", "string"), iso_time(F.current_timestamp())
            ),
            "valid": F.coalesce(valid, F.lit(False)),
        }
    )
    return told.select(*messages.columns, F.explode("_rooms").alias("room"), "type", "routed_at", "valid")
