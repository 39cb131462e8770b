"""Answers over the current state: waits, flow, routes, alerts, heatmap, exit plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import at
from ..operators import alerts, egress, flow, heatmap, latest, rollup, routes
from . import twin

WAIT_ANSWER = [
    "stand_id", "stand_name", "current_wait_min", "predicted_wait_5min", "predicted_wait_10min",
    "arrival_rate_lambda", "service_rate_mu", "server_count", "utilization_rho",
    "halftime_spike_expected", "recommendation",
]


def wait_answer(queues: DataFrame, **options) -> DataFrame:
    """Forecast of every stand after its last reading."""
    return twin.latest_forecasts(queues, WAIT_ANSWER[1:], **options).select(*WAIT_ANSWER)


def flow_answer(crowd: DataFrame, **options) -> DataFrame:
    """Forecast of every zone from the last run; routes are searched for that run only."""
    return flow.forecast_history(crowd, only_last=True, **options).drop("run", "time", "smoothed")


def best_routes(requests: DataFrame, crowd: DataFrame, as_of: datetime) -> DataFrame:
    """Routes for (from_zone, to_zone) requests, with the last reading of every
    sensor at ``as_of``. The density list is one row, at most one entry per zone."""
    last = latest.latest_per_key(crowd.where(F.col("time") <= at(as_of)), ["sensor_id"], ["zone", "density"])
    now = at(as_of)
    densities = routes.density_maps(
        rollup.zone_means(last.withColumn("snapshot", now), ["snapshot"]), ["snapshot"]
    )
    joined = requests.withColumn("snapshot", now).join(F.broadcast(densities), "snapshot", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return routes.routes(joined.withColumn("densities", F.coalesce("densities", none)).drop("snapshot"))


def live_alerts(crowd: DataFrame, queues: DataFrame, cctv: DataFrame, **options) -> DataFrame:
    """Alerts of the last reading of every sensor, and of stands about to spike."""
    sensor = alerts.sensor_alerts(
        latest.latest_per_key(queues, ["stand_id"], ["time", "tie", "stand_name", "zone", "wait_minutes"]),
        latest.latest_per_key(crowd, ["sensor_id"], ["time", "tie", "zone", "density"]),
        latest.latest_per_key(
            cctv, ["camera_id"], ["time", "tie", "zone", "anomaly_detected", "anomaly_type"]
        ),
    )
    last = twin.latest_forecasts(queues, ["time", "tie", "halftime_spike_expected", "recommendation"], **options)
    return alerts.live_alerts(sensor, alerts.spike_alerts(last, "intelligence"))


def venue_heatmap(crowd: DataFrame, queues: DataFrame, ble: DataFrame, cctv: DataFrame, **options) -> DataFrame:
    return heatmap.heatmap(twin.zones(crowd, ble, cctv), twin.stands(queues, **options))


def exit_plans(crowd: DataFrame, tick: str, within: str, match_end_minutes: float = 0.0) -> DataFrame:
    """Exit plans at the end of every tick of the history.

    A plan made at the end of a tick sees the zone state at that time and the gate
    buckets (one tick wide) of the time before, up to ``within`` old.
    """
    state = latest.state_per_tick(crowd, "zone", ["density"], tick).withColumnRenamed("tick", "plan_time")
    plans = state.select("plan_time").distinct()
    recent = egress.recent_gate_buckets(rollup.crowd_buckets(crowd, tick), plans, tick, within)
    gates = egress.gate_densities(recent, state, ["plan_time"])
    return egress.exit_plans(plans, state, gates, match_end_minutes)


def gate_densities(crowd: DataFrame, tick: str, within: str) -> DataFrame:
    """Gate densities at the end of every tick, as exit plans see them."""
    state = latest.state_per_tick(crowd, "zone", ["density"], tick).withColumnRenamed("tick", "plan_time")
    plans = state.select("plan_time").distinct()
    recent = egress.recent_gate_buckets(rollup.crowd_buckets(crowd, tick), plans, tick, within)
    return egress.gate_densities(recent, state, ["plan_time"])
