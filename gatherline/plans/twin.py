"""The live picture of the venue: zones and stands with their forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crowd import congestion_band
from ..operators import flow, latest, wait
from ..operators.ordering import numbered
from ..schemas import ZONE_STATE_COLUMNS

STAND_FORECAST = ["predicted_wait_5min", "predicted_wait_10min", "halftime_spike_expected"]


def latest_forecasts(queues: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """The last forecast of every stand, from its last readings only."""
    recent = latest.last_rows(queues, ["stand_id"], wait.NEEDED_READINGS)
    rows = wait.wait_forecasts(recent, **options)
    wanted = columns or [c for c in rows.columns if c not in ("stand_id", "time", "tie")]
    return latest.latest_per_key(rows, ["stand_id"], wanted)


def stands(queues: DataFrame, **options) -> DataFrame:
    """Stand state with the last forecast; seeded stands without one keep NULL."""
    state = latest.stand_state(queues)
    updated = latest.update_existing(state, latest_forecasts(queues, STAND_FORECAST, **options), "stand_id", STAND_FORECAST)
    return updated.withColumn("halftime_spike_expected", F.coalesce("halftime_spike_expected", F.lit(False)))


def zones(crowd: DataFrame, ble: DataFrame | None = None, cctv: DataFrame | None = None, **options) -> DataFrame:
    """Zone state after all readings and all runs.

    The band of a zone is that of its last reading, or of the last run covering it
    if that run fired later.
    """
    fields = ["time", *ZONE_STATE_COLUMNS[:-1]]
    rows, last = numbered(crowd.select("tie", "zone", *fields), ["time", "tie"])
    state = latest.latest_per_key(rows, ["zone"], [*fields, "index"], ["index"])
    runs = flow.latest_run_per_zone(flow.flow_forecasts(rows, last, **options))
    merged = (
        state.join(runs.select("zone", "fired_at", "congestion_risk"), "zone", "left")
        .withColumn(
            "congestion_level",
            F.when(F.col("fired_at") >= F.col("index"), F.col("congestion_risk")).otherwise(
                congestion_band(F.col("density"))
            ),
        )
        .select("zone", F.col("time").alias("last_updated"), *ZONE_STATE_COLUMNS)
    )
    if ble is not None and cctv is not None:
        return latest.with_sensor_state(merged, latest.zone_sensor_state(ble, cctv))
    return merged
