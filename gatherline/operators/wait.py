"""Queue-wait forecasts from changes of queue length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import queueing as q
from ..functions.numbers import round_half_up
from ..sources.venue import with_stand_rates
from .ordering import ROWS_PER_TASK, previous_values

FORECAST_COLUMNS = [
    "predicted_wait_5min",
    "predicted_wait_10min",
    "arrival_rate_lambda",
    "service_rate_mu",
    "server_count",
    "utilization_rho",
    "halftime_spike_expected",
    "current_wait_min",
    "recommendation",
]


#: Readings of a stand that its last forecast is made of.
NEEDED_READINGS = 3


def arrival_rates(
    queues: DataFrame,
    window: int = 5,
    order: tuple[str, ...] = ("time", "tie"),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``arrival_rate`` and ``spike`` to every queue reading.

    ``window`` is the number of readings kept per stand: three are enough for
    everything computed here, two leave no room for a spike, one for no change.
    """
    rows = previous_values(queues, ["stand_id"], list(order), "queue_length", rows_per_task)
    return rates_from_previous(rows, window).drop("previous", "before_previous")


def rates_from_previous(rows: DataFrame, window: int = 5) -> DataFrame:
    """Arrival rate and spike from a row's own and its two previous lengths."""
    rows = with_stand_rates(rows)
    capacity = F.col("tills") * F.col("service_rate")
    length = F.col("queue_length")
    one_back = F.col("previous.v") if window >= 2 else F.lit(None).cast("int")
    two_back = F.col("before_previous.v") if window >= 3 else F.lit(None).cast("int")
    changed = round_half_up(F.greatest(F.lit(q.MIN_ARRIVAL_RATE), capacity + (length - one_back)), 3)
    growth = (length - two_back) / F.greatest(F.lit(1), two_back)
    return rows.withColumns(
        {
            "arrival_rate": F.when(one_back.isNull(), capacity * q.EQUILIBRIUM_LOAD).otherwise(changed),
            "spike": F.coalesce(
                (two_back < one_back) & (one_back < length) & (growth > q.SPIKE_GROWTH), F.lit(False)
            ),
        }
    )


def forecasts(rates: DataFrame) -> DataFrame:
    """Waits now and in 5 and 10 minutes, utilisation and advice per reading."""
    arrival, mu, c, spike = (F.col(n) for n in ("arrival_rate", "service_rate", "tills", "spike"))
    rows = rates.withColumns(
        {
            "current_wait_min": q.mean_wait(arrival, mu, c),
            "_load": q.utilisation(arrival, mu, c),
            "predicted_wait_5min": round_half_up(q.mean_wait(q.rate_in_5_min(arrival, spike), mu, c), 2),
            "predicted_wait_10min": round_half_up(q.mean_wait(q.rate_in_10_min(arrival, spike), mu, c), 2),
        }
    )
    return (
        rows.withColumns(
            {
                "recommendation": q.recommendation(
                    spike, F.col("_load"), F.col("current_wait_min"), F.col("stand_name")
                ),
                "arrival_rate_lambda": round_half_up(arrival, 3),
                "utilization_rho": round_half_up(F.col("_load"), 3),
            }
        )
        .withColumnsRenamed(
            {
                "service_rate": "service_rate_mu",
                "tills": "server_count",
                "spike": "halftime_spike_expected",
            }
        )
        .drop("arrival_rate", "_load")
    )


def wait_forecasts(queues: DataFrame, window: int = 5, **options) -> DataFrame:
    """One forecast per queue reading."""
    keep = [c for c in ("time", "tie", "arrival", "stand_id", "stand_name", "queue_length", "is_open") if c in queues.columns]
    rates = arrival_rates(queues.select(*keep), window, **options)
    return forecasts(rates)


def default_forecast(stands: DataFrame) -> DataFrame:
    """Forecast of a stand without any reading: as for a first reading."""
    rates = with_stand_rates(stands.select("stand_id", "stand_name")).withColumns(
        {
            "arrival_rate": F.col("tills") * F.col("service_rate") * q.EQUILIBRIUM_LOAD,
            "spike": F.lit(False),
        }
    )
    return forecasts(rates)
