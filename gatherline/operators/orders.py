"""Food orders: checks, state at order time, price and delivery time; nearby stands;
order history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crowd import order_eta_minutes, plus_minutes, seat_zone
from ..functions.numbers import round_half_up
from ..functions.text import uuid_from
from ..sources import venue
from ..sources.messages import failed_rules, normalised_stand, order_faults
from .latest import open_stands
from .ordering import ROWS_PER_TASK, carried_forward
from .routes import VENUE, Graph, walk_columns, with_searches

UNKNOWN_STAND = "stand not found"
CLOSED_STAND = "stand closed"


def order_total(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0.0), lambda t, i: t + i["price"] * i["quantity"])
    return round_half_up(total, 2)


def checked(requests: DataFrame) -> DataFrame:
    """Requests with stand name and zone and a ``reasons`` list (empty: acceptable)."""
    places = venue.stands(requests.sparkSession).select(
        "stand_id", "stand_name", F.col("zone").alias("stand_zone")
    )
    rows = normalised_stand(requests).join(F.broadcast(places), "stand_id", "left")
    faults = failed_rules(order_faults())
    unknown = F.when(F.col("stand_name").isNull(), F.array(F.lit(UNKNOWN_STAND))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.withColumn("reasons", F.when(F.size(faults) > 0, faults).otherwise(unknown))


def with_state_at(
    requests: DataFrame,
    history: DataFrame,
    columns: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    time: str = "placed_at",
) -> DataFrame:
    """Add ``state``: the ``columns`` of the stand's last history row at or before
    ``time``; NULL before its first. An as-of join, as a union in time order."""
    state = F.struct(*columns)
    left = requests.withColumns(
        {"_time": F.col(time), "_kind": F.lit(1), "_state": F.lit(None).cast(history.select(state.alias("s")).schema["s"].dataType)}
    )
    right = history.select(
        "stand_id",
        F.col("time").alias("_time"),
        F.col("tie"),
        F.lit(0).alias("_kind"),
        state.alias("_state"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    filled = carried_forward(
        both, ["stand_id"], ["_time", "_kind", "tie"], F.col("_state"), "state", rows_per_task
    )
    return filled.where("_kind = 1").drop("_time", "_kind", "_state")


def latest_order_zone(orders: DataFrame) -> DataFrame:
    """Zone stored with the latest order of every seat; may be NULL."""
    return orders.groupBy("seat_id").agg(
        F.max_by("zone", F.struct("placed_at", "order_id")).alias("ordered_zone")
    )


def with_fan_zone(df: DataFrame, orders: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Add ``fan_zone``: that of the seat's latest order, else from the seat id.

    ``known``: (seat_id, ordered_zone) where :func:`latest_order_zone` of the orders is at hand.
    """
    inferred = seat_zone(F.col("seat_id"))
    if known is None and orders is None:
        return df.withColumn("fan_zone", inferred)
    known = latest_order_zone(orders) if known is None else known
    return (
        df.join(known, "seat_id", "left")
        .withColumn("fan_zone", F.coalesce("ordered_zone", inferred))
        .drop("ordered_zone")
    )


#: What an order needs to know of its stand.
STATE_AT_ORDER = ["predicted_wait_5min", "is_open"]


def place_orders(
    requests: DataFrame,
    forecasts: DataFrame,
    default_forecasts: DataFrame,
    snapshots: DataFrame,
    tick: str,
    orders: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    graph: Graph = VENUE,
) -> tuple[DataFrame, DataFrame]:
    """Accepted orders with price and delivery time, and rejected requests.

    ``requests``: placed_at, tie, seat_id, stand_id, items, special_instructions.
    ``forecasts``: wait forecasts per reading, with is_open. ``snapshots``: densities
    per ``tick`` (column snapshot), used for the walk.
    """
    rows = checked(requests)
    acceptable = rows.where(F.size("reasons") == 0)
    stated = with_state_at(acceptable, forecasts, STATE_AT_ORDER, rows_per_task)
    return decided(rows.where(F.size("reasons") > 0), stated, default_forecasts, snapshots, tick, orders, None, graph)


def decided(
    faulty: DataFrame,
    stated: DataFrame,
    default_forecasts: DataFrame,
    snapshots: DataFrame,
    tick: str,
    orders: DataFrame | None = None,
    known_zones: DataFrame | None = None,
    graph: Graph = VENUE,
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected orders, of requests that have faults (``reasons``) and of others with the
    ``state`` of their stand as they were placed."""
    closed = ~F.coalesce(F.col("state.is_open"), F.lit(True))
    kept = ["placed_at", "tie", "seat_id", "stand_id", "reasons"]
    rejected = faulty.select(*kept).unionByName(
        stated.where(closed).withColumn("reasons", F.array(F.lit(CLOSED_STAND))).select(*kept)
    )

    cold = default_forecasts.select("stand_id", F.col("predicted_wait_5min").alias("_cold_wait"))
    taken = with_fan_zone(stated.where(~closed), orders, known_zones).join(F.broadcast(cold), "stand_id", "left")
    taken = taken.withColumn("snapshot", F.window("placed_at", tick)["start"])
    stand_zones = sorted({s[2] for s in venue.STANDS})
    found = with_searches(taken, snapshots, "snapshot", "stand_zone", stand_zones, graph)
    _, minutes = walk_columns(F.col("stand_zone"), F.col("fan_zone"), graph)
    wait = F.coalesce("state.predicted_wait_5min", "_cold_wait")
    timed = found.withColumns({"_walk": minutes, "_wait": wait}).withColumn(
        "delivery_eta_minutes", round_half_up(order_eta_minutes(F.col("_wait"), F.col("_walk")), 2)
    )
    accepted = timed.select(
        "placed_at",
        uuid_from(F.col("seat_id"), F.col("stand_id"), F.col("tie")).alias("order_id"),
        "seat_id",
        "stand_id",
        "stand_name",
        F.col("fan_zone").alias("zone"),
        "items",
        F.lit("placed").alias("status"),
        round_half_up(F.col("_wait"), 2).alias("queue_wait_minutes"),
        round_half_up(F.col("_walk"), 2).alias("walk_minutes"),
        "delivery_eta_minutes",
        plus_minutes(F.col("placed_at"), F.col("delivery_eta_minutes")).alias("delivery_eta_timestamp"),
        order_total(F.col("items")).alias("total_price"),
        "special_instructions",
        F.col("placed_at").alias("updated_at"),
        "tie",
    )
    return accepted, rejected


def ranked_stands(stands: DataFrame, top_n: int = 3, key: str = "tick") -> DataFrame:
    """The open stands with the shortest wait of every tick, as one array.

    A tick has one row per stand, so the array is as short as the list of stands.
    """
    if not 1 <= top_n <= 8:
        raise ValueError("top_n must be 1 to 8")
    wait = F.coalesce("wait_minutes", F.lit(0.0))
    fields = ["stand_id", "stand_name", "zone", "is_open", "predicted_wait_5min", "halftime_spike_expected"]
    entry = F.struct(wait.alias("wait"), *fields)
    return (
        open_stands(stands)
        .groupBy(key)
        .agg(F.slice(F.sort_array(F.collect_list(entry)), 1, top_n).alias("nearby"))
    )


def nearby_stands(
    requests: DataFrame,
    stands: DataFrame,
    snapshots: DataFrame,
    top_n: int = 3,
    orders: DataFrame | None = None,
    graph: Graph = VENUE,
) -> DataFrame:
    """Best stands for many seats.

    ``requests``: tick, seat_id and any other columns. ``stands``: stand state with
    forecasts per tick. ``snapshots``: densities per tick.
    """
    kept = requests.columns
    asked = with_fan_zone(requests, orders).join(ranked_stands(stands, top_n), "tick")
    found = with_searches(asked, snapshots, "tick", "fan_zone", graph=graph)
    each = found.select(
        *kept, "fan_zone", "_cost", "_pred", F.posexplode("nearby").alias("_place", "s")
    ).withColumn("_to", F.col("s.zone"))
    path, minutes = walk_columns(F.col("fan_zone"), F.col("_to"), graph)
    wait = F.col("s.wait")
    return each.withColumns({"path": path, "_walk": minutes}).select(
        *kept,
        "fan_zone",
        (F.col("_place") + 1).alias("rank"),
        "s.stand_id",
        "s.stand_name",
        F.col("_to").alias("zone"),
        round_half_up(wait, 2).alias("wait_minutes"),
        round_half_up(F.coalesce("s.predicted_wait_5min", wait), 2).alias("predicted_wait_5min"),
        "path",
        round_half_up(F.col("_walk"), 2).alias("estimated_walk_minutes"),
        round_half_up(wait + F.col("_walk"), 2).alias("total_eta_minutes"),
        F.coalesce("s.is_open", F.lit(True)).alias("is_open"),
        F.coalesce("s.halftime_spike_expected", F.lit(False)).alias("halftime_spike_expected"),
    )


def order_history(orders: DataFrame, seat_id: str, limit: int = 20, status: str | None = None) -> DataFrame:
    """Newest orders of a seat."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    rows = orders.where(F.col("seat_id") == seat_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc("placed_at"), "order_id").limit(limit)


def order_histories(orders: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """The newest orders of every seat, with ``place_in_history`` from 1.

    Rows beyond the limit go before the shuffle already, as ranks are limited on both sides of it.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    rows = orders if status is None else orders.where(F.col("status") == status)
    newest = Window.partitionBy("seat_id").orderBy(F.desc("placed_at"), "order_id")
    return rows.withColumn("place_in_history", F.row_number().over(newest)).where(F.col("place_in_history") <= limit)
