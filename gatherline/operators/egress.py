"""Leaving the venue: gate densities, hops to a gate, gate choice, exit windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crowd import (
    EXIT_WINDOW_MINUTES,
    congestion_weight,
    exit_offset_minutes,
    is_blocked,
    plus_minutes,
)
from ..functions.numbers import or_zero, round_half_up
from ..sources import venue
from .latest import latest_per_key
from .routes import Graph, search

_GATE = "Gate-"


def recent_gate_buckets(
    buckets: DataFrame, plans: DataFrame, width: str, within: str = "5 minutes"
) -> DataFrame:
    """Per plan time, the newest bucket of every gate started within ``within``.

    ``plans`` has one column ``plan_time``, the same grid for all rows: multiples of
    ``width``. A bucket is then recent for a handful of grid points, so it is sent
    to those by an equi-join instead of a range condition.
    """
    gates = buckets.where(F.col("zone").startswith(_GATE))
    grid = F.expr(f"INTERVAL '{width}'")
    reach = F.expr(f"INTERVAL '{within}'")
    seen_at = gates.withColumn(
        "plan_time", F.explode(F.sequence(F.col("bucket") + grid, F.col("bucket") + reach + grid, grid))
    ).where(F.col("bucket") > F.col("plan_time") - reach)
    hits = seen_at.join(plans, "plan_time", "left_semi")
    return latest_per_key(
        hits, ["plan_time", "zone"], ["avg_density", "avg_flow_rate", "max_headcount"], ["bucket"]
    )


def gate_densities(latest: DataFrame, zones: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Density per gate: the greater of its newest bucket and its zone state.

    Either side may lack a gate; NULL counts as zero.
    """
    keys = keys or []
    state = zones.where(F.col("zone").startswith(_GATE)).select(*keys, "zone", "density")
    recent = latest.where(F.col("zone").startswith(_GATE))
    return recent.join(state, [*keys, "zone"], "full_outer").select(
        *keys,
        F.col("zone").alias("gate"),
        F.greatest(or_zero(F.col("avg_density")), or_zero(F.col("density"))).alias("avg_density"),
        or_zero(F.col("avg_flow_rate")).alias("avg_flow_rate"),
        F.coalesce("max_headcount", F.lit(0)).alias("max_headcount"),
    )


def blocked_gates(gates: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted list of blocked gates per key (at most as many as gates)."""
    return gates.groupBy(*keys).agg(
        F.sort_array(F.collect_set(F.when(is_blocked(F.col("avg_density")), F.col("gate")))).alias("blocked")
    )


def gate_hops(spark: SparkSession, corridors: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Hops from every zone to its nearest gate: the route search on corridors of
    length one in an empty venue. Depends on the venue only."""
    pairs = corridors if corridors is not None else venue.CORRIDORS
    graph = Graph(tuple((a, b, 1.0) for a, b, _ in pairs))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    found = search(venue.zones(spark).withColumn("densities", empty), "zone", graph)
    to_gates = [F.get(F.col("_cost"), F.lit(i)) for i, z in enumerate(graph.zones) if z.startswith(_GATE)]
    fallback = F.lit(venue.DEFAULT_HOPS)
    for zone, hops in venue.HOPS_WITHOUT_PATH.items():
        fallback = F.when(F.col("zone") == zone, F.lit(hops)).otherwise(fallback)
    nearest = F.array_min(F.array(*to_gates)) if to_gates else F.lit(None)
    reached = F.when(F.col("zone").startswith(_GATE), F.lit(0)).otherwise(nearest.cast("int"))
    return found.select("zone", F.coalesce(reached, fallback).alias("hops"))


def choose_gate(own: Column, blocked: Column) -> tuple[Column, Column]:
    """(gate, rerouted) from a zone's own gates and the blocked gates.

    The first open gate of its own; else the first open gate overall; else, with
    all gates blocked, its own first gate.
    """
    overall = F.array(*[F.lit(g) for g in venue.GATES_BY_PRIORITY])
    own = F.when(F.size(own) > 0, own).otherwise(overall)
    own_open = F.array_except(own, blocked)
    any_open = F.array_except(overall, blocked)
    gate = F.coalesce(F.get(own_open, F.lit(0)), F.get(any_open, F.lit(0)), F.get(own, F.lit(0)))
    return gate, F.size(own_open) == 0


def exit_plans(
    plans: DataFrame,
    densities: DataFrame,
    gates: DataFrame,
    match_end_minutes: float = 0.0,
) -> DataFrame:
    """Staggered exit windows for every plan time.

    ``plans``: plan_time. ``densities``: plan_time, zone, density. ``gates``:
    plan_time, gate, avg_density. One row per plan time and seating zone.
    """
    if not 0 <= match_end_minutes <= 120:
        raise ValueError("match end must be 0 to 120 minutes ahead")
    spark = plans.sparkSession
    seats = venue.seating(spark).join(gate_hops(spark), "zone").select(
        F.struct("seat_order", "zone", "own_gates", "hops").alias("seat")
    )
    # Six fixed rows, attached to each plan as one array: no join needed to pair them.
    listed = seats.agg(F.sort_array(F.collect_list("seat"))).first()[0]
    seat_array = F.array(
        *[
            F.struct(
                F.lit(s["seat_order"]).alias("seat_order"),
                F.lit(s["zone"]).alias("zone"),
                F.array(*[F.lit(g) for g in s["own_gates"]]).alias("own_gates"),
                F.lit(s["hops"]).alias("hops"),
            )
            for s in listed
        ]
    )
    gate, rerouted = choose_gate(F.col("own_gates"), F.col("blocked"))
    rows = (
        plans.join(blocked_gates(gates, ["plan_time"]), "plan_time", "left")
        .withColumn("blocked", F.coalesce("blocked", F.array().cast("array<string>")))
        .select("plan_time", "blocked", F.inline(seat_array))
        .join(densities.select("plan_time", "zone", "density"), ["plan_time", "zone"], "left")
        .withColumn("density", or_zero(F.col("density")))
        .withColumn("offset", exit_offset_minutes(F.col("hops"), F.col("density")))
    )
    match_end = plus_minutes(F.col("plan_time"), F.lit(match_end_minutes))
    start = plus_minutes(match_end, F.col("offset"))
    ranked = Window.partitionBy("plan_time").orderBy("departure_offset_minutes", "seat_order")
    return (
        rows.withColumns(
            {
                "recommended_gate": gate,
                "gate_was_rerouted": rerouted,
                "departure_offset_minutes": round_half_up(F.col("offset"), 2),
            }
        )
        .withColumn("priority", F.row_number().over(ranked))
        .select(
            "plan_time",
            match_end.alias("match_end"),
            "priority",
            "zone",
            "recommended_gate",
            "gate_was_rerouted",
            "departure_offset_minutes",
            start.alias("window_start"),
            plus_minutes(start, F.lit(EXIT_WINDOW_MINUTES)).alias("window_end"),
            round_half_up(F.col("density"), 4).alias("zone_density"),
            round_half_up(congestion_weight(F.col("density")), 4).alias("congestion_weight"),
            "blocked",
            F.when(
                F.col("gate_was_rerouted"),
                F.concat(
                    F.lit("Primary gate(s) blocked (density ≥ 90%). Rerouted to "),
                    "recommended_gate",
                    F.lit("."),
                ),
            ).alias("note"),
        )
    )
