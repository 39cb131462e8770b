"""Flow forecasts over runs: a run fires after every fifth reading and covers the
readings that were buffered at that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crowd import congestion_band, should_avoid
from ..functions.numbers import exact_sum, mean_of, round_half_up, small_exact_sum
from ..functions.text import path_text
from ..sources.venue import MAIN_SEATING
from .ordering import numbered
from .routes import VENUE, Graph, paths_towards, search_towards
from .smoothing import ALPHA, BLOCK, smooth

# A run every so many readings; readings kept after a run.
RUN_EVERY = 5
KEPT = 50

#: Blocks of runs in a task, where there are enough of them to keep all tasks busy.
BLOCKS_PER_TASK = 64


def run_members(
    readings: DataFrame,
    last_index: int,
    first_run: int = 1,
    every: int = RUN_EVERY,
    kept: int = KEPT,
    block: int = 256,
) -> DataFrame:
    """Readings (with ``index``) repeated for each run that covers them.

    Run r covers indexes in (every*r - every - kept, every*r]. Rows are partitioned
    by ``_block``, a series of consecutive runs: a reading is sent to its block
    once (twice at a border) and repeated for its runs only after the shuffle, and
    all grouping by run or zone inside a block needs no further shuffle.
    """
    spread = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, (last_index // every - first_run) // block + 1)
    index = F.col("index")
    first = F.greatest(F.ceil(index / every), F.lit(first_run))
    last = F.least(F.floor((index + kept + every - 1) / every), F.lit(last_index // every))
    placed = (
        readings.withColumns({"_first": first, "_last": last})
        .where("_first <= _last")
        .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))))
        .repartition(min(max(3 * spread, blocks // BLOCKS_PER_TASK), blocks), "_block")
    )
    low = F.greatest(F.col("_first"), F.col("_block") * block)
    high = F.least(F.col("_last"), F.col("_block") * block + (block - 1))
    return placed.withColumn("run", F.explode(F.sequence(low, high))).drop("_first", "_last")


def run_zone_means(members: DataFrame) -> DataFrame:
    """Mean density per run and zone, with where the zone first appeared in the run
    and when the run fired (the time of its newest reading)."""
    return (
        members.groupBy("_block", "run", "zone")
        .agg(
            small_exact_sum(F.col("density")).alias("total"),
            F.count("*").alias("n"),
            F.min("index").alias("appeared"),
            F.max_by("time", "index").alias("_seen"),
        )
        .select(
            "_block",
            "run",
            "zone",
            mean_of(F.col("total"), F.col("n")).alias("density"),
            "appeared",
            "_seen",
        )
    )


def flow_forecasts(
    readings: DataFrame,
    last_index: int,
    first_run: int = 1,
    start: DataFrame | None = None,
    every: int = RUN_EVERY,
    kept: int = KEPT,
    alpha: float = ALPHA,
    block: int | None = None,
    graph: Graph = VENUE,
    target: str = MAIN_SEATING,
    only_last: bool = False,
) -> DataFrame:
    """One forecast per run and zone; ``only_last``: of the last run.

    ``readings``: index, time, zone, density (:func:`ordering.numbered` adds the
    index). ``start`` holds ``smoothed`` per zone from earlier runs.
    """
    # Of a fixed size: values are composed block by block, and their bits follow the blocks.
    block = block or BLOCK
    members = run_members(readings.select("index", "time", "zone", "density"), last_index, first_run, every, kept, block)
    smoothed = smooth(run_zone_means(members), "zone", "run", "density", last_index // every, alpha, block, start)
    if only_last:
        smoothed = smoothed.where(F.col("run") == last_index // every)
    return describe_runs(smoothed, ["_block", "run"], graph, target).drop("_block")


def describe_runs(
    zones: DataFrame, keys: list[str], graph: Graph = VENUE, target: str = MAIN_SEATING
) -> DataFrame:
    """Bands, zones to avoid and routes from the zone densities of each run.

    ``zones``: keys, zone, density, smoothed, appeared, _seen. Also serves time
    snapshots in place of runs. A run has at most as many rows as buffered readings.
    """
    row = F.struct("appeared", "zone", "density", "smoothed")
    runs = zones.groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("zones"), F.max("_seen").alias("time")
    )
    listed = runs.withColumns(
        {
            "densities": F.map_from_entries(
                F.transform("zones", lambda z: F.struct(z["zone"], z["density"]))
            ),
            "_crowded": F.transform(
                F.filter("zones", lambda z: should_avoid(z["density"])), lambda z: z["zone"]
            ),
        }
    )
    # One search per run serves all its zones, and only runs go through Python.
    aimed = search_towards(listed, target, graph)
    each = aimed.select(*keys, "time", "_crowded", "_ways", F.inline("zones"))
    return paths_towards(each, "zone", target, graph).select(
        *keys,
        "time",
        "zone",
        round_half_up(F.col("density"), 4).alias("current_density"),
        round_half_up(F.col("smoothed"), 4).alias("predicted_density"),
        congestion_band(F.col("density")).alias("congestion_risk"),
        path_text(F.col("path")).alias("recommended_route"),
        F.array_remove("_crowded", F.col("zone")).alias("avoid_zones"),
        "smoothed",
    )


def forecast_history(crowd: DataFrame, order: tuple[str, ...] = ("time", "tie"), **options) -> DataFrame:
    """Forecasts of all runs over a table of crowd readings."""
    rows, last = numbered(crowd.select("time", "zone", "density", *[c for c in order if c != "time"]), list(order))
    return flow_forecasts(rows, last, **options)


def snapshot_forecasts(crowd: DataFrame, tick: str, alpha: float = ALPHA, graph: Graph = VENUE) -> DataFrame:
    """The same forecasts with time snapshots in place of count-based runs."""
    seconds = _seconds(crowd, tick)
    rows = crowd.withColumn("snapshot", F.window("time", tick)["start"])
    place = F.unix_seconds("snapshot")
    span = rows.agg(F.min(place).alias("low"), F.max(place).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    position = F.floor((place - low) / seconds)
    means = (
        rows.withColumn("run", position)
        .groupBy("snapshot", "run", "zone")
        .agg(
            exact_sum(F.col("density")).alias("total"),
            F.count("*").alias("n"),
            F.min(F.struct("time", "tie")).alias("appeared"),
            F.max("time").alias("_seen"),
        )
        .withColumn("density", mean_of(F.col("total"), F.col("n")))
        .drop("total", "n")
    )
    return describe_runs(
        smooth(means, "zone", "run", "density", (high - low) // seconds, alpha), ["snapshot", "run"], graph
    )


def latest_run_per_zone(forecasts: DataFrame, every: int = RUN_EVERY) -> DataFrame:
    """The last forecast of every zone and the index of the reading that fired it."""
    # The last run by a hash aggregate, then its rows by a join with a row per zone: a struct's max_by sorts all rows.
    ends = forecasts.groupBy("zone").agg(F.max("run").alias("run"))
    p = F.struct("congestion_risk", "predicted_density", "smoothed").alias("p")
    last = forecasts.join(F.broadcast(ends), ["zone", "run"]).select("zone", "run", p)
    return last.select("zone", "run", (F.col("run") * every).alias("fired_at"), "p.*")


def _seconds(df: DataFrame, tick: str) -> int:
    zero = "timestamp '1970-01-01 00:00:00'"
    return df.sparkSession.sql(f"SELECT unix_seconds({zero} + INTERVAL '{tick}') - unix_seconds({zero}) AS s").first()["s"]
