"""Time-bucket aggregates of readings and queries over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_mean
from ..functions.times import at
from ..session import checkpointed

MINUTE = "1 minute"


def _bucket(width: str) -> Column:
    return F.window("time", width)


def crowd_buckets(crowd: DataFrame, width: str = MINUTE) -> DataFrame:
    """Mean density, highest headcount and mean flow per bucket and zone."""
    return (
        crowd.groupBy(_bucket(width).alias("w"), "zone")
        .agg(
            exact_mean(F.col("density")).alias("avg_density"),
            F.max("headcount").alias("max_headcount"),
            exact_mean(F.col("flow_rate")).alias("avg_flow_rate"),
        )
        .select(F.col("w.start").alias("bucket"), "zone", "avg_density", "max_headcount", "avg_flow_rate")
    )


def queue_buckets(queues: DataFrame, width: str = MINUTE) -> DataFrame:
    """Mean queue length, wait and fill per bucket and stand."""
    return (
        queues.groupBy(_bucket(width).alias("w"), "stand_id", "stand_name")
        .agg(
            F.avg("queue_length").alias("avg_queue_length"),
            exact_mean(F.col("wait_minutes")).alias("avg_wait_minutes"),
            exact_mean(F.col("capacity_pct")).alias("avg_capacity_pct"),
        )
        .select(
            F.col("w.start").alias("bucket"),
            "stand_id",
            "stand_name",
            "avg_queue_length",
            "avg_wait_minutes",
            "avg_capacity_pct",
        )
    )


def history(
    buckets: DataFrame, key: str, value: str, as_of: datetime, minutes: int = 30
) -> DataFrame:
    """Buckets of one key in the last ``minutes`` before ``as_of``, oldest first."""
    if not 5 <= minutes <= 1440:
        raise ValueError("minutes must be between 5 and 1440")
    wanted = F.upper(F.lit(value)) if key == "stand_id" else F.lit(value)
    since = at(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    within = (F.col("bucket") > since) & (F.col("bucket") <= at(as_of))
    return buckets.where((F.col(key) == wanted) & within).orderBy("bucket")


def readings_for_history(readings: DataFrame, as_of: datetime, minutes: int, width: str = MINUTE) -> DataFrame:
    """Readings that matter to :func:`history`: none after ``as_of``, and none too old for its
    buckets. Both bounds are on the raw time column, where a Parquet scan can use them."""
    reach = F.make_dt_interval(mins=F.lit(minutes)) + F.expr(f"INTERVAL '{width}'")
    return readings.where((F.col("time") > at(as_of) - reach) & (F.col("time") <= at(as_of)))


def refreshed_only(buckets: DataFrame, as_of: datetime, width: str = MINUTE) -> DataFrame:
    """Without the newest bucket, which a periodic refresh has not seen closed."""
    return buckets.where(F.col("bucket") + F.expr(f"INTERVAL '{width}'") <= at(as_of) - F.expr(f"INTERVAL '{width}'"))


def latest_bucket(buckets: DataFrame, key: str = "zone") -> DataFrame:
    """The newest bucket of every key."""
    rest = [c for c in buckets.columns if c != key]
    return buckets.groupBy(key).agg(F.max_by(F.struct(*rest), "bucket").alias("b")).select(key, "b.*")


def zone_means(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Mean density per zone over a set of readings, e.g. per snapshot."""
    return readings.groupBy(*keys, "zone").agg(exact_mean(F.col("density")).alias("density"))


# The reported percentiles.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


#: A range with so few values is ranked as it is; larger ones are narrowed first.
MOST_RANKED = 100_000
#: Splitters of a range, and how exactly they are placed: off by a ten-thousandth of the values in it.
SPLITTERS, ACCURACY = 500, 10_000


def order_statistics(values: DataFrame, keys: list[str], ranks: DataFrame, most: int = MOST_RANKED) -> DataFrame:
    """The values at given places of the order of each group: (keys, rank, v).

    ``values``: keys and a double ``v``, not NULL. ``ranks``: keys and ``rank``, from 0; each below the group's size.

    Selection by narrowing, without a sort of the whole: a round places splitters in every range that
    still holds more than ``most`` values, by a quantile sketch, and counts exactly what lies below and at
    the two around a rank. Either one of them is the value, or the rank lies between them, or (if a
    sketch was wrong) beyond. A range shrinks a hundred times per round; series of equal values
    end it. Only what is left in small ranges is sorted, range by range. Counts and sketches are combined
    before the shuffle, so hot groups are spread; nothing goes to the driver but the number of open ranges.
    """
    if not keys:
        whole = F.lit(0).alias("_all")
        return order_statistics(values.select(whole, "v"), ["_all"], ranks.select(whole, "rank"), most).drop("_all")
    names = [f"_k{i}" for i in range(len(keys))]
    on_keys = [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, keys, strict=True)]
    bounds = ["_low", "_high"]
    inside = (F.col("_low").isNull() | (F.col("v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("v") < F.col("_high")))

    def within(ranges: DataFrame) -> DataFrame:
        """The values that lie in open ranges (keys, _low, _high), with their range."""
        renamed = ranges.withColumnsRenamed(dict(zip(keys, names, strict=True)))
        return renamed.join(values, [*on_keys, inside], "inner").drop(*keys).withColumnsRenamed(dict(zip(names, keys, strict=True)))

    def same_range(left: DataFrame, right: DataFrame) -> DataFrame:
        other = {c: f"_r{c}" for c in [*keys, *bounds]}
        renamed = right.withColumnsRenamed(other)
        return left.join(renamed, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()]).drop(*other.values())

    sizes = values.groupBy(*keys).agg(F.count("*").alias("_inside"))
    sized = sizes.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    asked = ranks.distinct().join(sized, on_keys).drop(*names)
    none = F.lit(None).cast("double")
    state = checkpointed(
        asked.select(*keys, "rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("long").alias("_below"), "_inside", none.alias("v"))
    )
    open_ranges = F.col("v").isNull() & (F.col("_inside") > most)
    while state.where(open_ranges).limit(1).count():
        wide = state.where(open_ranges).drop("v")
        splitters = within(wide.select(*keys, *bounds).distinct()).groupBy(*keys, *bounds).agg(
            F.percentile_approx("v", [i / SPLITTERS for i in range(SPLITTERS + 1)], ACCURACY).alias("_s")
        )
        place = F.floor((F.col("rank") - F.col("_below")) / F.col("_inside") * SPLITTERS).cast("int")
        aimed = same_range(wide, splitters).select(
            *wide.columns,
            F.get("_s", F.greatest(place - 1, F.lit(0))).alias("_from"),
            F.get("_s", F.least(place + 2, F.lit(SPLITTERS))).alias("_to"),
        )
        counted = within(aimed).groupBy(*keys, "rank", *bounds, "_below", "_from", "_to").agg(
            F.count("*").alias("_inside"),
            *[F.count_if(test).alias(n) for n, test in (
                ("_under", F.col("v") < F.col("_from")), ("_until", F.col("v") <= F.col("_from")),
                ("_before", F.col("v") < F.col("_to")), ("_through", F.col("v") <= F.col("_to")),
            )],
        )
        at = F.col("rank") - F.col("_below")
        found = F.when((at >= F.col("_under")) & (at < F.col("_until")), F.col("_from")).when(
            (at >= F.col("_before")) & (at < F.col("_through")), F.col("_to")
        )
        left, right = at < F.col("_under"), at >= F.col("_through")
        narrowed = counted.select(
            *keys,
            "rank",
            F.when(left, F.col("_low")).when(right, F.col("_to")).otherwise(F.col("_from")).alias("_low"),
            F.when(left, F.col("_from")).when(right, F.col("_high")).otherwise(F.col("_to")).alias("_high"),
            (F.col("_below") + F.when(left, F.lit(0)).when(right, F.col("_through")).otherwise(F.col("_until"))).alias("_below"),
            F.when(left, F.col("_under"))
            .when(right, F.col("_inside") - F.col("_through"))
            .otherwise(F.col("_before") - F.col("_until"))
            .alias("_inside"),
            found.alias("v"),
        )
        state = checkpointed(state.where(~open_ranges).unionByName(narrowed))

    rest = state.where("v IS NULL").drop("v")
    order = Window.partitionBy(*keys, *bounds).orderBy("v")
    ranked = within(rest.select(*keys, *bounds).distinct()).withColumn("_place", F.row_number().over(order) - 1)
    picked = same_range(rest, ranked.withColumnRenamed("v", "_v")).where(F.col("_place") == F.col("rank") - F.col("_below"))
    return state.where("v IS NOT NULL").select(*keys, "rank", "v").unionByName(picked.select(*keys, "rank", F.col("_v").alias("v")))


def latency_report(df: DataFrame, latency: str, keys: list[str], most: int = MOST_RANKED) -> DataFrame:
    """p50, p95 and p99 with linear interpolation between the two values next to each, exact at any size.

    ``most``: values that are sorted together (see :func:`order_statistics`).
    """
    known = df.where(F.col(latency).isNotNull()).select(*keys, F.col(latency).cast("double").alias("v"))
    listed = F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(p).alias("_p")) for n, p in PERCENTILES.items()])
    exact = F.col("_p") * (F.col("_n") - 1)
    low = F.floor(exact)
    wanted = (
        known.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, "_n", F.inline(listed))
        .select(*keys, "_name", F.inline(F.array(
            F.struct(low.alias("rank"), (1 - (exact - low)).alias("_share")),
            F.struct((low + 1).alias("rank"), (exact - low).alias("_share")),
        )))
        .where("_share > 0")
    )
    found = order_statistics(known, keys, wanted.select(*keys, "rank"), most).withColumnsRenamed({k: f"_r{k}" for k in [*keys, "rank"]})
    both = wanted.join(found, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in [*keys, "rank"]])
    return both.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_name") == n, F.col("v") * F.col("_share"))).alias(n) for n in PERCENTILES]
    )
