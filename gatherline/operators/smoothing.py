"""Exponential smoothing of long series with few keys.

One smoothing step is an affine map, s -> (1 - alpha) s + alpha x, and affine maps
compose. A series is cut into blocks of consecutive positions; each block is
composed to one map, the maps of a key are scanned, and every block is expanded
from the value it starts with. With few keys the scan itself may be long, so it is
cut into blocks again until one block per key is left. No task ever holds more
than one block of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

# Fixed value.
ALPHA = 0.3

BLOCK = 128


def _step(s: Column, i: Column) -> Column:
    """Value after map ``i``. ``s`` is NULL where the series starts with this map."""
    return F.when(s.isNull(), i["alone"]).otherwise(i["slope"] * s + i["shift"])


def _running(items: Column, start: Column) -> Column:
    """Values before each item, as an array; where a series starts, its first value."""
    grown = F.aggregate(
        items,
        F.struct(start.alias("s"), F.array().cast("array<double>").alias("before")),
        lambda acc, i: F.struct(
            _step(acc["s"], i).alias("s"),
            F.concat(acc["before"], F.array(acc["s"])).alias("before"),
        ),
    )
    return grown["before"]


def _start_values(maps: DataFrame, key: str, last: int, block: int) -> DataFrame:
    """Value each map of a key starts from; NULL for the first map of the key.

    Input: key, position, slope, shift, alone (the value after this map if the
    series starts with it). Output: key, position, start.
    """
    item = F.struct("position", "slope", "shift", "alone")
    none = F.lit(None).cast("double")
    if last < block:
        grouped = maps.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items")).withColumn("start", none)
    else:
        blocks = (
            maps.withColumn("_block", F.floor(F.col("position") / block))
            .groupBy(key, "_block")
            .agg(F.sort_array(F.collect_list(item)).alias("items"))
        )
        upper = _start_values(
            _composed(blocks, key).withColumnRenamed("_block", "position"), key, last // block, block
        )
        grouped = blocks.join(upper.withColumnRenamed("position", "_block"), [key, "_block"])
    return (
        grouped.withColumn("starts", _running(F.col("items"), F.col("start")))
        .select(key, F.inline(F.arrays_zip("items", "starts")))
        .select(key, F.col("items.position").alias("position"), F.col("starts").alias("start"))
    )


def _composed(grouped: DataFrame, key: str) -> DataFrame:
    """One map per (key, block) from its ``items``.

    ``alone`` is computed step by step, so the first block of a series has exactly
    the values of a sequential run; later blocks may differ in the last bit.
    """
    items = F.col("items")
    return grouped.select(
        key,
        "_block",
        F.aggregate(items, F.lit(1.0), lambda a, i: a * i["slope"]).alias("slope"),
        F.aggregate(items, F.lit(0.0), lambda s, i: i["slope"] * s + i["shift"]).alias("shift"),
        F.aggregate(items, F.lit(None).cast("double"), _step).alias("alone"),
    )


def smooth(
    df: DataFrame,
    key: str,
    position: str,
    value: str,
    last: int,
    alpha: float = ALPHA,
    block: int = BLOCK,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add ``smoothed``: s = alpha x + (1 - alpha) s of the position before.

    ``position`` counts within the whole series, at most once per key, up to
    ``last``; a block has few keys. A series starts with its own first value, or, where ``start`` has a
    row for its key, with that ``smoothed`` value. The result also has ``_block``,
    by which it is partitioned together with the key.
    """
    rest = [c for c in df.columns if c not in (key, "_block")]
    slope, shift = F.lit(1 - alpha), alpha * F.col(value)
    item = F.struct(
        F.col(position).alias("position"),
        slope.alias("slope"),
        shift.alias("shift"),
        # A series starts as if its first value had been there before.
        (slope * F.col(value) + shift).alias("alone"),
        F.struct(*rest).alias("row"),
    )
    # Blocks may be given by the caller, to line up with how the rows are partitioned.
    rows = df if "_block" in df.columns else df.withColumn("_block", F.floor(F.col(position) / block))
    grouped = rows.groupBy("_block", key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    # A row per block and key, which every level of the scan reads: without the checkpoint each made all blocks anew.
    maps = checkpointed(_composed(grouped, key).withColumnRenamed("_block", "position"))
    if start is None:
        starts = _start_values(maps, key, last // block, block)
    else:
        given = start.select(key, F.col("smoothed").alias("_given"))
        continued = F.coalesce(F.col("slope") * F.col("_given") + F.col("shift"), "alone")
        maps = maps.join(given, key, "left").withColumn("alone", continued).drop("_given")
        starts = (
            _start_values(maps, key, last // block, block)
            .join(given, key, "left")
            .withColumn("start", F.coalesce("start", "_given"))
            .drop("_given")
        )
    out = F.transform(
        F.arrays_zip("items", "before"),
        lambda z: F.struct(
            *[z["items"]["row"][c].alias(c) for c in rest],
            _step(z["before"], z["items"]).alias("smoothed"),
        ),
    )
    # By block alone, as the rows may be partitioned already: the few starts move, not the rows. A NULL key has none.
    known = starts.where(F.col(key).isNotNull()).groupBy(F.col("position").alias("_block")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, "start"))).alias("_starts")
    )
    return (
        grouped.where(F.col(key).isNotNull())
        .join(known, "_block")
        .withColumn("before", _running(F.col("items"), F.col("_starts")[F.col(key)]))
        .select("_block", key, F.inline(out))
    )
