"""Ordered computations over few, long histories.

A venue has a dozen zones and eight stands, so ``Window.partitionBy(stand)`` puts
a whole history into one task. That is the best plan while histories are short,
and no plan at all when one stand holds a third of 10^12 rows. Each operator here
therefore looks at the size of the largest group first (a count over the key
columns only) and beyond a limit works on contiguous pieces of the sort order:

* ``repartitionByRange`` cuts the order (key, time, tie) into pieces of equal
  size, whatever the key or time distribution; a running number as last sort key
  lets it cut even a long series of copies of one reading;
* windows run inside (piece, key);
* one row per (piece, key) is carried to the next piece, so that results are the
  same as those of the plain window.

The pieces are checkpointed, which fixes their boundaries for both readers (the
rows and the carried summary) even if executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

ROWS_PER_TASK = 4_000_000


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest group, all rows)."""
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    found = counts.agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    return found["largest"] or 0, found["all"] or 0


def _pieces(df: DataFrame, rows_per_task: int, rows: int) -> int:
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, spread, -(-rows // rows_per_task))


def _ranged(df: DataFrame, keys: list[str], order: list[str], pieces: int) -> DataFrame:
    """Rows with the number of their piece of the global sort order."""
    return (
        df.withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(pieces, *keys, *order, "_copy")
        .withColumn("_piece", F.spark_partition_id())
    )


def _joined_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which NULL keys are equal, as they are in a window."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return left.join(right, on, "left").drop(*[f"_r{k}" for k in keys])


def previous_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``previous`` and ``before_previous``: the one and two rows back.

    Both are structs with one field ``v``, NULL where there is no such row.
    """
    largest, rows = group_sizes(df, keys)
    wrapped = F.struct(F.col(value).alias("v"))
    if largest <= rows_per_task:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(
            {"previous": F.lag(wrapped, 1).over(w), "before_previous": F.lag(wrapped, 2).over(w)}
        )

    w = Window.partitionBy("_piece", *keys).orderBy(*order, "_copy")
    pieces = _ranged(df, keys, order, _pieces(df, rows_per_task, rows))
    inside = checkpointed(
        pieces.withColumns(
            {
                "previous": F.lag(wrapped, 1).over(w),
                "before_previous": F.lag(wrapped, 2).over(w),
                "_ends": F.lead(F.lit(1)).over(w).isNull(),
            }
        )
    )
    # The last two values of every (piece, key); a piece may hold only one row of a key.
    across = Window.partitionBy(*keys).orderBy("_piece")
    carried = (
        inside.where("_ends")
        .select("_piece", *keys, wrapped.alias("_last"), F.col("previous").alias("_second"))
        .select(
            "_piece",
            *keys,
            F.lag("_last", 1).over(across).alias("_before_1"),
            F.coalesce(F.lag("_second", 1).over(across), F.lag("_last", 2).over(across)).alias("_before_2"),
        )
    )
    filled = _joined_null_safe(inside, carried, ["_piece", *keys])
    first = F.col("previous").isNull()
    return filled.withColumns(
        {
            "before_previous": F.coalesce(
                "before_previous",
                F.when(first, F.col("_before_2")).otherwise(F.col("_before_1")),
            ),
            "previous": F.coalesce("previous", "_before_1"),
        }
    ).drop("_piece", "_copy", "_ends", "_before_1", "_before_2")


def carried_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``name``: the last non-NULL ``value`` at or before each row of its key."""
    largest, rows = group_sizes(df, keys)
    if largest <= rows_per_task:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))

    inside_key = Window.partitionBy("_piece", *keys).orderBy(*order, "_copy")
    pieces = _ranged(df, keys, order, _pieces(df, rows_per_task, rows))
    inside = checkpointed(
        pieces.withColumns(
            {
                name: F.last(value, ignorenulls=True).over(
                    inside_key.rowsBetween(Window.unboundedPreceding, 0)
                ),
                "_ends": F.lead(F.lit(1)).over(inside_key).isNull(),
            }
        )
    )
    across = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = inside.where("_ends").select(
        "_piece", *keys, F.last(name, ignorenulls=True).over(across).alias("_carried")
    )
    return (
        _joined_null_safe(inside, carried, ["_piece", *keys])
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_piece", "_copy", "_ends", "_carried")
    )


def numbered(df: DataFrame, order: list[str], start: int = 0) -> tuple[DataFrame, int]:
    """Add ``index`` (start+1, start+2, …) in global order; also return the last index.

    One range shuffle into pieces by the number of rows. Positions inside a piece come from the
    sorted partition, offsets from one count per piece, so no task sees more than its piece.
    """
    rows = df.count()
    placed = checkpointed(
        df.withColumn("_copy", F.monotonically_increasing_id())
        .repartitionByRange(_pieces(df, ROWS_PER_TASK, rows), *order, "_copy")
        .sortWithinPartitions(*order, "_copy")
        .drop("_copy")
        .withColumns(
            {
                "_piece": F.spark_partition_id(),
                "_position": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
            }
        )
    )
    sizes = placed.groupBy("_piece").agg(F.count("*").alias("n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # One row per piece: as many rows as shuffle partitions, in the window and the broadcast.
    offsets = sizes.select("_piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    numbered_rows = (
        placed.join(F.broadcast(offsets), "_piece")
        .withColumn("index", F.col("_offset") + F.col("_position") + F.lit(start + 1))
        .drop("_piece", "_position", "_offset")
    )
    return numbered_rows, start + rows
