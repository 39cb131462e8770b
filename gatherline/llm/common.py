"""Small helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

T = TypeVar("T")
#: Words are runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch between Spark and Python, where the session doesn't set its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words(text: Column | str) -> Column:
    """The ASCII-space separated words of a text as an array; NULL and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )


def in_fold(doc_id: str, folds: int, held_out: int) -> Column:
    """Whether a document is held out; a NULL id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held_out, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], folds: int, held_out: int
) -> tuple[list[str], np.ndarray, float]:
    """(texts, labels 0/1, share of label 1) of documents to learn from.

    At most ``per_class`` labelled ids of the classes 0 and 1, those with the smallest hashes, outside the
    held-out fold; ids labelled both ways count for both. The share is that of all labels outside
    the fold. The sample is bounded, so it may go to the driver.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.col(label).alias("y")).where(
        F.col("l_id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold("l_id", folds, held_out)
    )
    rank = F.xxhash64("l_id", F.lit(label))
    chosen = [usable.where(F.col("y") == y).distinct().orderBy(rank, "l_id").limit(per_class[y]) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("l_id"))
    # A repeated document teaches once.
    found = rows.groupBy("doc_id", "y").agg(F.max("text").alias("text")).orderBy("doc_id", "y").toArrow()
    counts = usable.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    share = ((counts["ones"] or 0) + 1) / (counts["n"] + 2)
    return [t or "" for t in found["text"].to_pylist()], found["y"].to_numpy().astype(np.float64), share


def sliced(rows: Iterator[pa.RecordBatch], at: int = 1, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes in the texts of column ``at``, or one longer text."""
    for batch in rows:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def batches(rows: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[list[list]]:
    """Columns of slices of the batches, each with about ``size`` bytes in its second column."""
    for part in sliced(rows, 1, size):
        yield [c.to_pylist() for c in part.columns]


def release_memory() -> None:
    """Give back what is no longer used, on the driver or in a Python worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


#: What a Python worker keeps from task to task: one thing, by name.
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once in a Python worker as long as its tasks ask for this name."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def keep_only(name: str | None) -> None:
    """Drop what tasks of another name kept in this worker. (A function of the module: what tasks carry are copies.)"""
    if _kept and name not in _kept:
        _kept.clear()
        release_memory()


def mapped(
    docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str | None = None
) -> DataFrame:
    """``docs.mapInArrow(run, schema)`` for whole texts: in small batches, and a task's memory goes back when it ends.

    Python workers outlive their tasks, and Spark's own limit of a batch is 64 MB, so that
    executors would hold several times that for every core, stage after stage. ``keeps`` names
    what the tasks keep (see :func:`kept`); what tasks of another name kept goes first.
    """
    conf = docs.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        try:
            yield from run(rows)
        finally:
            release_memory()

    return docs.mapInArrow(released, schema)


def packed(docs: DataFrame) -> DataFrame:
    """(row, k_doc, k_key): whole rows with their id and text hash, safe from clashing column names."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("k_doc"), F.xxhash64("text").alias("k_key"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut and its size is known."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
