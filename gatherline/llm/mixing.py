"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, scaled by its quality weight: -ln(u) / weight
with u from a hash of the document, so that reruns agree. A source's target is complete
epochs of all its documents plus a fraction of one. For the fraction, documents are taken
in order of their keys until a prefix sum of their sizes reaches the budget.

The prefix sums are made in two steps, so that a large source is no single task: sizes
are summed by slices of the key, the running sum over slices finds the slice that holds
the end of the budget, and only that slice is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import SPACES, packed, words, written

WEIGHTS = (5, 2, 1)  # of sources in order, repeating
SHARE, MOST = 1.5, 2  # words mixed per word there is; epochs of a source at most
SLICES = 4096


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters, marks of writing and spaces aside, among a text's characters."""
    solid = F.translate(F.coalesce(text, F.lit("")), SPACES + ".,;:'\"-?!", "")
    letters = F.length(F.regexp_replace(solid, "[^\\p{L}]+", ""))
    return F.when(F.length(solid) == 0, F.lit(0.1)).otherwise(0.1 + 0.9 * letters / F.length(solid))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12) + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Sources in order of code points, NULL last, have the weights in turn and share ``share`` of
    all sizes by weight; a target above ``most`` times its source's size stops there, and the
    excess is shared by the others, by weight, until none is above.
    """
    ranked, _ = numbered(sources.withColumn("none", F.col("source").isNull()), ["none", "source"])
    turn = F.array([F.lit(float(w)) for w in weights])
    state = written(
        ranked.select(
            "source",
            "source_size",
            F.get(turn, (F.col("index") - 1) % len(weights)).alias("weight"),
            (most * F.col("source_size")).cast("double").alias("cap"),
        ),
        "sources",
    )
    total = share * (state.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1.0
    while level > before:  # rises until no further source is above; sums of two columns come back
        before = level
        full = F.col("cap") < F.lit(level) * F.col("weight")
        free = state.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not free["weight"]:
            break
        level = max(level, (total - free["used"]) / free["weight"])
    return state.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size, key) of each document, written to the shared folder.

    ``size`` counts words, ``key`` is the exponential key; NULL texts have size 0.
    """
    text = F.coalesce("text", F.lit(""))
    return written(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64("text").alias("text_key"),
            F.size(words("text")).cast("bigint").alias("size"),
            (-F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)) / quality_weight(F.col("text"))).alias("key"),
        ),
        "mix-keys",
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    slices: int = SLICES,
) -> DataFrame:
    """What a mix takes of each document of (doc_id, text, source, ...).

    Returns a row per row: doc_id, size (words), source_size, target (its source's), taken (words,
    repeats counted), epochs (how often it is taken), text_key. Complete epochs come first; of the
    last, fractional epoch a document is taken if more than half of it lies within the budget in
    the order of keys. A NULL source is a source of its own and comes last; NULL texts have size
    0; repeated rows draw one key and follow each other; a source without words has target 0;
    other columns are ignored; an empty table gives an empty one.
    """
    own = keyed(docs)
    sources = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = written(
        targets(sources, weights, share, most)
        .withColumn("full", full.cast("int"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumnRenamed("source", "s_source"),
        "mix-targets",
    )
    # Keys of documents of little weight are large, so slices widen with the key; with weights from 0.1 to 1
    # no slice has over six times its share, whatever the weights of a source.
    place = F.least(F.floor(F.col("key") / (1 + F.col("key")) * slices), F.lit(slices - 1)).cast("int")
    sliced = own.withColumn("slice", place)
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    of_source = F.col("source").eqNullSafe(F.col("s_source"))
    # The slice in which each source's budget ends, if it ends before the source does.
    ends = written(
        running.join(state, of_source)
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
        .select(F.col("source").alias("e_source"), F.col("slice").alias("e_slice"), "before"),
        "mix-ends",
    )
    placed = sliced.join(state, of_source).join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
    by_key = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "text_key")
    ahead = F.col("before") + F.sum("size").over(by_key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    columns = ["doc_id", "source", "text_key", "size", "source_size", "target", "full"]
    inside = placed.where(F.col("slice") == F.col("e_slice")).select(
        *columns, (ahead + F.col("size") / 2 < F.col("rest")).alias("more")
    )
    outside = placed.where(F.col("e_slice").isNull() | (F.col("slice") != F.col("e_slice"))).select(
        *columns, F.coalesce(F.col("slice") < F.col("e_slice"), F.col("rest") > 0).alias("more")
    )
    epochs = F.col("full") + F.col("more").cast("int")
    return inside.union(outside).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * epochs).alias("taken"),
        epochs.alias("epochs"),
        "source",
        "text_key",
    )


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs``, all columns kept, with each row as often as the mix takes it.

    Rows of one doc_id, source and text are alike, so what the mix takes of them together is
    shared out by their number.
    """
    mix = mixed(docs, weights, share, most)
    taken = mix.groupBy("doc_id", "source", "text_key").agg(F.sum("epochs").alias("m_all"), F.count("*").alias("m_rows"))
    taken = taken.where("m_all > 0").select(
        F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), F.col("text_key").alias("m_key"), "m_all", "m_rows"
    )
    same = (
        F.col("k_doc").eqNullSafe(F.col("m_doc"))
        & F.col("row.source").eqNullSafe(F.col("m_source"))
        & (F.col("k_key") == F.col("m_key"))
    )
    found = packed(docs).join(taken, same)
    alike = Window.partitionBy("m_doc", "m_source", "m_key").orderBy(F.lit(1))
    single = found.where("m_rows = 1").withColumn("times", F.col("m_all"))
    # Row i of n alike takes its part of the whole number.
    several = found.where("m_rows > 1").withColumn("i", F.row_number().over(alike))
    part = lambda i: F.floor(F.col("m_all") * i / F.col("m_rows"))
    several = several.withColumn("times", part(F.col("i")) - part(F.col("i") - 1))
    rows = single.select("row", "times").union(several.select("row", "times")).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
