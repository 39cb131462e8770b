"""Hard negatives by segment summary filtering.

A vector is cut into segments; the sum of a segment and its deviation (the length of the
segment less its mean) are stored for every segment of every level: one segment, two, four,
and so on. Two segments of m components with sums S, T and deviations d, e have an inner
product of S*T/m within d*e, so the levels bound a score ever closer. A pair of an anchor and
a row goes on to the next level only while its bounds allow a row that counts, and is scored
exactly after the last.

The anchors are a stated query set. They go through all rows in blocks of a bounded number:
a block is broadcast, each task keeps the few best rows of every anchor, and those of all
tasks are ranked. What must be beaten rises as a task's rows go by. Rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ANCHORS = 20_000  # of a block; times the components it bounds what is broadcast
SCALE, EVERY, POSITIVES, NEGATIVES, LEAST_PERCENT = 256, 100, 5, 5, 80
PAIRS = 1 << 18  # of anchors and rows looked at together
LEVELS = (1, 2, 4, 8, 16)
LARGEST = 1 << 62
_EXACT = float(1 << 52)


def moved_label(vec_id: Column, label: Column) -> Column:
    """The label, moved on by one of ten where the id is divisible by 7."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows with an id, a label and a vector of finite components, as whole numbers of 1/``scale``."""
    vec_id, label, v = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(vec_id.isNotNull() & label.isNotNull() & v.isNotNull() & finite)
    return rows.select(
        vec_id.alias("vec_id"),
        moved_label(vec_id, label).alias("label"),
        F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"),
    )


class Summaries:
    """Vectors (a row each, whole numbers, shorter ones filled with zeros) with sums and deviations of their segments."""

    def __init__(self, vectors: np.ndarray):
        self.exact, n = vectors, vectors.shape[1]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for parts in LEVELS:
            if parts > 1 and parts * 2 > n:
                break
            borders = np.arange(parts + 1) * n // parts
            root = np.sqrt(np.maximum(np.diff(borders), 1))
            means = np.add.reduceat(vectors, borders[:-1], axis=1) / root if n else np.zeros((len(vectors), 1))
            squares = np.add.reduceat(vectors * vectors, borders[:-1], axis=1) if n else np.zeros((len(vectors), 1))
            self.levels.append((means, np.sqrt(np.maximum(squares - means * means, 0))))

    def __len__(self) -> int:
        return len(self.exact)


def _matrix(offsets: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = values[a : a + min(b - a, width)]
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, offsets, components) of a batch of (vec_id, label, v)."""
    v = batch.column(2)
    return (
        batch.column(0).to_numpy(zero_copy_only=False),
        batch.column(1).to_numpy(zero_copy_only=False),
        v.offsets.to_numpy().astype(np.int64),
        v.values.to_numpy(zero_copy_only=False),
    )


def possible(anchors: Summaries, rows: Summaries, low: np.ndarray, high: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose score may lie from ``low`` to ``high`` of the anchor, of those that ``counts`` marks."""
    a, r = np.nonzero(counts)
    for (am, ad), (rm, rd) in zip(anchors.levels, rows.levels, strict=True):
        if not len(a):
            break
        if am.shape[1] == 1:
            middle, reach = am[a, 0] * rm[r, 0], ad[a, 0] * rd[r, 0]
        else:
            middle, reach = np.einsum("ij,ij->i", am[a], rm[r]), np.einsum("ij,ij->i", ad[a], rd[r])
        slack = 0.5 + 1e-9 * (np.abs(middle) + reach)  # scores are whole, sums of doubles are not
        keep = (middle + reach + slack >= low[a]) & (middle - reach - slack <= high[a])
        a, r = a[keep], r[keep]
    return a, r


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers as 64-bit integers; beyond 2**62 they stay there."""
    if not len(left):
        return np.zeros(0, np.int64)
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1) < _EXACT:
        return np.einsum("ij,ij->i", left, right).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(left.tolist(), right.tolist(), strict=True)]
    return np.array([min(max(x, -LARGEST), LARGEST) for x in whole], np.int64)


class Best:
    """The best ``most`` (score, id) of every slot so far, and the score a slot's rows must reach."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, vec_id = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, vec_id)))
        order = np.lexsort((vec_id, -score, slot))
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        keep = place < self.most
        self.slot, self.score, self.id = slot[keep], score[keep], vec_id[keep]
        last = place == self.most - 1
        self.least[slot[last]] = score[last]


def _scan(rows: Iterator[pa.RecordBatch], vectors: np.ndarray, best: Best, wanted, found) -> None:
    """All batches against the anchors ``vectors``: ``wanted(ids, labels)`` marks the pairs that count and gives the
    scores they need (low, high); ``found(anchor, score, id)`` takes what was scored."""
    anchors = Summaries(vectors)
    for batch in rows:
        ids, labels, offsets, values = _read(batch)
        step = max(1, PAIRS // max(len(anchors), 1))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            block = Summaries(_matrix(offsets[start : start + step + 1], values, vectors.shape[1]))
            counts, low, high = wanted(ids[part], labels[part])
            a, r = possible(anchors, block, low, high, counts)
            found(a, exact_scores(anchors.exact[a], block.exact[r]), ids[part][r])


def _top(spark, rows: DataFrame, anchors: dict, most: int) -> DataFrame:
    """(slot, score, id): a task's best rows of the label of each anchor, but for rows of the anchor's id."""
    shared = spark.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = Best(len(asked["id"]), most)
        high = np.full(len(asked["id"]), np.inf)

        def wanted(ids, labels):
            return (asked["label"][:, None] == labels) & (asked["id"][:, None] != ids), best.least, high

        _scan(batches, asked["vectors"], best, wanted, best.add)
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], names=["slot", "score", "id"])

    return rows.mapInArrow(run, "slot bigint, score bigint, id bigint")


def _within(spark, rows: DataFrame, anchors: dict, pairs: dict, most: int, percent: int) -> DataFrame:
    """(slot, score, id): a task's best rows of another label for each (anchor, positive), in the range of its score."""
    shared = spark.sparkContext.broadcast((anchors, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ranges = shared.value
        n, owner, top = len(asked["id"]), ranges["anchor"], ranges["score"]
        floor = -(-percent * top // 100)  # the least whole score in the range
        best = Best(len(owner), most)
        high = np.full(n, -np.inf)
        np.maximum.at(high, owner, top)

        def wanted(ids, labels):
            low = np.full(n, np.inf)
            np.minimum.at(low, owner, np.maximum(floor, best.least))
            return asked["label"][:, None] != labels, low, high

        starts = np.searchsorted(owner, np.arange(n + 1))  # the pairs of an anchor follow each other

        def found(a, score, ids):
            size = np.diff(starts)[a]
            slot = np.repeat(starts[a] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(a) else a
            score, ids = np.repeat(score, size), np.repeat(ids, size)
            keep = (score >= floor[slot]) & (score <= top[slot]) & (score >= best.least[slot])
            best.add(slot[keep], score[keep], ids[keep])

        _scan(batches, asked["vectors"], best, wanted, found)
        yield pa.RecordBatch.from_arrays([pa.array(best.slot), pa.array(best.score), pa.array(best.id)], names=["slot", "score", "id"])

    return rows.mapInArrow(run, "slot bigint, score bigint, id bigint")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best ``most`` of each slot of all tasks, with their rank from 1."""
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    scale: int = SCALE,
    block: int = ANCHORS,
) -> DataFrame:
    """Hard negatives of the anchors among all vectors of (vec_id, embedding, label, ...).

    Components become floor(``scale`` * x); a score is the inner product of two vectors, and higher
    scores come first, ties by smaller vec_id. Anchors are rows whose vec_id is divisible by ``every``,
    with the first ``positives`` other rows of their label. For each anchor and positive: the first
    ``negatives`` rows of another label that score from ``least_percent`` percent of the positive's score
    to all of it. Labels of ids divisible by 7 are moved on by one of ten first.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a NULL
    id, label or vector, or a NULL or non-finite component, take no part. Rows of the anchor's id are
    not "other" rows. Repeated rows count as often as they stand there; an anchor row that is repeated as
    a whole asks once, anchors that share an id but no row ask each for themselves. Components beyond a
    vector's end are zeros. Scores beyond 2**62 stay there. Other columns are ignored; an empty table, or
    one without anchors, gives an empty result. ``block``: anchors that are broadcast together.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale)
    asked = written(
        rows.where(F.col("vec_id") % every == 0).distinct().withColumn("h", F.xxhash64("vec_id", "label", "v")), "anchors"
    )
    blocks = max(1, -(-asked.count() // block))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    parts = []
    for i in range(blocks):
        found = asked.where(F.pmod("h", F.lit(blocks)) == i).orderBy("vec_id", "label", "v").toArrow()
        if not found.num_rows:
            continue
        ids, labels, offsets, values = _read(found.select(["vec_id", "label", "v"]).combine_chunks().to_batches()[0])
        width = int(np.diff(offsets).max(initial=0))
        anchors = {"id": ids, "label": labels, "vectors": _matrix(offsets, values, width)}
        top = _ranked(_top(spark, rows, anchors, positives), positives).orderBy("slot", "rank").toArrow()
        pairs = {"anchor": top["slot"].to_numpy(), "id": top["id"].to_numpy(), "score": top["score"].to_numpy()}
        if not len(pairs["id"]):
            continue
        names = spark.createDataFrame(
            pa.table({"slot": np.arange(len(pairs["id"])), "anchor_id": ids[pairs["anchor"]], "positive_id": pairs["id"], "positive_score": pairs["score"]})
        )
        near = _ranked(_within(spark, rows, anchors, pairs, negatives, least_percent), negatives)
        parts.append(
            near.join(F.broadcast(names), "slot").select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            )
        )
        if blocks > 1:
            parts[-1] = written(parts[-1], "negatives")
    result = parts[0] if parts else spark.createDataFrame([], out)
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


#: The query over the sample tables, pair by pair.
SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
anchors AS (SELECT DISTINCT vec_id, label, v FROM kept WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, k.vec_id, k.label,
         list_inner_product(a.v, k.v)::BIGINT AS score
  FROM anchors a JOIN kept k ON k.vec_id <> a.vec_id
),
positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
        FROM scored WHERE label = anchor_label)
  WHERE place <= 5
),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""
