"""Winnowed fingerprints of documents.

The k-grams of a text's code points are hashed with a rolling polynomial hash. Of every
window of consecutive k-grams the one with the smallest hash is kept, the rightmost of
equal ones, with its position. Two texts that share ``gram + window - 1`` code points
share a kept k-gram, and nothing shorter than ``gram`` can match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
GRAM, WINDOW = 20, 32
PIECE = 1 << 20  # k-grams hashed at once
PIECE_BYTES = 64 << 20  # of texts that a task takes, about
LOW = (1 << 24) - 1  # a hash has 40 bits; the rest hold its place in a piece

SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_kept bigint"
)

_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of B and of its inverse modulo 2^64, ``n`` at least; kept by the worker."""
    if not _tables or len(_tables[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        start = np.ones(1, np.uint64)
        _tables[:] = [
            np.multiply.accumulate(np.concatenate([start, np.full(n, f, np.uint64)]), dtype=np.uint64)
            for f in (BASE, inverse)
        ]
    return _tables[0], _tables[1]


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """40-bit hash of every k-gram: sum of c[i+j] * B^j modulo 2^64, mixed.

    The sums roll: each is a difference of the running sum of c[i] * B^i, brought back to
    the same power by B's inverse.
    """
    power, back = _powers(len(points))
    running = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=running[1:])
    out = running[gram:] - running[:-gram]
    out *= back[: len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(MIX)
    return out >> np.uint64(24)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending positions) kept of a text: the rightmost minimum of each window.

    A text shorter than ``gram`` is one gram, one with fewer grams than ``window`` one window;
    an empty or NULL text keeps nothing. Long texts go in pieces that overlap by a window.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    gram = min(gram, len(points))
    n = len(points) - gram + 1
    window = min(window, n)
    hashes, places = [], []
    for start in range(0, n - window + 1, PIECE):
        size = min(PIECE, n - window + 1 - start) + window - 1
        best = gram_hashes(points[start : start + size + gram - 1], gram) << np.uint64(24)
        best |= np.uint64(LOW) - np.arange(size, dtype=np.uint64)  # of equal hashes the last is smallest
        span = 1
        while span < window:
            step = min(span, window - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        best = best[np.flatnonzero(best[1:] != best[:-1])].tolist() + [int(best[-1])]
        kept = np.array(best, np.uint64)
        hashes.append(kept >> np.uint64(24))
        places.append(start + LOW - (kept & np.uint64(LOW)).astype(np.int64))
    at = np.concatenate(places)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return np.concatenate(hashes)[new], at[new]


def digest(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex digest of the kept hashes and positions; equal for equal texts."""
    hashes, at = kept
    return hashlib.sha256(hashes.astype("<u8").tobytes() + at.astype("<u8").tobytes()).hexdigest()[:32]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes (distinct values each); 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """The kept hashes and positions of each document's whole text.

    Returns (doc_id, hashes array<bigint>, positions array<bigint>), a row per row; empty and
    NULL texts keep nothing; other columns are ignored.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kept = [winnow(t, gram, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "hashes": pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())),
                    "positions": pa.array([p for _, p in kept], pa.list_(pa.int64())),
                }
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, hashes array<bigint>, positions array<bigint>"
    )


def in_order(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece, ghost, doc_id, text) by descending doc_id, sorted within partitions.

    The order is cut into pieces at borders found from the id column alone. The first document
    of each piece is also put after the piece before it (the very first after the last) as a
    ghost, so that every document's successor is the next row of its piece, and texts are
    shuffled once. Rows of one id stay in one piece, larger texts first; NULLs come last.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shares = [i / pieces for i in range(1, pieces)]
    borders = rows.stat.approxQuantile("doc_id", shares, 0.25 / pieces) if shares else []
    above = F.array([F.lit(b) for b in sorted({int(b) for b in borders})] or [F.lit(0).cast("bigint")])
    piece = F.when(F.col("doc_id").isNull(), pieces + 1).otherwise(F.size(F.filter(above, lambda b: b >= F.col("doc_id"))))
    if not borders:
        piece = F.lit(0)
    placed = rows.withColumn("piece", piece)
    firsts = placed.groupBy("piece").agg(F.max("doc_id").alias("first"))
    # A row per piece: small for one task and for a broadcast, whatever the input.
    links = firsts.select(
        "piece",
        "first",
        F.coalesce(F.lag("piece").over(Window.orderBy("piece")), F.max("piece").over(Window.partitionBy())).alias("before"),
    )
    own = F.struct(F.col("piece"), F.lit(False).alias("ghost"))
    after = F.struct(F.col("before").alias("piece"), F.lit(True).alias("ghost"))
    return (
        placed.join(F.broadcast(links), "piece")
        .withColumn("at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, after)).otherwise(F.array(own))))
        .select("at.piece", "at.ghost", "doc_id", "text")
        .repartition(F.col("piece"))
        .sortWithinPartitions("piece", "ghost", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    )


def compare_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each document, of an edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, by descending doc_id; after the last comes the first. A sole
    document follows itself. ``fingerprint`` is a digest of kept hashes and positions; likeness
    is that of the sets of kept hashes. NULL texts count as empty, two empty ones as alike;
    NULL ids come last; repeated rows are repeated and follow each other; other columns are
    ignored; an empty table gives an empty one.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    pieces = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE_BYTES))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held: tuple | None = None  # the last row, which waits for its successor

        def pair(text: str, kept: tuple, following: str, next_set: np.ndarray, doc_id: int | None) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            other = winnow(edited, gram, window)
            own = np.unique(kept[0])
            return (
                doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(kept), digest(other),
                likeness(own, np.unique(other[0])), likeness(own, next_set), len(kept[0]),
            )

        for batch in rows:
            for piece, ghost, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ghost and (held is None or held[0] != piece or held[1]):
                    continue  # a further copy of the ghost
                kept = winnow(text, gram, window)
                if held is not None and held[0] == piece:
                    done.append(pair(held[3], held[4], text or "", np.unique(kept[0]), held[2]))
                held = (piece, ghost, doc_id, text or "", kept)
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], names=NAMES
                )
                done = []

    return in_order(docs, pieces).mapInArrow(run, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
