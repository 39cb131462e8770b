"""SimHash near-duplicates by a positional byte index with count filtering.

A fingerprint has 64 bits, one per bit that is set in over half of the hashes of a
text's word shingles. Fingerprints that differ in at most ``bits`` bits share at least
``8 - bits`` of their eight bytes, each in its place: the guaranteed matches. The index has a
posting for every choice of one position fewer with the bytes found there (a posting of a
single byte would hold 1/256 of all fingerprints), so that a qualifying pair meets in
several postings, and others meet that fall short. Where a pair meets, its shared positional
bytes are tallied; pairs below the guaranteed matches are dropped, and the rest is verified
by the differing bits.

Only distinct fingerprints enter the index. Postings are sorted, and a task compares
blocks of fingerprints at once; a posting longer than a block goes on to tasks for pairs
of its blocks, so that no task holds more than two blocks. Of the links found a task
returns those that join something new, which leaves the groups of linked fingerprints
as they are. Groups are found by repeated star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import mapped, packed, sliced

SHINGLE, BITS = 4, 4
BLOCK = 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle, repeats included, of a text with A-Z in lower case."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]])
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)],
        np.uint64,
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Unsigned 64-bit majority of hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint): the 64-bit fingerprint of each document, as a signed number."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows):
            found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


def _choices(bits: int) -> list[tuple[int, ...]]:
    """The position sets of postings: one position fewer than a qualifying pair shares, one at least."""
    if bits > 7:
        raise ValueError("pairs of more than 7 differing bits need not share a byte")
    return list(combinations(range(8), max(1, 7 - bits)))


def postings(fps: DataFrame, bits: int) -> DataFrame:
    """(choice, shared, fp): one row per fingerprint and choice of positions."""
    masks = [sum(0xFF << (8 * p) for p in chosen) for chosen in _choices(bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    rows = F.array([F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for i, m in enumerate(signed)])
    return fps.select("fp", F.explode(rows).alias("at")).select("at.choice", "at.shared", "fp")


class Forest:
    """Joins seen by a task, so that it returns no link that joins nothing new."""

    def __init__(self, limit: int = 1 << 19):
        self.parent: dict[int, int] = {}
        self.limit = limit

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def new(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The pairs that join two trees."""
        if len(self.parent) > self.limit:  # forgetting only repeats links
            self.parent = {}
        out = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                out.append((a, b))
        return out


def tally(differ: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes are shared, from the differing bits."""
    return (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def near(differ: np.ndarray, bits: int) -> np.ndarray:
    """Which differences reach the guaranteed matches, and of those which have few enough differing bits."""
    enough = tally(differ) >= 8 - bits
    enough[enough] = np.bitwise_count(differ[enough]) <= bits
    return enough


def linked(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links that connect the values of ``left`` (or those of left and right) as all links would."""
    values = left if right is None else np.concatenate([left, right])
    label = np.arange(len(values))
    for i in range(len(left)):
        at = np.arange(i + 1, len(values)) if right is None else np.arange(len(left), len(values))
        at = at[label[at] != label[i]]  # joined already
        if len(at):
            hit = at[near(values[at] ^ values[i], bits)]
            if len(hit):
                groups = np.unique(label[hit])
                label[np.isin(label, groups)] = label[i]
    order = np.argsort(label, kind="stable")
    first = order[np.searchsorted(label[order], label)]
    return [(int(values[i]), int(values[f])) for i, f in enumerate(first.tolist()) if f != i]


FOUND = "a bigint, b bigint, choice int, shared bigint, block int"
_ARROW = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("choice", pa.int32()), ("shared", pa.int64()), ("block", pa.int32())]
)


def _emit(links: list[tuple[int, int]], further: list[tuple[int, int, int]] = ()) -> pa.RecordBatch:
    rows = [(a, b, None, None, None) for a, b in links] + [(None, None, *f) for f in further]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _signed(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [tuple(x - (1 << 64) if x >= 1 << 63 else x for x in pair) for pair in pairs]


def _compare(bits: int):
    """Links inside each group of rows (choice, shared, block, other, side, fp), which come sorted.

    Groups are equal in all but ``side`` and ``fp``; with sides 0 and 1 the links lie between
    them. Also returns a row for every block after a posting's first.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        rest: list[np.ndarray] | None = None

        def finish(columns: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal rest
            keys, side, fp = columns[:4], columns[4], columns[5].view(np.uint64)
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            if not last:  # the last group may go on
                rest = [c[starts[-1] :] for c in columns]
                starts, ends = starts[:-1], ends[:-1]
            sizes = ends - starts
            two = starts[sizes == 2]
            two = two[near(fp[two] ^ fp[two + 1], bits) & ((side[two] == 0) | (side[two] != side[two + 1]))]
            links = forest.new(list(zip(columns[5][two].tolist(), columns[5][two + 1].tolist(), strict=True)))
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                part, right = fp[s:e], side[s:e] == 1
                found = linked(part[~right], part[right], bits) if right.any() else linked(part, None, bits)
                links += forest.new(_signed(found))
            after = starts[(keys[2][starts] > 0) & (keys[3][starts] < 0)]
            return _emit(links, list(zip(*(k[after].tolist() for k in keys[:3]), strict=True)))

        for batch in rows:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            if rest is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(rest, columns, strict=True)]
            yield finish(columns, last=False)
        if rest is not None:
            yield finish(rest, last=True)

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints ``fps`` (column fp) that connect them as all links would."""
    keys = ["choice", "shared"]
    order = Window.partitionBy(*keys).orderBy("fp")
    blocks = postings(fps, bits).withColumn("block", F.floor((F.row_number().over(order) - 1) / block).cast("int"))
    sorted_keys = [*keys, "block", "other", "side"]
    first = checkpointed(
        blocks.select(*keys, "block", F.lit(-1).alias("other"), F.lit(0).alias("side"), "fp").mapInArrow(_compare(bits), FOUND)
    )
    found = first.where("a IS NOT NULL").select("a", "b")
    longest = first.where("a IS NULL").groupBy(*keys).agg(F.max("block").alias("last"))
    if longest.isEmpty():
        return found
    # Postings of several blocks: every block meets every other in a task of its own.
    spread = blocks.join(longest, keys).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("last")))).where("mate <> block")
    pairs = spread.select(
        *keys,
        F.least("block", "mate").alias("block"),
        F.greatest("block", "mate").alias("other"),
        (F.col("block") > F.col("mate")).cast("int").alias("side"),
        "fp",
    )
    across = pairs.repartition(*sorted_keys[:4]).sortWithinPartitions(*sorted_keys, "fp").mapInArrow(_compare(bits), FOUND)
    return found.union(across.where("a IS NOT NULL").select("a", "b"))


def groups(edges: DataFrame) -> DataFrame:
    """(member, root): the smallest member of each connected group of the edges (a, b).

    Alternates two steps until nothing changes: every node passes its smallest neighbour to its
    larger neighbours, then to its smaller ones. All state is checkpointed.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before, now = None, tuple(edges.agg(*sums).first())
    while now != before:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.where("u <> v").distinct()
        small = larger.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(
            larger.join(small, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small)
            .distinct()
        )
        before, now = now, tuple(edges.agg(*sums).first())
    return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))


def _grouped(placed: DataFrame, bits: int) -> DataFrame:
    """(fp, root): the smallest fingerprint linked to each fingerprint, through any number of links."""
    distinct = placed.select("fp").distinct()
    roots = checkpointed(groups(links(distinct, bits)))
    return distinct.join(roots.withColumnRenamed("member", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Fingerprint and group of every document of (doc_id, text, ...).

    Returns doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id among the
    documents reached by links of at most ``bits`` differing bits. A row per row: repeated rows
    are repeated and linked; a NULL, empty or blank text has fingerprint zero; a text with
    fewer words than ``shingle`` has one shingle; a NULL doc_id is never the smallest (a group
    of NULLs has a NULL component_id); other columns are ignored; an empty table gives an
    empty one.
    """
    placed = checkpointed(fingerprints(docs, shingle))
    smallest = placed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = checkpointed(smallest.join(_grouped(placed, bits), "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return placed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (NULLs last, then by text hash).

    Of repeated rows with that doc_id and text, one stays. All columns are kept.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(rows):
            found = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    narrow = keyed.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    placed = checkpointed(mapped(narrow, run, "doc_id bigint, text_key bigint, fp bigint"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = placed.groupBy("fp").agg(F.min(order).alias("best"))
    winners = best.join(_grouped(placed, bits), "fp").groupBy("root").agg(F.min("best").alias("best"))
    rows = placed.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_key") == F.col("w_key"))
    kept = winners.select(F.col("best.doc_id").alias("w_doc"), F.col("best.text_key").alias("w_key"))
    state = checkpointed(
        rows.join(kept, same, "left").select("doc_id", "text_key", F.col("w_key").isNotNull().alias("stays"), "copies")
    )
    of = F.col("k_doc").eqNullSafe(F.col("g_doc")) & (F.col("k_key") == F.col("g_key"))
    named = lambda rows: rows.select(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key"))
    # Rows that go are fewer than those that stay; winners with copies are looked at apart.
    rows = packed(docs)
    out = rows.join(named(state.where("NOT stays OR copies > 1")), of, "left_anti").select("row.*")
    repeated = named(state.where("stays AND copies > 1"))
    if repeated.isEmpty():
        return out
    again = rows.join(repeated, of, "left_semi").groupBy("k_doc", "k_key").agg(F.first("row").alias("row"))
    return out.unionByName(again.select("row.*"))
