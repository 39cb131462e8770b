"""Repair of conversation structure by divide and conquer over edit costs.

A row is kept, given another role, or deleted; rows without text can be inserted. The role
initials that remain have to be an optional system turn and pairs of user and assistant, so
that four states tell all: nothing yet, after a system, a user, an assistant turn. What a row
does is a table, from state to state, of the least cost and of the place of its edits among
those from the same state; tables of several rows compose. Costs to reach a row's states
come forward, costs to get on from them backward; where they meet, in the middle, the
optimal state whose edits come first in ASCII order is where the repair crosses, and both
halves are solved alike. No edits but the answer are ever stored.

Places are enough to compare: edits that end with a row's own edit are never the beginning
of others that have consumed the same rows, so that a first difference decides.

Rows are sorted by conversation and turn in pieces of even size, whatever the conversations;
a block is a conversation's rows in a piece, some bytes each. Blocks become tables, the tables
of a conversation are crossed in one place, and then every block is solved on its own. Texts
join the answer at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, batches, mapped, written

BLOCK_ROWS = 1 << 16
PIECE_ROWS = 1 << 18
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last is added to a truncated row that stays
INITIALS = "sua"
FINE, CUT, BLANK, DUPLICATE = range(4)
#: The state after an inserted or renamed turn: user, unless the last turn is a user's.
NEXT = (2, 2, 3, 2)
ROLES = (None, None, "user", "assistant")
NEVER = 1 << 60
EDITS = "conv_id bigint, piece int, seq int, audit string, uids array<bigint>, roles array<string>"


def _row_table(kind: int) -> tuple[list[list[int]], list[list[str]]]:
    """Least cost and edits of a row, from state to state. ``kind``: 4 * initial (s, u, a, other) + fault."""
    initial, fault = divmod(kind, 4)
    cost, edits = [[NEVER] * 4 for _ in range(4)], [["~"] * 4 for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):  # more would come back to a state already reached
            ways = [(DELETE, "D", state)]
            if fault < BLANK:
                extra = TRUNCATED if fault == CUT else 0
                kept = 1 if initial == 0 and state == 0 else 2 if initial == 1 and state != 2 else 3 if initial == 2 and state == 2 else 0
                ways += [(KEEP + extra, "K", kept)] * (kept > 0) + [(REROLE + extra, "R", NEXT[state])]
            for c, letter, end in ways:
                new = (c + inserted * INSERT, "I" * inserted + letter)
                if new < (cost[start][end], edits[start][end]):
                    cost[start][end], edits[start][end] = new
            state = NEXT[state]
    return cost, edits


ROW_TABLES = [_row_table(k) for k in range(16)]
#: What is inserted after the last row, from each state, and its cost.
ENDING = ("", "II", "I", "")


def _places(keys: list) -> tuple[int, ...]:
    order = sorted(range(4), key=keys.__getitem__)
    return tuple(order.index(q) for q in range(4))


#: A table as a flat tuple: 16 costs, and 16 places of the edits among those from the same state.
Table = tuple[int, ...]
ROWS: list[Table] = [
    tuple(sum(cost, [])) + tuple(p for row in edits for p in _places(row)) for cost, edits in ROW_TABLES
]


@lru_cache(1 << 16)
def _onward(costs: tuple[int, ...], places: tuple[int, ...], table: Table) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """(cost of all states, cost beyond that, places) after what ``table`` does."""
    after, keys = [], []
    for q in range(4):
        c, place, p = min((costs[p] + table[4 * p + q], places[p], p) for p in range(4))
        after.append(min(c, NEVER))
        keys.append((c >= NEVER, place, table[16 + 4 * p + q]))
    least = min(after)
    return least, tuple(c - least if c < NEVER else NEVER for c in after), _places(keys)


@lru_cache(1 << 16)
def _backward(costs: tuple[int, ...], table: Table) -> tuple[int, tuple[int, ...]]:
    before = [min(min(table[4 * p + q] + costs[q] for q in range(4)), NEVER) for p in range(4)]
    least = min(before)
    return least, tuple(c - least if c < NEVER else NEVER for c in before)


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in range(4))


def forward(tables: list[Table], start: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Cost vector (a common cost and the rest of each state) and places after ``tables`` from one state."""
    total, costs, places = 0, _only(start), (0, 1, 2, 3)
    for table in tables:
        step, costs, places = _onward(costs, places, table)
        total += step
    return total, costs, places


def composed(tables: list[Table]) -> Table:
    """The table of several rows or blocks."""
    ends = [forward(tables, p) for p in range(4)]
    return tuple(min(t + c, NEVER) for t, costs, _ in ends for c in costs) + tuple(x for _, _, places in ends for x in places)


def crossings(tables: list[Table], start: int, end: int) -> list[int]:
    """The states of the least costly, ASCII-least edits from ``start`` to ``end``: before, between and after the tables."""
    out = [start] * (len(tables) + 1)
    out[-1] = end

    def solve(low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        _, there, places = forward(tables[low:middle], out[low])
        back = _only(out[high])
        for table in reversed(tables[middle:high]):
            _, back = _backward(back, table)
        # States of equal cost in sum differ in the edits before the middle already.
        out[middle] = min(range(4), key=lambda q: (there[q] + back[q], places[q]))
        solve(low, middle)
        solve(middle, high)

    solve(0, len(tables))
    return out


def last_state(tables: list[Table]) -> tuple[int, int]:
    """(least cost of a whole conversation, the state after its last row)."""
    total, costs, places = forward(tables, 0)
    whole = [costs[q] + INSERT * len(ENDING[q]) for q in range(4)]
    end = min(range(4), key=lambda q: (whole[q], places[q]))
    return total + whole[end], end


@lru_cache(1 << 14)
def _audit(kinds: bytes, start: int, end: int) -> tuple[str, ...]:
    states = crossings([ROWS[k] for k in kinds], start, end)
    return tuple(ROW_TABLES[k][1][p][q] for k, (p, q) in zip(kinds, pairwise(states), strict=True))


def row_edits(kinds: bytes, start: int, end: int) -> tuple[str, ...]:
    """Edits of each row of a block, with the insertions before it."""
    return _audit(kinds, start, end) if len(kinds) <= 32 else _audit.__wrapped__(kinds, start, end)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, ...) with drops, emptied texts, lost ends, repeats and wrong roles.

    What happens to a row is decided by crc32(conv_id:turn) modulo 20: 0 drops it, 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it, 4 makes its role user. NULLs are one space, but a NULL conv_id or turn stays NULL.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        hit.alias("hit"),
    ).where("hit <> 0")
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("hit", "copy")


def _kind(role: Column, text: Column, repeated: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACES))
    initial = F.instr(F.lit(INITIALS), F.substring(role, 1, 1))
    place = F.when((F.length(role) == 0) | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(bare == "", BLANK).when(repeated, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT)
    return (4 * place + F.coalesce(fault, F.lit(FINE))).cast("int")


def _with_kinds(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, uid, kind): narrow rows with their first fault."""
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"),
        "uid",
        _kind(F.col("role"), F.col("text"), F.lit(False)).alias("kind"),
    )
    full = narrow.where(F.col("kind") % 4 != BLANK)
    # The first of equal rows, combined before the shuffle; blank rows, which may be many, stay out.
    first = (
        full.groupBy(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest"))
        .agg(F.min(F.struct("turn", "uid")).alias("f_first"), F.count("*").alias("f_n"))
        .where("f_n > 1")
    )
    seen = full.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")), "left")
    again = F.coalesce(F.struct("turn", "uid") > F.col("f_first"), F.lit(False))
    kind = F.when(again, F.floor(F.col("kind") / 4) * 4 + DUPLICATE).otherwise(F.col("kind"))
    marked = seen.withColumn("kind", kind.cast("int")).select(*narrow.columns)
    return marked.unionByName(narrow.where(F.col("kind") % 4 == BLANK))


BLOCKS = (
    "conv_id bigint, piece int, seq int, kinds binary, uids binary, "
    "low bigint, high bigint, first_turn bigint, last_turn bigint, turns bigint"
)


def _blocks(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, uid, kind) as blocks: a conversation's rows in a piece, in portions of bounded size."""
    piece, seq, key, parts, size = TaskContext.get().partitionId(), 0, None, [], 0
    out: list[tuple] = []

    def closed() -> tuple:
        turns, uids, kinds = (np.concatenate([p[i] for p in parts]) for i in range(3))
        given = turns[~np.isnan(turns.astype("float64"))] if turns.dtype == object else turns
        distinct = int((given[1:] != given[:-1]).sum()) + 1 if len(given) else 0
        ends = [int(x) for x in (given[0], given[-1])] if len(given) else [None, None]
        return (key[0], piece, seq, kinds.astype(np.uint8).tobytes(), uids.astype("<i8").tobytes(), *ends, *ends, distinct)

    def put(conv: int | None, columns: list[np.ndarray]) -> None:
        nonlocal key, parts, size, seq
        at, n = 0, len(columns[0])
        while at < n:
            if parts and (key != (conv,) or size >= BLOCK_ROWS):
                out.append(closed())
                seq, parts, size = seq + 1, [], 0
            key, take = (conv,), min(n - at, BLOCK_ROWS - size)
            parts.append([c[at : at + take] for c in columns])
            at, size = at + take, size + take

    for batch in batches_:
        conv = batch.column(0).to_pylist()
        columns = [np.array(batch.column(i).to_pylist(), object if batch.column(i).null_count else np.int64) for i in (1, 2, 3)]
        start = 0
        for stop in range(1, len(conv) + 1):
            if stop == len(conv) or conv[stop] != conv[start]:
                put(conv[start], [c[start:stop] for c in columns])
                start = stop
        if len(out) > 2000:
            yield _table(out, BLOCKS)
            out = []
    if parts:
        out.append(closed())
    if out:
        yield _table(out, BLOCKS)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields]
    )


SUMMARIES = (
    "conv_id bigint, piece int, seq int, costs array<bigint>, first_kind int, last_kind int, illegal bigint, "
    "blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, turns bigint"
)
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True


@lru_cache(1 << 14)
def _short_table(kinds: bytes) -> Table:
    return composed([ROWS[k] for k in kinds])


def _summaries(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's table and counts."""
    for batch in batches_:
        out = []
        for row in batch.to_pylist():
            kinds = row["kinds"]
            table = _short_table(kinds) if len(kinds) <= 32 else composed([ROWS[k] for k in kinds])
            kind = np.frombuffer(kinds, np.uint8)
            initial, faults = kind // 4, np.bincount(kind % 4, minlength=4).tolist()
            illegal = int((~_LEGAL[initial[:-1], initial[1:]]).sum())
            out.append((
                row["conv_id"], row["piece"], row["seq"], table, int(initial[0]), int(initial[-1]), illegal,
                faults[BLANK], faults[DUPLICATE], faults[CUT], *(row[c] for c in ("low", "high", "first_turn", "last_turn", "turns")),
            ))
        if out:
            yield _table(out, SUMMARIES)


CROSSED = (
    "c_piece int, c_seq int, start int, end int, tail string, "
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def _crossed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which each block starts and ends, and a conversation's counts with its first block.

    Takes blocks' tables sorted by conversation and place: a conversation has one per piece and ``BLOCK_ROWS`` rows.
    """
    blocks: list[dict] = []
    out: list[tuple] = []

    def finish() -> None:
        tables = [tuple(b["costs"]) for b in blocks]
        cost, end = last_state(tables)
        states = crossings(tables, 0, end)
        given = [b for b in blocks if b["turns"]]
        turns = sum(b["turns"] for b in given) - sum(a["last_turn"] == b["first_turn"] for a, b in pairwise(given))
        gaps = given[-1]["high"] - given[0]["low"] + 1 - turns if given else 0
        illegal = sum(b["illegal"] for b in blocks) + sum(
            not _LEGAL[a["last_kind"], b["first_kind"]] for a, b in pairwise(blocks)
        )
        counts = (gaps, *(sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")), illegal, cost)
        for i, b in enumerate(blocks):
            tail = ENDING[end] if i == len(blocks) - 1 else ""
            out.append((b["piece"], b["seq"], states[i], states[i + 1], tail, *(counts if i == 0 else (None,) * 6)))

    for batch in batches_:
        for row in batch.to_pylist():
            if blocks and blocks[0]["conv_id"] != row["conv_id"]:
                finish()
                blocks = []
            blocks.append(row)
        if len(out) > 2000:
            yield _table(out, CROSSED)
            out = []
    if blocks:
        finish()
    if out:
        yield _table(out, CROSSED)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _solved(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their states as edits: the audit, and of each edit the row it is for and the role it gives."""
    for batch in batches_:
        out = []
        for b in batch.select(["conv_id", "piece", "seq", "kinds", "uids", "start", "end", "tail"]).to_pylist():
            edits = row_edits(b["kinds"], b["start"], b["end"])
            uids, roles, state = [], [], b["start"]
            for kind, uid, edit in zip(b["kinds"], np.frombuffer(b["uids"], "<i8").tolist(), edits, strict=True):
                for letter in edit:
                    uids.append(None if letter == "I" else uid)
                    if letter in "IR":
                        state = NEXT[state]
                    elif letter == "K":
                        state = kind // 4 + 1
                    roles.append(ROLES[state] if letter in "IR" else None)
            for _ in b["tail"]:
                state = NEXT[state]
                uids.append(None)
                roles.append(ROLES[state])
            out.append((b["conv_id"], b["piece"], b["seq"], "".join(edits) + b["tail"], uids, roles))
        if out:
            yield _table(out, EDITS)


class Repair:
    """Repaired conversations of rows (conv_id, turn, role, text, ...).

    ``edits``: a row per block of a conversation, in order of (piece, seq): audit (an initial per edit: Keep,
    Rerole, Delete, Insert), uids (of the rows) and roles (that edits give). ``counts``: per block, gaps, blank,
    duplicate, truncated, illegal and cost of the conversation, with its first block only. ``rows()``: what
    the repair leaves.

    A conversation's rows are taken by turn (NULLs first; equal turns by role, then by a digest of role and
    text, so that equal rows are neighbours). NULL roles and texts are one space; rows with a NULL conv_id are
    one conversation; repeated rows are duplicates; other columns are ignored; an empty table has no
    conversations. ``piece_rows``: rows sorted in one task, about.
    """

    def __init__(self, conversations: DataFrame, piece_rows: int = PIECE_ROWS):
        spark = conversations.sparkSession
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
        rows = conversations.select(*ids, blank("role"), blank("text"))
        self.source = written(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
        self.partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.source.count() // piece_rows))
        order = ["conv_id", "turn", "role", "digest", "uid"]
        ranged = _with_kinds(self.source).repartitionByRange(self.partitions, *order).sortWithinPartitions(*order)
        blocks = written(ranged.select("conv_id", "turn", "uid", "kind").mapInArrow(_blocks, BLOCKS), "blocks")
        tables = blocks.mapInArrow(_summaries, SUMMARIES)
        together = tables.repartition(self.partitions, "conv_id").sortWithinPartitions("conv_id", "piece", "seq")
        crossed = written(together.mapInArrow(_crossed, CROSSED), "crossed")
        placed = blocks.join(crossed.drop(*COUNTS), (F.col("piece") == F.col("c_piece")) & (F.col("seq") == F.col("c_seq")))
        self.edits = written(placed.mapInArrow(_solved, EDITS), "edits")
        self.counts = crossed.withColumnsRenamed({"c_piece": "piece", "c_seq": "seq"}).drop("start", "end", "tail")

    def rows(self) -> DataFrame:
        """(conv_id, piece, seq, at, role, text, edit): the repaired rows, in order of (piece, seq, at)."""
        each = self.edits.select("conv_id", "piece", "seq", "audit", F.posexplode(F.arrays_zip("uids", "roles")).alias("at", "e"))
        each = each.select(
            "conv_id", "piece", "seq", "at", F.substring("audit", F.col("at") + 1, F.lit(1)).alias("edit"),
            F.col("e.uids").alias("e_uid"), F.col("e.roles").alias("e_role"),
        )
        found = self.source.select("uid", "role", "text")
        kept = each.where("edit IN ('K', 'R')").join(found, F.col("e_uid") == F.col("uid"))
        columns = ["conv_id", "piece", "seq", "at", F.coalesce("e_role", "role").alias("role"), "text", "edit"]
        added = each.where("edit = 'I'").withColumns({"role": F.lit(None).cast("string"), "text": F.lit("")})
        return kept.select(*columns).unionByName(added.select(*columns))


def _hashed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256) of ``role:text`` of sorted rows (conv_id, text, role), joined by newlines; holds one row at a time."""
    key, state, out = None, None, []
    for convs, texts, roles in batches(batches_):
        for conv, text, role in zip(convs, texts, roles, strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if len(out) > 10_000:
            yield _table(out, "h_conv bigint, sha string")
            out = []
    if state is not None:
        out.append((key, state.hexdigest()))
    if out:
        yield _table(out, "h_conv bigint, sha string")


def repair_report(conversations: DataFrame, ids: DataFrame | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``ids``: (conv_id, ...) of conversations to report even if they have no rows; they have zeros, an empty
    audit and the hash of an empty text. gaps: turns missing between the first and the last. The hash is of
    the repaired rows as ``role:text``, joined by newlines; a conversation's rows stream through one task for it.
    """
    repair = Repair(conversations, piece_rows)
    parts = F.array_sort(F.collect_list(F.struct("piece", "seq", "audit")))
    audits = repair.edits.groupBy(F.col("conv_id").alias("a_conv")).agg(
        F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"), F.min(F.struct("piece", "seq")).alias("a_first")
    )
    counts = repair.counts.where("cost IS NOT NULL").withColumnsRenamed({"piece": "c_piece", "seq": "c_seq"})
    ordered = repair.rows().repartition(repair.partitions, "conv_id").sortWithinPartitions("conv_id", "piece", "seq", "at")
    hashes = mapped(ordered.select("conv_id", "text", "role"), _hashed, "h_conv bigint, sha string")
    known = (conversations if ids is None else ids).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = (
        known.join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv")), "left")
        .join(counts, (F.col("a_first.piece") == F.col("c_piece")) & (F.col("a_first.seq") == F.col("c_seq")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("h_conv")), "left")
    )
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
