"""Streams whose state lives in the state store, one entry per key.

Unlike the versioned folders of :mod:`.readings`, a batch reads and writes the state of
the keys it has readings of, and nothing else; the store's checkpoints bring it back after a
failure:

* :func:`forecast_stream`: a stand's last two queue lengths, for its next forecast;
* :func:`last_before`: events with the state of their key as they happened, of two streams;
* :class:`SnapshotStream`: a sensor's readings that no tick has taken yet. Timers in event time
  end the ticks, so that every tick is told, with or without a reading in it.

The state processors hand on plain columns; everything computed from them runs in the JVM. Spark hands rows to
a processor one by one, at some ten microseconds each; the first two are given pieces instead, Arrow tables
of many rows as bytes, which tasks make before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import wait
from ..operators.snapshot import assemble, sensor_fields
from ..sources.tables import append_batch, read_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """State processors need the RocksDB store; a query keeps the one it starts with, so the session's comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# --- rows in pieces -------------------------------------------------------------------------------


#: Rows, or bytes, of a task that are cut into pieces together.
PIECE_ROWS, PIECE_BYTES = 1 << 15, 8 << 20


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _as_table(piece: bytes) -> pa.Table:
    return pa.ipc.open_stream(piece).read_all()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, many at a time."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PIECE_ROWS or size >= PIECE_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _unpacked(pieces: DataFrame, schema: str) -> DataFrame:
    """The rows of (payload) ``pieces``; there are more tasks than keys, so the pieces are dealt out first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch["payload"]:
                yield from _as_table(piece.as_py()).to_batches()

    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(rows, schema)


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each of the different values; NULL is one of them."""
    return values.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()


def _cuts(codes: np.ndarray) -> np.ndarray:
    """Where the runs of equal codes start, and where the last one ends."""
    return np.r_[np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)]), len(codes)]


def _parts(table: pa.Table, codes: np.ndarray) -> Iterator[pa.Table]:
    """The rows of each code."""
    order = np.argsort(codes, kind="stable")
    table, cuts = table.take(order), _cuts(codes[order])
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield table.slice(start, end - start)


# --- queue forecasts -----------------------------------------------------------------------------


#: Rows that go to the state store, or leave a state processor, in one call.
ROWS_PER_CALL = 10_000

#: Fields of a reading that may be NULL, each with its bit of ``known``: frames of pandas have plain numbers only.
KNOWN = {"at": 1, "tie": 2, "queue_length": 4, "is_open": 8}


class LastLengths(StatefulProcessor):
    """Adds the one and two queue lengths before each reading of a stand, in order of the columns ``order``.

    A batch's readings of a stand are held as numbers in arrays, some thirty bytes each; frames of
    ``ROWS_PER_CALL`` go in and out.
    """

    FIELDS = {"at": np.int64, "tie": np.int64, "queue_length": np.int32, "is_open": np.bool_, "known": np.int8}

    def __init__(self, order: dict[str, str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lengths = handle.getValueState("lengths", "seen int, before int, last int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        types = self.FIELDS | {c: np.dtype(t) for c, t in self.order.items()}
        parts, names = {c: [np.empty(0, t)] for c, t in types.items()}, {}
        coded = [np.empty(0, np.int32)]
        for frame in rows:
            for c, t in types.items():
                parts[c].append(frame[c].to_numpy(dtype=t))
            coded.append(np.array([names.setdefault(n, len(names)) for n in frame["stand_name"]], np.int32))
        columns = {c: np.concatenate(parts.pop(c)) for c in types}
        codes, texts = np.concatenate(coded), np.array(list(names), object)
        place = np.lexsort([columns[c] for c in reversed(self.order)])

        seen, before, last = self.lengths.get() if self.lengths.exists() else (0, None, None)
        carried = [before if seen > 1 else None, last if seen > 0 else None]
        lengths = np.r_[[v or 0 for v in carried], columns["queue_length"][place]].astype(np.int32)
        there = np.r_[[v is not None for v in carried], columns["known"][place] & KNOWN["queue_length"] > 0]
        for start in range(0, len(place), ROWS_PER_CALL):
            now = place[start : start + ROWS_PER_CALL]
            back = slice(start, start + len(now)), slice(start + 1, start + 1 + len(now))
            yield pd.DataFrame(
                {"stand_id": key[0], "stand_name": texts[codes[now]]}
                | {c: columns[c][now] for c in self.FIELDS}
                | {"before": lengths[back[0]], "has_before": there[back[0]], "last": lengths[back[1]], "has_last": there[back[1]]}
            )
        ends = [int(v) if known else None for v, known in zip(lengths[-2:], there[-2:], strict=True)]
        self.lengths.update((min(seen + len(place), 2), *ends))

    def close(self) -> None:
        pass


FORECAST_INPUT = (
    "stand_id string, stand_name string, at long, tie long, queue_length int, is_open boolean, known tinyint, "
    "before int, has_before boolean, last int, has_last boolean"
)
FORECAST_SCHEMA = pa.schema(
    [(name, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "tinyint": pa.int8()}[kind])
     for name, kind in (field.split() for field in FORECAST_INPUT.split(", "))]
)


def _stand_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stand_id, payload) of readings."""
    for table in _tables(batches):
        parts = list(_parts(table, _codes(table["stand_id"])))
        stands = pa.array([part["stand_id"][0].as_py() for part in parts], pa.string())
        pieces = [_as_bytes(part.drop_columns("stand_id")) for part in parts]
        yield pa.RecordBatch.from_arrays([stands, pa.array(pieces, pa.binary())], ["stand_id", "payload"])


class LastLengthsOfPieces(LastLengths):
    """:class:`LastLengths` of readings that come and go in pieces."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        readings = (_as_table(piece).to_pandas() for frame in rows for piece in frame["payload"])
        for told in super().handleInputRows(key, readings, timerValues):
            yield pd.DataFrame({"payload": [_as_bytes(pa.Table.from_pandas(told, FORECAST_SCHEMA, preserve_index=False))]})


def _places(queues: DataFrame, order: tuple[str, ...]) -> list[Column]:
    """The columns of ``order`` (numbers, times, or structs of them) as numbers, NULL before any other."""
    places = []
    for c in order:
        kind = queues.schema[c].dataType
        leaves = [(f"{c}.{f.name}", f.dataType) for f in kind] if isinstance(kind, T.StructType) else [(c, kind)]
        for name, leaf in leaves:
            value = F.unix_micros(name) if isinstance(leaf, T.TimestampType) else F.col(name)
            value = value if isinstance(leaf, T.FractionalType) else value.cast("long")
            places += [F.col(name).isNotNull().cast("tinyint"), F.coalesce(value, F.lit(0))]
    return places


def forecast_stream(queues: DataFrame, window: int = 5, order: tuple[str, ...] = ("time", "tie")) -> DataFrame:
    """A wait forecast per reading of a stream of queue readings; batches follow each other as they come.

    State: two numbers per stand. Start the result within :func:`keyed_store`.
    """
    # Times go through Python as microseconds, whatever its time zone.
    given = queues.withColumn("at", F.unix_micros("time"))
    known = sum((F.col(c).isNotNull().cast("int") * bit for c, bit in KNOWN.items()), F.lit(0))
    places = {f"place{i}": p for i, p in enumerate(_places(queues, order))}
    rows = given.select(
        "stand_id", "stand_name",
        *[F.coalesce(F.col(c), F.lit(0 if c != "is_open" else False).cast(given.schema[c].dataType)).alias(c) for c in KNOWN],
        known.cast("tinyint").alias("known"),
        *[p.alias(name) for name, p in places.items()],
    )
    kinds = {"tinyint": "int8", "bigint": "int64", "float": "float32"}
    ordered = {name: kinds.get(t, "float64") for name, t in rows.select(*places).dtypes}
    pieces = rows.mapInArrow(_stand_pieces, "stand_id string, payload binary")
    kept = pieces.groupBy("stand_id").transformWithStateInPandas(LastLengthsOfPieces(ordered), "payload binary", "append", "none")
    told = _unpacked(kept, FORECAST_INPUT)
    whole = {c: F.when(F.col("known").bitwiseAND(bit) > 0, F.col(c)) for c, bit in KNOWN.items()}
    timed = told.select(
        "stand_id", "stand_name", whole["tie"].alias("tie"), whole["queue_length"].alias("queue_length"),
        whole["is_open"].alias("is_open"),
        F.struct(F.when(F.col("has_last"), F.col("last")).alias("v")).alias("previous"),
        F.struct(F.when(F.col("has_before"), F.col("before")).alias("v")).alias("before_previous"),
        F.timestamp_micros(whole["at"]).alias("time"),
    )
    return wait.forecasts(wait.rates_from_previous(timed, window).drop("previous", "before_previous"))


def start_forecasts(queues: DataFrame, path: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Append the forecasts of a stream to the table ``path``/wait_predictions."""
    with keyed_store(queues.sparkSession):
        return (
            forecast_stream(queues, **options)
            .writeStream.format("parquet")
            .option("path", f"{path}/wait_predictions")
            .option("checkpointLocation", f"{path}/_checkpoint/forecasts")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


# --- the state at the time of an event ------------------------------------------------------------


#: Bytes of pieces that go to the state store in one call, at least.
BYTES_PER_CALL = 16 << 20

#: Keys are dealt to so many slots. A slot's events and states are kept together. Never to be changed: checkpoints have it.
SLOTS = 64

PIECE = "slot int, time timestamp, side int, at long, due long, payload binary"


def _slot_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PIECE`` of events and states: per slot and side the newest ``time``, first ``at``, first ``due``, and the rows.

    A task ends with an empty piece for every slot, so that all slots see every batch.
    """
    newest = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.timestamp("us", "UTC"), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["slot", "time", "side", "at", "due", "payload"])

    for table in _tables(batches):
        # Texts of all of a slot's pieces may take more than 2 GB.
        table = table.set_column(table.schema.get_field_index("payload"), "payload", table["payload"].cast(pa.large_string()))
        places, pieces = table["slot"].to_numpy() * 2 + table["side"].to_numpy(), []
        for part in _parts(table, places):
            if part["at"].null_count:
                raise ValueError("an event or a state without a time")
            ends = pc.min_max(part["at"]).as_py()
            newest = max(ends["max"], newest or ends["max"])
            slot, side = part["slot"][0].as_py(), part["side"][0].as_py()
            rows = part.drop_columns(["slot", "side"] if side == 0 else ["slot", "side", "due"])
            pieces.append((slot, ends["max"], side, ends["min"], pc.min(part["due"]).as_py(), _as_bytes(rows)))
        yield batch(pieces)
    if newest is not None:
        yield batch([(slot, newest, None, None, None, None) for slot in range(SLOTS)])


NO_STATES = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("payload", pa.large_string())]).empty_table()


def _append(kept, pieces: list[tuple]) -> None:
    """Add ``pieces``, whose last fields are bytes, to the list state ``kept``."""
    some, size = [], 0
    for piece in pieces:
        some.append(piece)
        size += len(piece[-1])
        if size >= BYTES_PER_CALL:
            kept.appendList(some)
            some, size = [], 0
    if some:
        kept.appendList(some)


def _put(kept, pieces: list[tuple]) -> None:
    """``pieces`` in place of what the list state ``kept`` has."""
    kept.clear()
    _append(kept, pieces)


def _event_pieces(rows: pa.Table) -> list[tuple]:
    parts = [rows.slice(start, ROWS_PER_CALL) for start in range(0, rows.num_rows, ROWS_PER_CALL)]
    return [(pc.min(p["at"]).as_py(), pc.min(p["due"]).as_py(), _as_bytes(p)) for p in parts]


def _state_pieces(rows: pa.Table) -> list[tuple]:
    return [(_as_bytes(rows.slice(start, ROWS_PER_CALL)),) for start in range(0, rows.num_rows, ROWS_PER_CALL)]


def _in_order(codes: np.ndarray, states: pa.Table) -> np.ndarray:
    """Places of the states by code, time, tie and, where these are the same, by payload."""
    at, tie = states["at"].to_numpy(), states["tie"].combine_chunks()
    tied, tie = tie.is_valid().to_numpy(zero_copy_only=False), tie.fill_null(0).to_numpy()
    keys = [tie, tied, at, codes]
    order = np.lexsort(keys)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    if same.any():
        # Only these payloads are compared: each gets its rank among them.
        some = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        rank = np.zeros(len(order), np.int64)
        rank[order[some]] = pc.rank(states["payload"].take(order[some]), tiebreaker="dense").to_numpy()
        order = np.lexsort([rank, *keys])
    return order


class LastBefore(StatefulProcessor):
    """Events (side 0) of a slot's keys, each with the last state (side 1) of its key at or before it, all in pieces.

    An event waits until the watermark has passed the time it is ``due``. Of a key's states, the last one that
    an event still to come can need is kept, and those after it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getListState("states", "payload binary")
        self.events = handle.getListState("events", "at long, due long, payload binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Pieces go to the store as they are, many at a time.
        events, states = [], []
        for r in rows:
            if r.side == 0:
                events.append((r.at, r.due, r.payload))
            else:
                states.append((r.payload,))
        if states and self.states.exists():
            waiting = [e[0] for e in [*self._waiting(), *events]]
            _put(self.states, _state_pieces(self._needed(*self._known(), waiting, timerValues.getCurrentWatermarkInMs())))
        _append(self.states, states)
        _append(self.events, events)
        # One timer, of the event that is due first; when it expires, all that are due come out.
        if events:
            self.handle.registerTimer(min(e[1] for e in events))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting, left = self._waiting(), []
        if all(e[1] > until for e in waiting):
            return
        states, cuts = self._known()
        keys, at = states["key"].take(cuts[:-1]).combine_chunks(), states["at"].to_numpy()
        for e in waiting:
            if e[1] > until:
                left.append(e)
                continue
            events = _as_table(e[2])
            due = events["due"].to_numpy() <= until
            left += _event_pieces(events.filter(~due))
            events = events.filter(due).drop_columns("due")
            place = self._last_before(events, keys, at, cuts)
            found = states["payload"].take(pa.array(place, mask=place < 0)).cast(pa.string())
            events = events.set_column(events.schema.get_field_index("payload"), "payload", events["payload"].cast(pa.string()))
            yield Row(payload=_as_bytes(events.append_column("state", found)))
        _put(self.events, left)
        if left:
            self.handle.registerTimer(min(e[1] for e in left))
        _put(self.states, _state_pieces(self._needed(states, cuts, [e[0] for e in left], until)))

    @staticmethod
    def _last_before(events: pa.Table, keys: pa.Array, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The place of every event's state, -1 where there is none, among the times ``at`` of states by key, cut at ``cuts``."""
        own = pc.index_in(events["key"], keys).combine_chunks().fill_null(-1).to_numpy()
        when, found = events["at"].to_numpy(), np.full(events.num_rows, -1)
        order = np.argsort(own, kind="stable")
        asked = _cuts(own[order])
        for start, end in zip(asked[:-1], asked[1:], strict=True):
            rows = order[start:end]
            key = own[rows[0]]
            if key >= 0:
                place = np.searchsorted(at[cuts[key] : cuts[key + 1]], when[rows], side="right") - 1
                found[rows] = np.where(place < 0, -1, cuts[key] + place)
        return found

    @staticmethod
    def _needed(states: pa.Table, cuts: np.ndarray, waiting: list[int], watermark: int) -> pa.Table:
        """The last of a key's states that every event still to come can be after, and all after it.

        ``waiting``: times that no event without a state is before; none still to come is before the watermark.
        """
        before = states["at"].to_numpy() <= min([watermark * 1000, *waiting])
        following = np.r_[before[1:], False][: len(before)]
        following[cuts[1:] - 1] = False
        return states.filter(~(before & following))

    def _known(self) -> tuple[pa.Table, np.ndarray]:
        """The states kept, by key and in order of time, and where a key's states start."""
        pieces = self.states.get() if self.states.exists() else ()
        states = pa.concat_tables([NO_STATES, *(_as_table(s[0]) for s in pieces)]).combine_chunks()
        codes = _codes(states["key"])
        order = _in_order(codes, states)
        return states.take(order), _cuts(codes[order])

    def _waiting(self) -> list[tuple]:
        return [(e[0], e[1], e[2]) for e in self.events.get()] if self.events.exists() else []

    def close(self) -> None:
        pass


class TimelyLastBefore(LastBefore):
    """:class:`LastBefore` without the rows that the watermark had passed before the batch, as Spark drops them.

    Spark drops a piece if all of its rows are late. The watermark it goes by is that of the batch before, which a
    processor is not told; as every slot sees every batch that has rows, it is the one noted then, or the
    present one if batches without rows came between.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "batch long, watermark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch, watermark = int(TaskContext.get().getLocalProperty("streaming.sql.batchId")), timerValues.getCurrentWatermarkInMs()
        seen = self.seen.get() if self.seen.exists() else None
        passed = seen[1] if seen and seen[0] == batch - 1 else watermark
        self.seen.update((batch, watermark))
        yield from super().handleInputRows(key, self._timely(rows, passed * 1000), timerValues)

    @staticmethod
    def _timely(rows: Iterator[Row], passed: int) -> Iterator[Row]:
        for r in rows:
            if r.payload is not None and r.at <= passed:
                timely = _as_table(r.payload).filter(pc.field("at") > passed)
                ends = {c: pc.min(timely[c]).as_py() if c in timely.column_names else None for c in ("at", "due")}
                r = Row(side=r.side, payload=_as_bytes(timely) if timely.num_rows else None, **ends)
            if r.payload is not None:
                yield r


def last_before(
    events: DataFrame, states: DataFrame, key: str, time: str, due: Column, fields: list[str], columns: list[str], lateness: str
) -> DataFrame:
    """A stream of events (``key``, ``time``, tie, ``fields``), each with ``state``: the ``columns`` of its key's last row
    (``key``, time, tie, ...) of the stream ``states`` at or before it; NULL if there is none.

    An as-of join of two streams: nothing is read again, no event meets more than one state. An event comes out
    once the watermark of both streams has passed ``due``; rows later than ``lateness`` no longer count. Events and
    states travel as JSON, in pieces of many rows. Start the result within :func:`keyed_store`.
    """
    payload = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("payload")
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int").alias("slot")
    left = events.select(
        slot, F.lit(0).alias("side"), F.col(key).alias("key"), F.unix_micros(time).alias("at"), F.col("tie").cast("long"),
        F.unix_millis(due).alias("due"), payload(fields),
    )
    right = states.select(
        slot, F.lit(1).alias("side"), F.col(key).alias("key"), F.unix_micros("time").alias("at"), F.col("tie").cast("long"),
        F.lit(None).cast("long").alias("due"), payload(columns),
    )
    told = (
        left.unionByName(right)
        .mapInArrow(_slot_pieces, PIECE)
        .withWatermark("time", lateness)
        .groupBy("slot")
        .transformWithState(TimelyLastBefore(), "payload binary", "append", "eventTime")
    )
    rows = _unpacked(told, "key string, at long, tie long, payload string, state string")
    types = lambda df, names: ", ".join(f"{c} {t}" for c, t in df.select(*names).dtypes)
    return rows.select(
        F.col("key").alias(key),
        F.timestamp_micros("at").alias(time),
        "tie",
        F.from_json("payload", types(events, fields)).alias("p"),
        F.from_json("state", types(states, columns)).alias("state"),
    ).select(key, time, "tie", "p.*", "state")


# --- snapshots per tick --------------------------------------------------------------------------


class TickState(StatefulProcessor):
    """A sensor's last reading before the end of every tick.

    State: the reading last told and, of each later tick, the last reading of every batch. A timer stands at the end of the next tick;
    when the watermark passes it, all ticks up to the watermark are told.
    """

    def __init__(self, tick_ms: int):
        self.tick = tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getListState("readings", "at long, tie long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # Of a tick's readings only the last is ever told; they are kept in one call.
        known, ends = self.readings.exists(), {}
        for r in rows:
            tick, reading = r.at // 1000 // self.tick, (r.at, r.tie, r.payload)
            if tick not in ends or ends[tick] < reading:
                ends[tick] = reading
        if ends:
            self.readings.appendList(list(ends.values()))
            if not known:
                self.handle.registerTimer((min(ends) + 1) * self.tick)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end, until = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        waiting = sorted((r[0], r[1], r[2]) for r in self.readings.get())
        place = 0
        while end <= until:
            while place + 1 < len(waiting) and waiting[place + 1][0] < end * 1000:
                place += 1
            at, tie, payload = waiting[place]
            yield Row(kind=key[0], sensor=key[1], tick=end, at=at, tie=tie, payload=payload)
            end += self.tick
        self.readings.put(waiting[place:])
        self.handle.registerTimer(end)

    def close(self) -> None:
        pass


def _as_sensors(readings: dict[str, DataFrame]) -> DataFrame:
    """(kind, sensor, time, at, tie, payload) of the readings of all kinds."""
    parts = []
    for kind, rows in readings.items():
        key, fields = sensor_fields(kind)
        payload = F.to_json(F.struct(*[c for c in fields if c != "time"]), {"ignoreNullFields": "false"})
        at = F.unix_micros("time").alias("at")
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(key).alias("sensor"), "time", at, "tie", payload.alias("payload")))
    return reduce(DataFrame.unionByName, parts)


class SnapshotStream:
    """Venue snapshots at the end of every tick, from streams of readings (crowd, queue, ble, cctv), under ``root``.

    A tick is told when the watermark passes its end, with the last reading of every sensor seen until
    then; readings later than ``lateness`` no longer count. State: a sensor's last readings of the ticks that are not told yet.
    """

    def __init__(self, spark: SparkSession, root: str, tick: str, lateness: str = "10 minutes"):
        self.spark, self.root, self.tick, self.lateness = spark, root, tick, lateness
        width = spark.sql(f"SELECT INTERVAL '{tick}' AS t").first()["t"]
        self.tick_ms = width // timedelta(milliseconds=1)
        self.schemas: dict[str, str] = {}

    def start(self, readings: dict[str, DataFrame], trigger: dict | None = None) -> StreamingQuery:
        for kind, rows in readings.items():
            _, fields = sensor_fields(kind)
            self.schemas[kind] = ", ".join(f"{c} {t}" for c, t in rows.select(*fields).dtypes if c != "time")
        told = (
            _as_sensors(readings)
            .withWatermark("time", self.lateness)
            .groupBy("kind", "sensor")
            .transformWithState(
                TickState(self.tick_ms), "kind string, sensor string, tick long, at long, tie long, payload string", "append", "eventTime"
            )
        )
        with keyed_store(self.spark):
            return (
                told.writeStream.foreachBatch(self.process)
                .option("checkpointLocation", f"{self.root}/_checkpoint/snapshots")
                .trigger(**(trigger or {"availableNow": True}))
                .start()
            )

    def process(self, states: DataFrame, n: int) -> None:
        """The snapshots of the ticks that end with batch ``n``: all sensors' states of a tick come in one batch."""
        states.persist()
        try:
            latest = {}
            for kind, schema in self.schemas.items():
                key, fields = sensor_fields(kind)
                rows = states.where(F.col("kind") == kind).select(
                    F.col("sensor").alias(key),
                    F.timestamp_millis("tick").alias("tick"),
                    F.timestamp_micros("at").alias("time"),
                    F.from_json("payload", schema).alias("p"),
                )
                latest[kind] = rows.select(key, "tick", "time", "p.*").select(key, *fields, "tick")
            append_batch(assemble(latest), f"{self.root}/snapshots", n)
        finally:
            states.unpersist()

    def snapshots(self) -> DataFrame:
        return read_table(self.spark, f"{self.root}/snapshots").drop("date")
