"""Work that has to stay spread over tasks and small in each."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql import functions as F

from gatherline.functions.numbers import exact_sum, small_exact_sum
from gatherline.functions.queueing import mean_wait
from gatherline.operators import flow
from gatherline.sources import messages, venue
from gatherline.sources.tables import Snapshots
from gatherline.streaming import keyed
from gatherline.streaming.delivery import once


def test_snapshots_are_computed_in_the_plans_own_tasks(spark, folder):
    """A snapshot is one file, but only its rows come together in one task, not the work that makes them."""

    def tasks(batches):
        for batch in batches:
            zones, task = [str(v) for v in batch["id"].to_pylist()], float(TaskContext.get().taskAttemptId())
            yield pa.RecordBatch.from_pydict({"zone": zones, "smoothed": [task] * len(zones)})

    state = Snapshots(spark, folder, "zone string, smoothed double")
    state.write(spark.range(0, 12, 1, 6).mapInArrow(tasks, "zone string, smoothed double"), 0)
    found = state.read(0)
    assert len(found.inputFiles()) == 1
    assert sorted(int(r.zone) for r in found.collect()) == list(range(12))
    assert found.select("smoothed").distinct().count() == 6


def test_messages_are_parsed_once(spark):
    """A filter on what a message says must not parse it once for every rule."""
    sent = spark.createDataFrame([(1, '{"beacon_id": "B1"}')], "tie long, value string")
    rows = messages.accepted(messages.parse(sent, venue.BLE_TOPIC))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


class Calls:
    """A state-store list, a timer handle and the times of a batch, with a count of the calls."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(list(self.rows))

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.rows += rows
        self.calls += 1

    def put(self, rows):
        self.rows = list(rows)
        self.calls += 1

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_tick_keeps_its_last_reading_in_one_call():
    state = keyed.TickState(1000)
    state.handle = state.readings = calls = Calls()
    rows = [Row(at=at * 1000, tie=tie, payload="p") for tie, at in enumerate([1500, 200, 900, 900, 1400, 3100])]
    assert list(state.handleInputRows(("queue", "Q1"), iter(rows), calls)) == []
    assert sorted(r[:2] for r in calls.rows) == [(900_000, 3), (1_500_000, 0), (3_100_000, 5)]
    assert calls.calls == 1 and calls.timers == [1000]


def test_events_and_states_are_stored_many_at_a_time():
    state = keyed.LastBefore()
    state.events, state.states, state.handle = Calls(), Calls(), Calls()
    rows = [Row(side=n % 2, at=n * 1000, tie=n, due=10_000 - n, payload=str(n)) for n in range(200)]
    assert list(state.handleInputRows(("C4",), iter(rows), state.handle)) == []
    assert len(state.events.rows) == len(state.states.rows) == 100
    assert state.events.calls == 1 and state.states.calls == 1 and state.handle.timers == [9802]


def test_tasks_of_runs_grow_with_the_number_of_runs(spark):
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(1, "Gate-East", 0.5)], "index long, zone string, density double")
    per_task = flow.RUN_EVERY * 256 * flow.BLOCKS_PER_TASK
    tasks = lambda last: flow.run_members(rows, last).rdd.getNumPartitions()
    assert tasks(5) == 1
    assert tasks(per_task) == 3 * spread
    assert tasks(per_task * 12 * spread) == 12 * spread


def test_forecasts_move_readings_once_and_only_runs_through_python(spark):
    rows = [(i, i % 7, ["Gate-East", "Concourse-A", "VIP-Lounge"][i % 3], (i * 37 % 100) / 100) for i in range(1, 2001)]
    readings = spark.createDataFrame(rows, "index long, t int, zone string, density double").withColumn("time", F.timestamp_seconds("index"))
    plan = flow.flow_forecasts(readings, 2000)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ArrowEvalPython") == 1
    # No shuffle by run, nor one of readings by block and zone: theirs by block serves all.
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
    assert not [e for e in exchanges if "(_block" in e and ("run" in e or "zone" in e)]
    assert sum("REPARTITION_BY_NUM" in e for e in exchanges) == 1


def test_small_sums_are_exact_for_any_size(spark):
    values = [0.5, -0.25, 1e-9, None, 9e9, -9e9, 9.2e9, 9.2e9, -3.3, 123456789.987654321]
    groups = [values[i:j] for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    rows = [(g, v) for g, group in enumerate(groups) for v in group]
    sums = spark.createDataFrame(rows, "g int, x double").groupBy("g").agg(
        exact_sum(F.col("x")).cast("double").alias("want"), small_exact_sum(F.col("x")).alias("got")
    )
    assert sums.where(~F.col("want").eqNullSafe(F.col("got"))).count() == 0 and sums.count() == len(groups)


def test_a_zone_without_a_name_has_no_forecast(spark):
    rows = [(i, None if i % 4 == 0 else "Gate-East", 0.5) for i in range(1, 1501)]
    readings = spark.createDataFrame(rows, "index long, zone string, density double").withColumn("time", F.timestamp_seconds("index"))
    told = flow.flow_forecasts(readings, 1500)
    assert told.count() == 300 and told.where("zone IS NULL").count() == 0


class Kept:
    """A value state of no store."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_readings_of_a_stand_pass_in_frames():
    state = keyed.LastLengths({"place0": "int8", "place1": "int64"})
    state.lengths = Kept()
    rng = np.random.default_rng(3)

    def batch(first, n):
        at = np.arange(first, first + n)
        known = np.where(at % 11 == 0, 11, 15)  # without a length
        frame = pd.DataFrame({"stand_name": "Bar", "at": at, "tie": at, "queue_length": at % 97 * (known == 15), "is_open": True, "known": known})
        frame = frame.assign(place0=1, place1=at).iloc[rng.permutation(n)]
        return (frame.iloc[i : i + 1000] for i in range(0, n, 1000))

    length = lambda i: None if i < 1 or i % 11 == 0 else i % 97
    for first, n in ((1, 1), (2, 25_000), (25_002, 7)):
        frames = list(state.handleInputRows(("C4",), batch(first, n), None))
        assert max(map(len, frames)) <= keyed.ROWS_PER_CALL
        told = pd.concat(frames)
        assert told["at"].tolist() == list(range(first, first + n))
        shown = lambda v, there: [int(x) if t else None for x, t in zip(v, there)]
        assert shown(told["last"], told["has_last"]) == [length(i - 1) for i in range(first, first + n)]
        assert shown(told["before"], told["has_before"]) == [length(i - 2) for i in range(first, first + n)]
        assert set(told["stand_name"]) == {"Bar"} and set(told["stand_id"]) == {"C4"}
    assert state.lengths.value == (2, length(25_007), length(25_008))


def test_copies_are_dropped_in_one_pass_without_a_sort_before_the_shuffle(spark):
    rows = [(i % 50 if i % 5 else None, f"m{i % 50 if i % 5 else i}") for i in range(200)]
    found = once(spark.createDataFrame(rows, "tie long, value string"))
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted({(t, v) for t, v in rows}, key=repr)
    shuffles = [i for i, line in enumerate(lines) if "Exchange " in line]
    assert len(shuffles) == 1 and not any("Sort" in line for line in lines[shuffles[0] :])


def test_last_run_of_a_zone_without_sorting_all(spark):
    rows = [(z, r, f"{z}{r}", r / 10) for z in ("A", "B") for r in range(1, 40 if z == "A" else 20)]
    told = spark.createDataFrame(rows, "zone string, run long, congestion_risk string, predicted_density double").withColumn("smoothed", F.lit(0.5))
    found = flow.latest_run_per_zone(told)
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("A", 39, 195, "A39", 3.9, 0.5), ("B", 19, 95, "B19", 1.9, 0.5)]


def test_a_wait_takes_one_pass_over_the_tills(spark):
    rows = spark.createDataFrame([(2.0, 1.5, 2), (9.0, 1.5, 4), (0.0, 1.5, 2), (1.0, 0.0, 2), (1.0, 1.5, None)], "arrival double, service double, servers int")
    found = rows.select(mean_wait(F.col("arrival"), F.col("service"), F.col("servers")).alias("w"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r.w for r in found.collect()] == [0.53, 1.5, 0.0, 60.0, 60.0]
