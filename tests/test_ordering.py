"""Work in pieces gives what one plain window gives, whatever the skew."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gatherline.operators import flow, ordering, orders, wait
from gatherline.operators.smoothing import smooth

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def readings(kind):
    """(key, seconds, tie, value); one key holds most rows."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c"])
        rows.append((key, rng.randrange(10_000), i, rng.randrange(20)))
    rows.append(("single", 5, 1000, 3))
    if kind == "one instant":
        rows = [(k, 1, i, v) for k, _, i, v in rows]
    if kind == "copies":
        rows += [("hot", 77, 5000, 4)] * 300
    return rows


def frame(spark, rows):
    timed = [(k, START + timedelta(seconds=s), i, v) for k, s, i, v in rows]
    return spark.createDataFrame(timed, "stand_id string, time timestamp, tie long, queue_length int").repartition(5)


@pytest.mark.parametrize("kind", ["spread", "one instant", "copies"])
def test_previous_values(spark, kind):
    df = frame(spark, readings(kind))
    fields = ["stand_id", "time", "tie", "queue_length", "previous.v", "before_previous.v"]

    def run(limit):
        found = ordering.previous_values(df, ["stand_id"], ["time", "tie"], "queue_length", limit)
        rows = found.select(*fields[:4], F.col("previous.v").alias("p"), F.col("before_previous.v").alias("q")).collect()
        return sorted(map(tuple, rows), key=repr)

    assert run(1_000_000) == run(20)


@pytest.mark.parametrize("kind", ["spread", "one instant", "copies"])
def test_carried_forward(spark, kind):
    df = frame(spark, readings(kind)).withColumn("v", F.when(F.col("tie") % 5 == 0, F.col("queue_length")))

    def run(limit):
        found = ordering.carried_forward(df, ["stand_id"], ["time", "tie"], F.col("v"), "last", limit)
        return sorted(map(tuple, found.select("stand_id", "time", "tie", "last").collect()), key=repr)

    assert run(1_000_000) == run(20)


@pytest.mark.parametrize("kind", ["spread", "one instant", "copies"])
def test_numbering(spark, kind):
    df = frame(spark, readings(kind))
    rows, last = ordering.numbered(df, ["time", "tie"], start=10)
    got = sorted((r["index"], r["time"], r["tie"]) for r in rows.collect())
    assert [g[0] for g in got] == list(range(11, 11 + df.count())) and last == 10 + df.count()
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_forecasts_in_pieces(spark, data):
    fields = ["tie", "stand_id", "predicted_wait_5min", "halftime_spike_expected"]

    def run(limit):
        return sorted(map(tuple, wait.wait_forecasts(data.queues, rows_per_task=limit).select(*fields).collect()))

    assert run(1_000_000) == run(25)


def test_state_at_order_in_pieces(spark, data):
    history = wait.wait_forecasts(data.queues)
    asked = data.requests.select("placed_at", "tie", "seat_id", "stand_id")

    def run(limit):
        found = orders.with_state_at(asked, history, ["queue_length", "is_open"], limit)
        return sorted(map(tuple, found.select("tie", "state.queue_length", "state.is_open").collect()), key=repr)

    assert run(1_000_000) == run(25)


def test_run_covers_the_buffered_readings(spark):
    """The rule for runs, against a buffer cut to 50 readings after each run."""
    buffer, expected = [], {}
    for i in range(1, 401):
        buffer.append(i)
        if i % 5 == 0:
            expected[i // 5] = list(buffer)
            buffer = buffer[-50:]
    df = spark.range(1, 401).select(
        F.col("id").alias("index"), F.lit(START).alias("time"), F.lit("Gate-East").alias("zone"), F.lit(0.5).alias("density")
    )
    for block in (8, 1024):
        got = {}
        for r in flow.run_members(df, 400, block=block).collect():
            got.setdefault(r.run, []).append(r["index"])
        assert {run: sorted(v) for run, v in got.items()} == expected


def test_smoothing_hand_case(spark):
    df = spark.createDataFrame([("z", 1, 0.5), ("z", 2, 0.8), ("z", 3, 0.2)], "zone string, run long, density double")
    got = [round(r.smoothed, 10) for r in smooth(df, "zone", "run", "density", 3).orderBy("run").collect()]
    assert got == [0.5, 0.59, 0.473]
    start = spark.createDataFrame([("z", 1.0)], "zone string, smoothed double")
    got = [round(r.smoothed, 10) for r in smooth(df, "zone", "run", "density", 3, start=start).orderBy("run").collect()]
    assert got == [0.85, 0.835, 0.6445]


@pytest.mark.parametrize("block", [2, 3, 16, 4096])
def test_smoothing_in_blocks(spark, block):
    """Several levels of blocks, gaps in the positions, one key in few blocks."""
    rng = random.Random(3)
    rows = [("hot", i, rng.random()) for i in range(1, 400) if rng.random() < 0.8]
    rows += [("rare", i, rng.random()) for i in (7, 150, 151, 390)]
    expected, state = {}, {}
    for zone, i, d in rows:
        before = state.get(zone, d)
        state[zone] = 0.3 * d + 0.7 * before
        expected[zone, i] = state[zone]
    df = spark.createDataFrame(rows, "zone string, run long, density double")
    got = {(r.zone, r.run): r.smoothed for r in smooth(df, "zone", "run", "density", 400, block=block).collect()}
    assert got.keys() == expected.keys()
    assert max(abs(got[k] - expected[k]) for k in got) < 1e-15


def test_flow_forecasts_do_not_depend_on_blocks(spark, data):
    def run(block):
        rows = flow.forecast_history(data.crowd, block=block).select("run", "zone", "current_density", "predicted_density", "recommended_route", "avoid_zones")
        return sorted(map(repr, rows.collect()))

    assert run(7) == run(None)
