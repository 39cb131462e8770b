"""State-store streams give the results of the batch operators, over any batches, gaps and restarts."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gatherline.operators import snapshot, wait
from gatherline.plans.catalog import Data, sensor_rows
from gatherline.streaming import keyed

FIELDS = ["tie", "stand_id", "predicted_wait_5min", "predicted_wait_10min", "arrival_rate_lambda", "halftime_spike_expected", "recommendation"]


def rows_of(df, *fields):
    return sorted(map(repr, df.select(*(fields or df.columns)).collect()))


@pytest.fixture(scope="module")
def whole(spark):
    return Data(spark, "/root/testdata/sf0.001")


def test_forecasts_of_any_batches(spark, folder, whole):
    """The same bits as the batch forecasts for single readings, several files and all at once."""
    queues = whole.queues.where("tie < 200").cache()
    before = spark.conf.get(keyed.PROVIDER, None)
    updated = []
    for a, b in ((0, 1), (1, 3), (3, 120), (120, 200)):
        queues.where((F.col("tie") >= a) & (F.col("tie") < b)).repartition(2).write.mode("append").parquet(f"{folder}/in")
        query = keyed.start_forecasts(spark.readStream.schema(queues.schema).parquet(f"{folder}/in"), folder)
        query.awaitTermination()
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in progress))
    assert rows_of(spark.read.parquet(f"{folder}/wait_predictions"), *FIELDS) == rows_of(wait.wait_forecasts(queues), *FIELDS)
    # A batch touches the state of the stands it has readings of.
    assert updated[0] == 1 and updated[1] <= 2
    assert spark.conf.get(keyed.PROVIDER, None) == before


def test_ticks_of_gaps_and_restarts(spark, folder, whole):
    """Every tick is told once, in hours without a reading as well, whatever the batches."""
    kinds = {"crowd": whole.crowd, "queue": whole.queues, "ble": whole.ble, "cctv": whole.cctv}
    start = datetime(2024, 1, 1)
    # Two days, of which the readings from six to thirty hours are missing.
    held = {k: df.where(f"time < '{start + timedelta(hours=48)}' AND (time < '{start + timedelta(hours=6)}' OR time > '{start + timedelta(hours=30)}')").cache() for k, df in kinds.items()}
    cuts = [start + timedelta(hours=h) for h in (0, 3, 31, 40, 48)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for kind, df in held.items():
            df.where(f"time >= '{a}' AND time < '{b}'").write.mode("append").parquet(f"{folder}/{kind}")
        job = keyed.SnapshotStream(spark, f"{folder}/out", "1 hour")
        job.start({k: spark.readStream.schema(df.schema).parquet(f"{folder}/{k}") for k, df in held.items()}).awaitTermination()
    told = job.snapshots()
    newest = held["crowd"].agg(F.max("time")).first()[0] - timedelta(minutes=10)
    want = snapshot.snapshots_per_tick(held, "1 hour").where(F.col("time") <= F.lit(newest))
    assert told.count() == told.select("time").distinct().count() == want.count() == 47
    assert rows_of(told, "time", "total_attendance", "venue_congestion_level", "alerts") == rows_of(want, "time", "total_attendance", "venue_congestion_level", "alerts")
    assert rows_of(sensor_rows(told)) == rows_of(sensor_rows(want))


EVENTS, STATES = "k string, placed_at timestamp, tie long, n int", "k string, time timestamp, tie long, v int"


def joined(spark, folder, files=None):
    """The progress of the as-of join over all files of ``folder`` that it has not read."""
    stream = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1000).json(f"{folder}/{name}")
    due = F.window("placed_at", "10 minutes")["end"]
    told = keyed.last_before(stream(EVENTS, "events"), stream(STATES, "states"), "k", "placed_at", due, ["n"], ["v"], "10 minutes")
    with keyed.keyed_store(spark):
        query = told.writeStream.format("json").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def put(folder, number, events, states):
    for name, time, rows, field in (("events", "placed_at", events, "n"), ("states", "time", states, "v")):
        os.makedirs(f"{folder}/{name}", exist_ok=True)
        path = f"{folder}/{name}/{number:03}.json"
        with open(f"{folder}/{name}/.new", "w") as f:
            f.writelines(json.dumps({"k": k, time: datetime.fromtimestamp(at, timezone.utc).isoformat(), "tie": tie, field: v}) + "\n" for k, at, tie, v in rows)
        os.rename(f"{folder}/{name}/.new", path)
        os.utime(path, (1e9 + number, 1e9 + number))


@pytest.mark.parametrize("seed", [1, 2])
def test_last_state_before_for_any_batches(spark, folder, seed):
    """Rows that are late, or not late enough, keys that come late, ties, and rows that come twice."""
    rng, number, found = random.Random(seed), 0, []
    events, states, before, watermark = [], [], 0, 0

    def batch(asked, told):
        nonlocal before, watermark
        events.extend(e for e in asked if e[1] > before)
        states.extend(s for s in told if s[1] > before)
        for e in [e for e in events if e[1] // 600 * 600 + 600 <= watermark]:
            last = max((s[1:] for s in states if s[0] == e[0] and s[1] <= e[1]), key=lambda s: (s[0], s[1], str(s[2])), default=None)
            found.append((*e, None if last is None else last[2]))
            events.remove(e)
        newest = max([r[1] for r in [*asked, *told]], default=0)
        before, watermark = watermark, max(watermark, newest - 600)

    for files in (3, 1, 4):
        for _ in range(files):
            number += 1
            keys = ["A", "B", "", None, *["C", "D"][: number // 3]]
            row = lambda: (rng.choice(keys), 100_000 + number * 500 + 20 * rng.randrange(-60, 20), rng.randrange(3), rng.choice([3, 20, 100]))  # noqa: E731, B023
            asked, told = ([row() for _ in range(rng.choice([10, 40]))] for _ in range(2))
            told += told[:3]
            put(folder, number, asked, told)
            batch(asked, told)
        joined(spark, folder, 1)
        batch([], [])
    rows = spark.read.schema(f"{EVENTS}, state struct<v int>").json(f"{folder}/told").selectExpr("k", "unix_seconds(placed_at)", "tie", "n", "state.v").collect()
    assert len(found) > 100 and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, found))


def test_rows_reach_the_state_store_in_pieces(spark, folder):
    """One by one, rows cost more than all that is done with them."""
    n = 40_000
    put(folder, 1, [("A", 1000 + i, i, i) for i in range(n)], [("A" if i % 2 else "B", 1000 + i, i, i) for i in range(n)])
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in joined(spark, folder)]
    assert sum(updated) < 40 * keyed.SLOTS
    told = spark.read.schema(f"{EVENTS}, state struct<v int>").json(f"{folder}/told")
    over = (1000 + n - 1 - 600) // 600 * 600 - 1000
    assert told.count() == over
    assert told.where("state.v IS DISTINCT FROM if(tie = 0, NULL, tie - (1 - tie % 2))").count() == 0


def test_readings_of_stands_pass_in_pieces(whole):
    """As many rows as stands reach the state store, whatever the readings."""
    pieces = whole.queues.withColumn("stand_id", F.nullif("stand_id", F.lit("C4"))).select("stand_id", "tie").coalesce(1)
    rows = pieces.mapInArrow(keyed._stand_pieces, "stand_id string, payload binary").collect()
    found = [(r.stand_id, tie) for r in rows for tie in keyed._as_table(r.payload)["tie"].to_pylist()]
    assert len({r.stand_id for r in rows}) == len(rows) == 8
    assert sorted(found, key=repr) == sorted(map(tuple, pieces.collect()), key=repr)
