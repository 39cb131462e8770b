"""The refresh policy against a plain simulation of a refresh per minute."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from gatherline.operators import rollup
from gatherline.streaming.refresh import RefreshedBuckets

START = datetime(2024, 1, 1, 9, 52)
SCHEMA = "time timestamp, received timestamp, zone string, density double, headcount int, flow_rate double"


def readings():
    """Over twenty-five minutes and an hour's end; received at once, in time, just in time, or too late."""
    rng = random.Random(3)
    rows = []
    for _ in range(160):
        time = START + timedelta(seconds=rng.randrange(25 * 60))
        delay = rng.choice([0, 0, 5, 60, 300, 540, 600, 601, 660, 900])
        rows.append((time, time + timedelta(seconds=delay), rng.choice(["Gate-East", "Gate-West"]), rng.randrange(8) / 8, rng.randrange(50), 1.0))
    return sorted(rows, key=lambda r: r[1])


def simulated(rows):
    """Buckets after a refresh at every whole minute, each of which sets all buckets in its reach."""
    table, now = {}, START
    newest = rows[-1][1]
    while now <= newest:
        reach = defaultdict(list)
        for r in rows:
            bucket = r[0].replace(second=0)
            if r[1] <= now and bucket >= now - timedelta(minutes=10) and bucket + timedelta(minutes=1) <= now - timedelta(minutes=1):
                reach[bucket, r[2]].append(r)
        for key, found in reach.items():
            table[key] = (sum(r[3] for r in found) / len(found), max(r[4] for r in found))
        now += timedelta(minutes=1)
    return table


def got(job):
    rows = job.table().collect()
    assert len(rows) == len({(r.bucket, r.zone) for r in rows})
    return {(r.bucket, r.zone): (r.avg_density, r.max_headcount) for r in rows}


@pytest.mark.parametrize("cuts", [[], [1, 30, 31, 100]])
def test_any_batches_give_what_a_refresh_per_minute_gives(spark, folder, cuts):
    rows = readings()
    want = simulated(rows)
    job = RefreshedBuckets(spark, folder, rollup.crowd_buckets)
    edges = [0, *cuts, len(rows)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        for _ in range(2 if n == 1 else 1):  # an attempt that is made again
            job.process(spark.createDataFrame(rows[a:b], SCHEMA), n)
        assert got(job) == simulated(rows[:b])
    assert got(job) == want
    refreshed = rows[-1][1].replace(second=0)
    assert max(b for b, _ in want) + timedelta(minutes=2) <= refreshed
    late = {(r.time, r.received) for r in job.late().collect()}
    assert late == {(t, r) for t, r, *_ in rows if r > t.replace(second=0) + timedelta(minutes=10)} and late


def test_old_hours_are_left_alone(spark, folder):
    """A batch writes the hours it touches; files of other hours stay the same."""
    from pathlib import Path

    job = RefreshedBuckets(spark, folder, rollup.crowd_buckets)
    rows = readings()
    job.process(spark.createDataFrame(rows, SCHEMA), 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(folder, "buckets").glob("hour=*/*.parquet")}
    later = [(t + timedelta(hours=2), r + timedelta(hours=2), *x) for t, r, *x in rows]
    job.process(spark.createDataFrame(later, SCHEMA), 1)
    before = files()
    assert len({p.parent for p in before}) == 4
    last = [(t + timedelta(hours=5), r + timedelta(hours=5), *x) for t, r, *x in rows]
    job.process(spark.createDataFrame(last, SCHEMA), 2)
    kept = {p for p in before if "2024010109" in str(p) or "2024010110" in str(p)}
    assert kept and all(files().get(p) == before[p] for p in kept)
    empty = RefreshedBuckets(spark, f"{folder}/none", rollup.crowd_buckets)
    empty.process(spark.createDataFrame([], SCHEMA), 0)
    assert empty.refreshes.read(0).count() == 0
