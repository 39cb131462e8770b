"""Routes against a heap search written for the test."""

import heapq
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from gatherline.operators import routes
from gatherline.plans import answers
from gatherline.sources import venue

AT = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def heap_search(corridors, densities, source):
    ways = {}
    for a, b, seconds in corridors:
        da, db = densities.get(a, 0.0), densities.get(b, 0.0)
        if da < 0.9 and db < 0.9:
            ways.setdefault(a, []).append((b, seconds * (1 + 4.0 * (db * db))))
            ways.setdefault(b, []).append((a, seconds * (1 + 4.0 * (da * da))))
    cost, before, done, queue = {source: 0.0}, {}, set(), [(0.0, source)]
    while queue:
        c, zone = heapq.heappop(queue)
        if zone in done:
            continue
        done.add(zone)
        for to, w in ways.get(zone, []):
            if to not in cost or c + w < cost[to]:
                cost[to], before[to] = c + w, zone
                heapq.heappush(queue, (c + w, to))
    return cost, before


def path_to(before, source, target):
    path = [target]
    while path[0] != source:
        path.insert(0, before[path[0]])
    return path


def test_random_snapshots(spark):
    rng = random.Random(11)
    choices = [0.0, 0.0, 0.25, 0.5, 0.5, 0.75, 0.89, 0.9, 1.0]  # few values, so that ties occur
    snapshots = {
        i: {z: (rng.choice(choices) if i % 2 else rng.random()) for z in venue.ZONES if rng.random() < 0.9} for i in range(60)
    }
    df = spark.createDataFrame([(i, z, d) for i, s in snapshots.items() for z, d in s.items()], "snapshot int, zone string, density double")
    found = routes.all_routes(routes.density_maps(df, ["snapshot"])).collect()
    assert len(found) == 60 * 144
    searched = {}
    for r in found:
        key = (r.snapshot, r.from_zone)
        if key not in searched:
            searched[key] = heap_search(venue.CORRIDORS, snapshots[r.snapshot], r.from_zone)
        cost, before = searched[key]
        assert r.cost == cost.get(r.to_zone)
        assert r.path == (path_to(before, r.from_zone, r.to_zone) if r.to_zone in cost else [])


def test_search_towards_equals_searches_from_each_zone(spark):
    rng = random.Random(5)
    choices = [0.0, 0.0, 0.0, 0.5, 0.9]

    def snapshots(zones, n):
        rows = [(i, z, rng.choice(choices) if i % 2 else rng.random()) for i in range(n) for z in zones]
        return routes.density_maps(spark.createDataFrame(rows, "snapshot int, zone string, density double"), ["snapshot"]).cache()

    # A grid of equal corridors, where most ways are tied, next to the venue's own.
    grid = [(f"{r}{c}", f"{r}{c + 1}", 10.0) for r in "abc" for c in range(2)]
    grid += [(f"{a}{c}", f"{b}{c}", 10.0) for a, b in ("ab", "bc") for c in range(3)]
    for graph, target, n in ((routes.VENUE, "Lower-Stands", 200), (routes.Graph(tuple(grid)), "b1", 60)):
        given = snapshots(graph.zones, n)
        aimed = routes.search_towards(given, target, graph)
        each = aimed.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in graph.zones])))
        got = routes.paths_towards(each, "zone", target, graph).select("snapshot", "zone", "path").collect()
        wanted = routes.all_routes(given, graph=graph).where(F.col("to_zone") == target).select("snapshot", "from_zone", "path").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))
    assert aimed.where(F.exists("_tied", lambda t: t)).count() > 10


@pytest.mark.parametrize(
    "densities, source, target, path, seconds, minutes, avoided",
    [
        ({}, "Parking-P1", "Lower-Stands", ["Parking-P1", "Gate-North", "VIP-Lounge", "Lower-Stands"], 165.0, 2.8, []),
        ({"VIP-Lounge": 0.95}, "Parking-P1", "Lower-Stands", ["Parking-P1", "Gate-East", "Concourse-A", "Lower-Stands"], 170.0, 2.8, ["VIP-Lounge"]),
        ({"Lower-Stands": 0.5}, "Gate-North", "Lower-Stands", ["Gate-North", "VIP-Lounge", "Lower-Stands"], 65.0, 1.1, []),
        ({"Gate-North": 0.95}, "Gate-North", "Gate-North", ["Gate-North"], 0.0, 0.0, []),
        ({"Lower-Stands": 0.95}, "Gate-East", "Lower-Stands", [], None, None, []),
        ({"Gate-North": 0.95}, "Gate-North", "Lower-Stands", [], None, None, []),
        ({}, "Roof", "Roof", ["Roof"], 0.0, 0.0, []),
        ({}, "Roof", "Gate-East", [], None, None, []),
        ({}, "Gate-East", "Roof", [], None, None, []),
    ],
)
def test_hand_cases(spark, densities, source, target, path, seconds, minutes, avoided):
    rows = [(source, target, densities)]
    df = spark.createDataFrame(rows, "from_zone string, to_zone string, densities map<string,double>")
    r = routes.routes(df).first()
    assert (r.path, r.estimated_seconds, r.estimated_minutes, r.reachable, r.avoided_zones) == (
        path, seconds, minutes, seconds is not None, avoided,
    )


def test_walk_fallbacks(spark):
    rows = [("Gate-East", "Gate-East", {}), ("Gate-East", "Lower-Stands", {"Lower-Stands": 0.95}), ("Concourse-A", "Lower-Stands", {})]
    df = spark.createDataFrame(rows, "a string, b string, densities map<string,double>")
    path, minutes = routes.walk_columns(F.col("a"), F.col("b"))
    got = [(r.p, r.m) for r in routes.search(df, "a").select(path.alias("p"), minutes.alias("m")).collect()]
    assert got == [(["Gate-East"], 0.0), (["Gate-East", "Lower-Stands"], 2.0), (["Concourse-A", "Lower-Stands"], 0.5)]


def test_edges_of_a_snapshot(spark):
    df = spark.createDataFrame([(1, "Gate-North", 0.95), (1, "Concourse-A", 0.5)], "snapshot int, zone string, density double")
    rows = {(r.from_zone, r.to_zone): r.seconds for r in routes.weighted_edges(df, ["snapshot"]).collect()}
    assert len(rows) == 38 - 6 and rows["Gate-East", "Concourse-A"] == 100.0 and rows["Concourse-A", "Gate-East"] == 50.0


def test_search_needs_no_shuffle(spark):
    df = spark.createDataFrame([("Gate-East", "Lower-Stands", {})], "from_zone string, to_zone string, densities map<string,double>")
    plan = routes.routes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_large_graph(spark):
    """A venue of 210 zones: a grid with tied ways, shortcuts, blocked zones and a long corridor at its side."""
    rng = random.Random(4)
    name = lambda r, c: f"{r:02}-{c:02}"
    corridors = [(name(r, c), name(r, c + 1), 10.0) for r in range(14) for c in range(12)]
    corridors += [(name(r, c), name(r + 1, c), 10.0) for r in range(13) for c in range(13)]
    corridors += [(name(rng.randrange(14), rng.randrange(13)), name(rng.randrange(14), rng.randrange(13)), rng.choice([5.0, 35.5])) for _ in range(40)]
    corridors = [c for c in corridors if c[0] != c[1]] + [(f"side-{i:02}", f"side-{i + 1:02}", 3.0) for i in range(27)] + [("00-00", "side-00", 1.0)]
    graph = routes.Graph(tuple(corridors))
    assert len(graph.zones) == 210
    snapshots = {i: {z: rng.choice([0.0, 0.0, 0.5, 0.95]) for z in graph.zones} for i in range(3)}
    df = spark.createDataFrame([(i, z, d) for i, s in snapshots.items() for z, d in s.items()], "snapshot int, zone string, density double")
    given = routes.density_maps(df, ["snapshot"])
    sources = rng.sample(graph.zones, 6) + ["side-27"]
    asked = given.withColumn("from_zone", F.explode(F.array(*[F.lit(z) for z in sources])))
    for r in routes.search(asked, "from_zone", graph).collect():
        cost, before = heap_search(corridors, snapshots[r.snapshot], r.from_zone)
        assert {z: c for z, c in zip(graph.zones, r._cost, strict=True) if c is not None} == cost
        assert {z: graph.zones[p] for z, p in zip(graph.zones, r._pred, strict=True) if p is not None} == before
    plan = routes.search(asked, "from_zone", graph)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_best_routes_use_last_reading_per_sensor(spark):
    rows = [
        (AT.replace(hour=10), 1, "CS-1", "VIP-Lounge", 0.1), (AT.replace(hour=11), 2, "CS-1", "VIP-Lounge", 0.95),
        (AT.replace(hour=13), 3, "CS-1", "VIP-Lounge", 0.0),
    ]
    crowd = spark.createDataFrame(rows, "time timestamp, tie long, sensor_id string, zone string, density double")
    asked = spark.createDataFrame([("Parking-P1", "Lower-Stands")], "from_zone string, to_zone string")
    r = answers.best_routes(asked, crowd, AT).first()
    assert r.path == ["Parking-P1", "Gate-East", "Concourse-A", "Lower-Stands"] and r.avoided_zones == ["VIP-Lounge"]
