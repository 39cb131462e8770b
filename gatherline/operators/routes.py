"""Cheapest walking routes through a venue, for many crowd snapshots at once.

The corridor graph is fixed while snapshots are many, so a snapshot is one row holding
the densities of all zones, and a search is a column: an array with one distance per
zone. There is no join and no shuffle in a search, and rows are independent of each
other, so the work spreads over a cluster as evenly as the snapshots do.

Searches run on Arrow batches in numpy: the corridors are an array of edges, a round relaxes
all edges of all rows of a batch at once, and rounds end when nothing changes. As expressions
of the JVM the same rounds were interpreted corridor by corridor, at some hundred microseconds
a search, and the plan grew with the venue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crowd import BLOCK_DENSITY, is_blocked, walk_factor
from ..functions.numbers import round_half_up
from ..sources import venue
from .rollup import zone_means

# Numbers that a search looks at together: rows times edges.
CELLS = 1 << 20


@dataclass(frozen=True)
class Graph:
    """Corridors walkable both ways: (zone, zone, base seconds)."""

    corridors: tuple[tuple[str, str, float], ...] = field(
        default_factory=lambda: tuple(venue.CORRIDORS)
    )

    @property
    def zones(self) -> list[str]:
        """All zones by name: a zone's position doubles as its rank in ties."""
        return sorted({z for a, b, _ in self.corridors for z in (a, b)})

    def entering(self, zone: str) -> list[tuple[int, float]]:
        """(position, base seconds) of the neighbours of ``zone``."""
        at = self.zones.index(zone)
        here = self.edges.inside == at
        return list(zip(self.edges.outside[here].tolist(), self.edges.seconds[here].tolist(), strict=True))

    @cached_property
    def edges(self) -> Edges:
        return Edges(self)


class Edges:
    """All ways between neighbours, in order of (inside, outside): positions of zones, and base seconds."""

    def __init__(self, graph: Graph):
        place = {z: i for i, z in enumerate(graph.zones)}
        ways = sorted(w for a, b, s in graph.corridors for w in ((place[a], place[b], s), (place[b], place[a], s)))
        self.zones = len(place)
        self.inside = np.array([w[0] for w in ways])
        self.outside = np.array([w[1] for w in ways])
        self.seconds = np.array([w[2] for w in ways], float)
        self.starts = np.flatnonzero(np.r_[True, self.inside[1:] != self.inside[:-1]])  # every zone has a way

    def settled(self, start: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Distances that no way shortens, from those of ``start``. A row each; infinite where unreachable."""
        distance = start
        while True:
            over = np.minimum.reduceat(distance[:, self.outside] + weights, self.starts, axis=1)
            shorter = np.minimum(distance, over)
            if np.array_equal(shorter, distance):
                return distance
            distance = shorter

    def first_of(self, marked: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """Per row and zone the smallest (``outside`` value, zone outside) among its marked ways; -1 without any."""
        value = np.where(marked, outside, np.inf)
        least = np.minimum.reduceat(value, self.starts, axis=1)
        chosen = marked & (value == least[:, self.inside])
        place = np.minimum.reduceat(np.where(chosen, self.outside, self.zones), self.starts, axis=1)
        return np.where(place < self.zones, place, -1)

    def from_source(self, factors: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from a zone (-1: none) to all zones, and the zone before each; entering a zone costs its factor."""
        rows = np.arange(len(source))
        here = np.zeros(factors.shape, bool)
        here[rows[source >= 0], source[source >= 0]] = True
        with np.errstate(invalid="ignore"):
            inside = factors[:, self.inside]
            weights = np.where(np.isinf(inside), np.inf, self.seconds * inside)
        distance = self.settled(np.where(here & np.isfinite(factors), 0.0, np.inf), weights)
        way = distance[:, self.outside] + weights
        shortest = (way == distance[:, self.inside]) & np.isfinite(way)
        before = self.first_of(shortest, distance[:, self.outside])
        before[here] = -1
        return np.where(here, 0.0, distance), before

    def towards(self, factors: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
        """The zone after each zone on the way to ``target`` (-1: none), and whether another is as near."""
        with np.errstate(invalid="ignore"):
            outside = factors[:, self.outside]
            weights = np.where(np.isinf(outside), np.inf, self.seconds * outside)
        start = np.full(factors.shape, np.inf)
        start[np.isfinite(factors[:, target]), target] = 0.0
        distance = self.settled(start, weights)
        way = distance[:, self.outside] + weights
        after = self.first_of(np.isfinite(way), way)
        after[np.isinf(factors)] = -1
        after[:, target] = -1
        near = np.isfinite(way) & (way <= distance[:, self.inside] * 1.000000001)
        tied = np.add.reduceat(near.astype(np.int32), self.starts, axis=1) > 1
        tied[:, target] = False
        return after, tied

    def ways_towards(self, factors: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions on the ways from all zones to ``target``, one after another; their lengths, 0 without a way; ties
        as of :meth:`towards`). A way with a tie is searched from its zone."""
        after, tied = self.towards(factors, target)
        rows = np.repeat(np.arange(len(factors)), self.zones)
        here = np.tile(np.arange(self.zones), len(factors))
        ways, unsure = np.full((len(rows), self.zones), -1), tied.ravel().copy()
        ways[:, 0] = here
        for step in range(1, self.zones):
            # No zone comes after the target, and none after a zone without a way.
            here = np.where(here >= 0, after[rows, here], -1)
            if (here < 0).all():
                break
            ways[:, step] = here
            unsure |= (here >= 0) & tied[rows, here]
        lengths = (ways >= 0).sum(axis=1)
        lengths[ways[np.arange(len(ways)), lengths - 1] != target] = 0
        asked = np.flatnonzero(unsure)
        size = max(1, CELLS // len(self.inside))
        for part in (asked[i : i + size] for i in range(0, len(asked), size)):
            ways[part], lengths[part] = self.walked_back(factors[rows[part]], ways[part, 0], target)
        return ways[np.arange(self.zones) < lengths[:, None]], lengths.reshape(len(factors), self.zones), tied

    def walked_back(self, factors: np.ndarray, source: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest way from each row's ``source`` to ``target``, and its length; 0 where unreachable."""
        cost, before = self.from_source(factors, source)
        rows, here = np.arange(len(source)), np.full(len(source), target)
        back = np.full((len(source), self.zones), -1)
        back[:, 0] = here
        for step in range(1, self.zones):
            here = np.where(here >= 0, before[rows, here], -1)
            if (here < 0).all():
                break
            back[:, step] = here
        lengths = (back >= 0).sum(axis=1)
        places = lengths[:, None] - 1 - np.arange(self.zones)
        ways = np.where(places >= 0, np.take_along_axis(back, np.maximum(places, 0), axis=1), -1)
        return ways, np.where(np.isfinite(cost[:, target]), lengths, 0)


VENUE = Graph()


def weighted_edges(densities: DataFrame, keys: list[str], graph: Graph = VENUE) -> DataFrame:
    """Directed edges of every snapshot with their current seconds.

    ``densities``: keys, zone, density. A zone without density counts as empty;
    edges touching a blocked zone are left out. All edges of a snapshot come from
    its own row, so the only shuffle is the one that builds the density map.
    """
    both = [(a, b, s) for a, b, s in graph.corridors] + [(b, a, s) for a, b, s in graph.corridors]
    listed = F.array(
        *[
            F.struct(F.lit(a).alias("from_zone"), F.lit(b).alias("to_zone"), F.lit(s).alias("base_seconds"))
            for a, b, s in both
        ]
    )
    maps = density_maps(densities, keys)
    at = lambda zone: F.coalesce(F.col("densities")[zone], F.lit(0.0))
    return (
        maps.select(*keys, "densities", F.inline(listed))
        .where(~is_blocked(at(F.col("from_zone"))) & ~is_blocked(at(F.col("to_zone"))))
        .select(
            *keys,
            "from_zone",
            "to_zone",
            (F.col("base_seconds") * walk_factor(at(F.col("to_zone")))).alias("seconds"),
        )
    )


def density_maps(densities: DataFrame, keys: list[str]) -> DataFrame:
    """One row per snapshot with a zone -> density map (as many entries as zones)."""
    return densities.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("zone", "density"))).alias("densities")
    )


def snapshot_densities(crowd: DataFrame, tick: str) -> DataFrame:
    """Mean density per zone in time snapshots, as (snapshot, densities)."""
    rows = crowd.select(F.window("time", tick)["start"].alias("snapshot"), "zone", "density")
    return density_maps(zone_means(rows, ["snapshot"]), ["snapshot"])


def _factors(graph: Graph) -> Column:
    """Factor per zone from the ``densities`` map; infinite where blocked."""
    zones = F.array(*[F.lit(z) for z in graph.zones])

    def factor(zone: Column) -> Column:
        density = F.coalesce(F.col("densities")[zone], F.lit(0.0))
        return F.when(is_blocked(density), F.lit(float("inf"))).otherwise(walk_factor(density))

    return F.transform(zones, factor)


def _lists(values: np.ndarray, known: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of ``values`` as lists, NULL where not ``known``; a NULL list where ``rows`` is not set."""
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32())
    flat = pa.array(values.ravel(), kind, mask=~known.ravel())
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array(~rows))


def _chunks(factors: pa.Array, edges: Edges) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, their factors) in parts, so that what a search holds is bounded."""
    values = factors.flatten().to_numpy(zero_copy_only=False).reshape(len(factors), edges.zones)
    step = max(1, CELLS // len(edges.inside))
    for start in range(0, len(values), step):
        yield slice(start, start + step), values[start : start + step]


def search(df: DataFrame, source: str = "from_zone", graph: Graph = VENUE, only: str = "true") -> DataFrame:
    """Distances from the zone in ``source`` to all zones.

    Needs a ``densities`` map column. Adds two arrays indexed like ``graph.zones``:
    ``_cost`` (NULL where unreachable) and ``_pred``, the position of the zone
    before on the cheapest path. Among equally cheap paths the one over the zone
    with the smaller (cost, name) wins, at every step. Rows outside the condition
    ``only`` are not searched.
    """
    edges = graph.edges

    @F.arrow_udf("struct<cost:array<double>,pred:array<int>>")
    def searched(factors: pa.Array, place: pa.Array) -> pa.Array:
        asked = place.is_valid().to_numpy(zero_copy_only=False)
        sources = place.fill_null(-1).to_numpy(zero_copy_only=False)
        cost, before = np.full((len(place), edges.zones), np.inf), np.full((len(place), edges.zones), -1)
        wanted = np.flatnonzero(asked)
        for part, given in _chunks(factors.take(pa.array(wanted)), edges):
            cost[wanted[part]], before[wanted[part]] = edges.from_source(given, sources[wanted[part]])
        lists = [_lists(cost, np.isfinite(cost), asked, pa.float64()), _lists(before, before >= 0, asked, pa.int32())]
        return pa.StructArray.from_arrays(lists, ["cost", "pred"])

    zones = F.array(*[F.lit(z) for z in graph.zones])
    place = F.when(F.expr(only), F.coalesce(F.array_position(zones, F.col(source)), F.lit(0)).cast("int") - 1)
    found = df.withColumn("_found", searched(_factors(graph), place))
    return found.select(*df.columns, F.col("_found.cost").alias("_cost"), F.col("_found.pred").alias("_pred"))


def search_towards(df: DataFrame, target: str, graph: Graph = VENUE) -> DataFrame:
    """One search for the ways from all zones to ``target``.

    Needs a ``densities`` map column. Adds ``_ways``, the positions on the way from each zone
    (empty if there is none), and ``_tied``: whether another zone after it is as near, but for
    rounding. Which of equally cheap paths counts is defined from the source (see
    :func:`search`), so tied ways are searched from there, in the same batch.
    """
    edges, goal = graph.edges, graph.zones.index(target)

    @F.arrow_udf("struct<ways:array<array<int>>,tied:array<boolean>>")
    def aimed(factors: pa.Array) -> pa.Array:
        steps, ways = [np.empty(0, np.int32)], np.zeros((len(factors), edges.zones), int)
        tied = np.zeros((len(factors), edges.zones), bool)
        for part, given in _chunks(factors, edges):
            places, lengths, tied[part] = edges.ways_towards(given, goal)
            steps.append(places)
            ways[part] = lengths
        every = np.ones(len(factors), bool)
        ends = pa.array(np.r_[0, ways.ravel().cumsum()], pa.int32())
        each = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(steps), pa.int32()))
        rows = pa.array(np.arange(0, tied.size + 1, edges.zones), pa.int32())
        lists = [pa.ListArray.from_arrays(rows, each), _lists(tied, np.ones(tied.shape, bool), every, pa.bool_())]
        return pa.StructArray.from_arrays(lists, ["ways", "tied"])

    found = df.withColumn("_found", aimed(_factors(graph)))
    return found.select(*df.columns, F.col("_found.ways").alias("_ways"), F.col("_found.tied").alias("_tied"))


def paths_towards(df: DataFrame, source: str, target: str, graph: Graph = VENUE) -> DataFrame:
    """Add ``path`` from the zone in ``source`` to ``target``; empty if unreachable.

    Needs the column ``_ways`` of :func:`search_towards`; a row only names its own way.
    """
    zones = F.array(*[F.lit(z) for z in graph.zones])
    way = F.get(F.col("_ways"), (F.array_position(zones, F.col(source)) - 1).cast("int"))
    none = F.array().cast("array<string>")
    named = F.coalesce(F.transform(way, lambda i: F.element_at(zones, i + 1)), none)
    path = F.when(F.col(source) == target, F.array(F.lit(target))).otherwise(named)
    return df.withColumn("path", path).drop("_ways", "_tied")


def route_columns(source: Column, target: Column, graph: Graph = VENUE) -> tuple[Column, Column]:
    """(cost, path) for a target zone, from the arrays of :func:`search`."""
    zones = F.array(*[F.lit(z) for z in graph.zones])
    place = F.array_position(zones, target)
    cost = F.when(place > 0, F.get(F.col("_cost"), (place - 1).cast("int")))

    def step(path: Column, _: Column) -> Column:
        # Prepend the predecessor of the first element, until there is none.
        earlier = F.get(F.col("_pred"), path[0])
        return F.when(earlier.isNull(), path).otherwise(F.concat(F.array(earlier), path))

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(graph.zones) - 1)),
        F.array((place - 1).cast("int")),
        step,
    )
    named = F.transform(walked, lambda i: F.element_at(zones, i + 1))
    path = F.when(source == target, F.array(source)).when(cost.isNotNull(), named).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(source == target, F.lit(0.0)).otherwise(cost), path


def blocked_zones(densities: Column) -> Column:
    """Blocked zones of a density map, by name."""
    return F.sort_array(F.map_keys(F.map_filter(densities, lambda _, d: d >= BLOCK_DENSITY)))


def routes(requests: DataFrame, graph: Graph = VENUE) -> DataFrame:
    """Best route per request.

    Input: from_zone, to_zone, densities and any other columns, which are kept.
    Adds path, estimated_seconds, estimated_minutes, reachable, avoided_zones.
    """
    kept = [c for c in requests.columns if c != "densities"]
    found = search(requests, "from_zone", graph)
    cost, path = route_columns(F.col("from_zone"), F.col("to_zone"), graph)
    ends = F.array("from_zone", "to_zone")
    return found.withColumns({"_c": cost, "path": path}).select(
        *kept,
        "path",
        round_half_up(F.col("_c"), 1).alias("estimated_seconds"),
        round_half_up(F.col("_c") / 60, 1).alias("estimated_minutes"),
        F.col("_c").isNotNull().alias("reachable"),
        F.array_except(blocked_zones(F.col("densities")), ends).alias("avoided_zones"),
    )


def spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows spread evenly before searches: a search costs far more than moving its
    row, and small snapshots would otherwise be coalesced into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def searches(
    snapshots: DataFrame, key: str, source: str, sources: list[str] | None = None, graph: Graph = VENUE
) -> DataFrame:
    """One search per snapshot and source zone: (key, source, _cost, _pred).

    However many requests there are, a snapshot needs no more searches than the
    venue has zones; requests are joined to them by (key, source).
    """
    zones = F.array(*[F.lit(z) for z in sources or graph.zones])
    rows = snapshots.select(key, "densities", F.explode(zones).alias(source))
    return search(spread_out(rows, [key, source]), source, graph).drop("densities")


def with_searches(
    requests: DataFrame,
    snapshots: DataFrame,
    key: str,
    source: str,
    sources: list[str] | None = None,
    graph: Graph = VENUE,
) -> DataFrame:
    """Requests with the arrays of the search from their ``source`` at their ``key``.

    Where the snapshot is unknown, the venue counts as empty.
    """
    spark = requests.sparkSession
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    # One row per zone of the venue: a fixed size.
    empty = search(
        spark.range(1).select(none.alias("densities"), F.explode(F.array(*[F.lit(z) for z in sources or graph.zones])).alias(source)),
        source,
        graph,
    ).select(source, F.col("_cost").alias("_empty_cost"), F.col("_pred").alias("_empty_pred"))
    return (
        requests.join(searches(snapshots, key, source, sources, graph), [key, source], "left")
        .join(F.broadcast(empty), source, "left")
        .withColumns({"_cost": F.coalesce("_cost", "_empty_cost"), "_pred": F.coalesce("_pred", "_empty_pred")})
        .drop("_empty_cost", "_empty_pred")
    )


def all_routes(snapshots: DataFrame, key: str = "snapshot", graph: Graph = VENUE) -> DataFrame:
    """Cost and path between all zones, for every snapshot."""
    found = searches(snapshots, key, "from_zone", graph=graph)
    pairs = found.withColumn("to_zone", F.explode(F.array(*[F.lit(z) for z in graph.zones])))
    cost, path = route_columns(F.col("from_zone"), F.col("to_zone"), graph)
    return pairs.select(key, "from_zone", "to_zone", cost.alias("cost"), path.alias("path"))


def walk_columns(source: Column, target: Column, graph: Graph = VENUE) -> tuple[Column, Column]:
    """(path, minutes) after :func:`search`, with fallbacks: no walk inside a zone,
    two minutes straight to the target where no route is passable."""
    cost, path = route_columns(source, target, graph)
    same = source == target
    minutes = round_half_up(cost / 60, 1)
    return (
        F.when(same, F.array(source)).when(cost.isNotNull(), path).otherwise(F.array(source, target)),
        F.when(same, 0.0).otherwise(F.coalesce(minutes, F.lit(2.0))),
    )
