import math

import numpy as np
import pytest
from pyspark.sql import Row

from gatherline.llm import negatives
from gatherline.llm.negatives import Summaries, hard_negatives, possible


def brute(rows, every=100, least=80):
    """Hard negatives of (vec_id, embedding, label) rows, pair by pair."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, v in sorted({r for r in kept if r[0] % every == 0}):
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))  # noqa: B023, E731
        others = sorted((-score(w), j) for j, l, w in kept if l == label and j != i)[:5]
        far = sorted((-score(w), j) for j, l, w in kept if l != label)
        for ps, p in others:
            good = [(ns, j) for ns, j in far if 80 * -ps <= 100 * -ns <= 100 * -ps][:5]
            out += [(i, p, k, j, -ps, -ns) for k, (ns, j) in enumerate(good, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").cache()


def test_sample_is_as_brute_force(spark, embeddings):
    rows = [(r.vec_id, r.embedding, r.label) for r in embeddings.collect()]
    want = brute(rows)
    assert len(want) > 30
    assert got(hard_negatives(embeddings.repartition(5))) == want
    assert got(hard_negatives(embeddings, every=20, block=7)) == brute(rows, every=20)


def test_odd_rows(spark):
    """NULLs, non-finite components, repeated rows and ids, ties, vectors of other lengths, clashing columns."""
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (6, 8)).astype(np.float32).tolist()
    rows = [(i, base[i % 6], i % 3) for i in range(60)]
    rows += [(0, base[1], 2), (0, base[1], 2), (10, base[2][:5], 1), (11, base[3] + [9.0], 0), (20, [], 2), (30, None, 1), (40, base[0], None)]
    rows += [(50, [float("nan")] * 8, 1), (51, [None] + base[0][1:], 1), (52, [float("inf")] * 8, 1), (None, base[0], 1), (3, base[3], 0), (3, base[3], 0)]
    rows += [(-10, base[4], 1), (70, [-x for x in base[0]], 0), (80, [1e9, -1e9] * 4, 2), (81, [1e9, 1e9] * 4, 2)]
    df = spark.createDataFrame(
        [Row(vec_id=i, embedding=v, label=label, slot=1, score="x", v=0, h="y", rank=3) for i, v, label in rows],
        "vec_id bigint, embedding array<float>, label int, slot int, score string, v int, h string, rank int",
    )
    want = brute(rows, every=10)
    assert len(want) > 50
    assert got(hard_negatives(df.repartition(7), every=10)) == want
    empty = hard_negatives(df.limit(0))
    assert empty.count() == 0 and empty.columns == hard_negatives(df, every=10).columns
    assert hard_negatives(df.where("vec_id % 10 != 0"), every=10).count() == 0


def test_large_components(spark):
    """Scores too large for doubles are still exact; those too large for 64 bits stay at the limit."""
    rows = [(0, [2.0**40, 1.0], 1), (2, [2.0**-8, 3.0], 1), (1, [2.0**-9, 1.0], 2), (3, [2.0**-8, 2.0], 2), (4, [1e30, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    # Brute force is in whole numbers of any size.
    want = [(a, p, k, n, min(ps, 1 << 62), ns) for a, p, k, n, ps, ns in brute(rows)]
    assert [r for r in got(hard_negatives(df)) if r[1] != 4] == [r for r in want if r[1] != 4]


def test_bounds_hold_and_levels_drop_pairs():
    """No pair in the range is lost, each level leaves fewer pairs, and far pairs go before exact scoring."""
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 60, (8, 64))
    rows = np.floor(middle[rng.integers(0, 8, 900)] + rng.normal(0, 8, (900, 64)))
    anchors = rows[:30]
    exact = anchors @ rows.T
    low, high = exact.max(axis=1) * 0.7, exact.max(axis=1) * 0.9
    wanted = {*zip(*np.nonzero((exact >= low[:, None]) & (exact <= high[:, None])), strict=True)}
    left = []
    for n in range(1, len(negatives.LEVELS) + 1):
        a, r = Summaries(anchors), Summaries(rows)
        a.levels, r.levels = a.levels[:n], r.levels[:n]
        pairs = {*zip(*possible(a, r, low, high, np.ones(exact.shape, bool)), strict=True)}
        assert wanted <= pairs
        left.append(len(pairs))
    assert left == sorted(left, reverse=True) and left[-1] < left[0] <= exact.size and left[-1] < exact.size / 3
