from collections import Counter

import pytest

from gatherline.llm import mixing as M


def expected_targets(sizes):
    """By resharing the excess until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free} if free else {}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: share.get(s, 2.0 * sizes[s]) for s in order}
        full |= above


def check(docs, near):
    found = M.mixed(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size
    want = expected_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], largest[s])
    assert sorted(map(str, M.mixed(docs).collect())) == sorted(map(str, found))
    return found


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = check(docs, 0.02)
    assert found and M.repeated(docs).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in M.repeated(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.epochs for r in found if r.epochs}


def test_budget_ends_in_key_order(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 50 == 0]) for i in range(800)], "doc_id bigint, text string, source string")
    keys = {r.doc_id: r.key for r in M.keyed(docs).collect()}
    for slices in (1, 16, 4096):
        found = M.mixed(docs, slices=slices).collect()
        for source in "ab":
            rows = sorted((r for r in found if r.source == source), key=lambda r: keys[r.doc_id])
            ahead, base = 0, int(rows[0].target // rows[0].source_size)
            rest = rows[0].target - base * rows[0].source_size
            for r in rows:
                assert r.epochs == base + (ahead + r.size / 2 < rest)
                ahead += r.size


def test_heavier_documents_are_taken_more_often(spark):
    texts = ["good words here " * 4, "b@d ##12 w0rds 99 " * 3]
    docs = spark.createDataFrame([(i, texts[i % 2], "ab"[i % 5 == 0]) for i in range(4000)], "doc_id bigint, text string, source string")
    found = [r for r in M.mixed(docs, weights=(1, 9)).collect() if r.source == "a"]
    share = [sum(r.epochs for r in found if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[0] > 1.1 * share[1]


def test_slices_of_light_documents(spark):
    """Documents of the least weight spread over the slices as those of full weight do."""
    from pyspark.sql import functions as F

    for text in ("0123 4567", "plain words"):
        docs = spark.range(20_000).selectExpr("id AS doc_id", f"'{text}' AS text", "'a' AS source")
        place = F.floor(F.col("key") / (1 + F.col("key")) * 64)
        most = M.keyed(docs).groupBy(place.alias("p")).count().agg(F.max("count")).first()[0]
        assert most < 7 * 20_000 / 64


def test_odd_documents(odd):
    docs = odd.withColumnsRenamed({"score": "m_all", "fp": "m_key", "piece": "slice"})
    assert len(check(docs, 0)) == docs.count()
    out = M.repeated(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.epochs for r in M.mixed(docs).collect())
    assert M.mixed(docs.limit(0)).collect() == [] and M.repeated(docs.limit(0)).collect() == []
