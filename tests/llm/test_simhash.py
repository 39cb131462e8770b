import random
import re

import numpy as np
import pytest
import xxhash

from gatherline.llm import simhash as S


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, bits=4):
    """Smallest position reached from each position, by all pairs."""
    values = np.array(values, np.uint64)
    label, changed = np.arange(len(values)), True
    while changed:
        changed = False
        for i in range(len(values)):
            near = np.bitwise_count(values ^ values[i]) <= bits
            if (label[near] != label[near].min()).any():
                label[near], changed = label[near].min(), True
    return label.tolist()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [fingerprint(t) for _, t in rows]
    label = groups(prints)
    return [(r[0], f"{p:016x}", rows[g][0]) for r, p, g in zip(rows, prints, label, strict=True)]


def near_copies(n, seed=1):
    """A long text and copies with a few words changed, some by chains of changes."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(250)]
    rows = []
    for i in range(n):
        rows.append(" ".join(base))
        base[draw.randrange(len(base))] = word()
    return rows


def test_odd_documents(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.components(odd).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert S.components(odd.limit(0)).collect() == []


def test_chains_of_near_copies(spark, documents):
    texts = near_copies(40) + near_copies(25, 2) + near_copies(1, 3) * 30
    rows = [(1000 + 7 * i % 95 * 10 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in documents.collect()]
    want = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.components(docs).collect()]
    assert sorted(got) == sorted(want)
    assert 1 < len({c for _, _, c in want}) < len(want) - 50


def test_count_filter_drops_pairs_that_meet(spark):
    """All qualifying pairs meet in four postings at least; of the pairs that meet, those that share too little go unverified."""
    draw = random.Random(12)
    values = [draw.getrandbits(64) for _ in range(40)]
    for v in values[:40]:
        values.append(v ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4))))
        kept = draw.sample(range(8), draw.choice([3, 3, 4, 5]))  # shares some bytes, differs much in the others
        values.append(sum((v >> 8 * p & 255 if p in kept else draw.randrange(256)) << 8 * p for p in range(8)))
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = S.postings(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 4).collect()
    assert len(rows) == 56 * len(values)
    lists, meet = {}, {}
    for r in rows:
        lists.setdefault((r.choice, r.shared), []).append(r.fp % 2**64)
    for fps in lists.values():
        for i, a in enumerate(sorted(fps)):
            for b in sorted(fps)[i + 1 :]:
                meet[a, b] = meet.get((a, b), 0) + 1
    pairs = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :]]
    close = {p for p in pairs if (p[0] ^ p[1]).bit_count() <= 4}
    assert all(meet.get(p, 0) >= 4 for p in close)
    differ = np.array([a ^ b for a, b in meet], np.uint64)
    shared = dict(zip(meet, S.tally(differ).tolist(), strict=True))
    dropped = [p for p in meet if shared[p] < 4]
    assert len(dropped) >= 20 and all(meet[p] == 1 for p in dropped)
    assert {p for p, yes in zip(meet, S.near(differ, 4), strict=True) if yes} == close
    unverified = [p for p in meet if shared[p] >= 4 and p not in close]
    assert unverified  # enough bytes shared, too many bits differ
    with pytest.raises(ValueError):
        S.postings(spark.createDataFrame([(1,)], "fp bigint"), 8)


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_long_postings(spark, block):
    draw = random.Random(9)
    center = [draw.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))) for c in center for _ in range(60)}
    values |= {draw.getrandbits(64) for _ in range(100)} | {0}
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = S.groups(S.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 4, block)).collect()
    root = {v: v for v in signed} | {r.member: r.root for r in found}
    label = groups(values)
    for i, v in enumerate(signed):
        members = [signed[j] for j, g in enumerate(label) if g == label[i]]
        assert root[v] == min(members)


def test_groups_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (60, 0)]
    found = {r.member: r.root for r in S.groups(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)}


def test_one_of_each(spark, odd):
    kept = S.one_of_each(odd).collect()
    assert len(kept) == len({fingerprint(r.text) for r in odd.collect()})
    assert kept[0].__fields__ == odd.columns
    blank = [r.doc_id for r in kept if fingerprint(r.text) == 0]
    assert blank == [1]
    assert S.one_of_each(odd.limit(0)).collect() == []
    texts = near_copies(30)
    docs = spark.createDataFrame([(50 - i, t) for i, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    ids = sorted(r.doc_id for r in S.one_of_each(docs).collect())
    assert ids == sorted({c for _, _, c in expected([(50 - i, t) for i, t in enumerate(texts)])})
