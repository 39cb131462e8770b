import hashlib
import random

import numpy as np

from gatherline.llm import winnow as W


def slow(text, gram, window):
    """Kept (hash, position) pairs by the definition."""
    points = [ord(c) + 1 for c in text]
    gram = min(gram, len(points))
    hashes = []
    for i in range(len(points) - gram + 1):
        h = sum(p * pow(W.BASE, j, 1 << 64) for j, p in enumerate(points[i : i + gram])) % (1 << 64)
        h ^= h >> 32
        hashes.append((h * W.MIX % (1 << 64)) >> 24)
    window = min(window, len(hashes))
    kept = []
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not kept or kept[-1][1] != at:
            kept.append((hashes[at], at))
    return kept


def test_rightmost_minimum_of_each_window(monkeypatch):
    draw = random.Random(3)
    for piece in (1 << 20, 7):
        monkeypatch.setattr(W, "PIECE", piece)
        for _ in range(150):
            text = "".join(draw.choice("aab é😀") for _ in range(draw.randint(1, 60)))
            hashes, at = W.winnow(text, 4, 5)
            assert list(zip(hashes.tolist(), at.tolist(), strict=True)) == slow(text, 4, 5)


def test_shared_passages_are_found():
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    for _ in range(100):
        shared = word(W.GRAM + W.WINDOW - 1)
        a, b = word(300) + shared + word(200), word(50) + shared + word(90)
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


def expected(rows):
    """By brute force over all rows in order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, [-b for b in (r[1] or "").encode()] + [1]))
    out = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [set(h for h, _ in slow(t, W.GRAM, W.WINDOW)) if t else set() for t in (text, edited, after)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return out


def test_documents(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    rows += [(i, f"document {i} has words of its own and number {i * 7919}" * 3) for i in range(40, 90)]
    rows = [r for r in rows if r[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = W.compare_with_next(docs).collect()
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert len({r.fingerprint for r in found if r.doc_id == 4}) == 1
    sole = W.compare_with_next(docs.where("doc_id = 3")).first()
    assert (sole.near_next, sole.near_edited > 0) == (1.0, False)
    assert W.compare_with_next(odd).count() == odd.count()
    assert W.compare_with_next(odd.limit(0)).collect() == []


def test_whole_table_order(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    want = {d: e for d, _, e, _, _ in ((*x[:2], x[2], 0, 0) for x in expected_digests(rows))}
    assert {r.doc_id: r.edited_sha256 for r in W.compare_with_next(documents).collect()} == want


def expected_digests(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        yield doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_fingerprints_keep_positions(odd):
    for r in W.fingerprints(odd).collect():
        assert len(r.hashes) == len(r.positions) and list(r.positions) == sorted(set(r.positions))
    assert np.all(np.diff(W.winnow("abc " * 500)[1]) > 0)
