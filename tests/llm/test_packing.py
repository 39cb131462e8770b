import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer
from tokenizers import Tokenizer

from gatherline.llm.packing import Pool, Tokens, best_fill, packed_pieces, piece_digests

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokens():
    with open(PATH, encoding="utf-8") as file:
        return Tokens(file.read())


def test_fill_is_the_closest_of_all_multisets():
    rng = random.Random(3)
    for _ in range(300):
        counts = [(n, rng.randint(1, 4)) for n in sorted(rng.sample(range(1, 40), rng.randint(0, 5)), reverse=True)]
        capacity = rng.randint(0, 60)
        sums = {sum(n * k for (n, _), k in zip(counts, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for _, c in counts])}
        taken = best_fill(counts, capacity)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= capacity)
        assert all(0 < k <= dict(counts)[n] for n, k in taken.items())


def test_ids_are_the_librarys(tokens, library):
    rng = random.Random(5)
    signs = "aZ é́ ß Σς 's 'LL 12 ½     \t\n 😀 İ ﬁ İx ﷺ 汉字 <|endoftext|> < | > .,;!? \x1c \x85 ̈ 가"
    texts = ["".join(rng.choice(signs + "  ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in [*texts, "", " ", "x" * 50_000, "ab cd " * 100_000 + "z" * 2_000_000]:
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert tokens.encode(text) == want, text[:80]


def test_memo_ages_between_long_and_short_texts(tokens, library, monkeypatch):
    """Texts of one batch, long ones among them, are encoded right while the memo is thrown out."""
    from gatherline.llm import packing

    monkeypatch.setattr(packing, "MEMO_UNITS", 50)
    monkeypatch.setattr(packing, "SLICE_CHARS", 400)
    texts = [" ".join(f"w{i}x{j}. {'y' * (j % 90)}" for j in range(n)) for i, n in enumerate((3, 200, 5, 400, 8))]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tokens.encode_all(texts)) == want


def sequences_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append(r)
    return {s: sorted(p, key=lambda r: r.offset) for s, p in found.items()}


def check(rows, window=2048):
    """Sequences without gaps, full or a power of two; documents without gaps or overlaps."""
    for pieces in sequences_of(rows).values():
        at = 0
        for p in pieces:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0
    documents = defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
    return documents


def test_documents_come_back(spark, documents, library):
    rows = packed_pieces(documents, PATH).collect()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    found = check(rows)
    assert found.keys() == texts.keys()
    for doc_id, pieces in found.items():
        want = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces[:-1])]
        assert {p.doc_tokens for p in pieces} == {len(want) // 4}
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in piece_digests(packed_pieces(documents, PATH)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in rows}


def test_odd_documents(spark, odd):
    one = packed_pieces(odd.coalesce(1), PATH, window=64, pool=100)
    rows = one.collect()
    check(rows, 64)
    assert one.columns == "doc_id start length ids doc_tokens sequence_id offset".split()
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert [r.doc_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert any(r.doc_id is None for r in rows)
    assert packed_pieces(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packed_pieces(odd, PATH, window=0)


def test_few_cuts_and_no_padding():
    """Random lengths: windows are full, a bounded pool drops nothing, and few documents are cut."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1500, 20_000)
    pool, out = Pool(2048, 1 << 20), []
    for i, n in enumerate(lengths):
        out += pool.put(i, np.arange(n, dtype="<u4"))
        assert pool.tokens <= 1 << 20
    out += pool.drained()
    sizes = [sum(len(p[2]) for p in s) for s in out]
    assert sum(sizes) == lengths.sum() and sum(s != 2048 for s in sizes) <= 11
    assert sum(map(len, out)) < 1.03 * len(lengths)


@pytest.mark.parametrize("length", [1, 700, 1500, 2047, 2048, 2049])
def test_equal_lengths_are_cut(length):
    """A corpus of one length fills its windows as well."""
    pool, out = Pool(2048, 50_000), []
    for i in range(300):
        out += pool.put(i, np.arange(length, dtype="<u4"))
    out += pool.drained()
    back = defaultdict(dict)
    for pieces in out:
        size = sum(len(p[2]) for p in pieces)
        assert size == 2048 or size & (size - 1) == 0
        for doc, start, ids in pieces:
            back[doc].update(zip(range(start, start + len(ids)), ids.tolist(), strict=True))
    assert all(back[i] == dict(zip(range(length), range(length), strict=True)) for i in range(300))
