import hashlib
import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from gatherline.llm.bpe import Automaton, encode_documents

FILE = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    made = Automaton.load(FILE)
    made.spell()
    return made


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_merges_make_an_automaton_of_allowed_successors():
    # a a -> A, A a -> B: of "aaaa" the merges make A A, and B never follows an a that could join it.
    tiny = Automaton([b"a", b"b", b"aa", b"aaa", b"ab"], [(0, 0, 2), (2, 0, 3), (0, 1, 4)], {})
    tiny.spell()

    def merged(text):
        tokens = [0 if c == "a" else 1 for c in text]
        for u, v, w in [(0, 0, 2), (2, 0, 3), (0, 1, 4)]:
            out, i = [], 0
            while i < len(tokens):
                if tokens[i : i + 2] == [u, v]:
                    out.append(w)
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    for n in range(1, 11):
        for bits in range(1 << n):
            text = "".join("ab"[bits >> i & 1] for i in range(n))
            assert np.frombuffer(tiny.encode(text), "<u4").tolist() == merged(text), text


def test_random_texts_match_the_library(automaton, library):
    draw = random.Random(5)
    parts = list("abcthe 'sl\n\t\r01!#é你😀  \x1c") + ["<|endoftext|>", "  ", " the", "'re", "ing", "\n\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", " " * 500, "x" * 5000, "ab" * 700 + " ", "'s's 'll", "a" * 97 + " " + "é" * 120]
    for text, ids, want in zip(texts, automaton.encode_all(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        assert automaton.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_very_long_texts(automaton, library):
    text = "some words and more " * 250_000 + "tail"
    assert np.frombuffer(automaton.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_split_as_in_the_library(automaton, library):
    for c in map(chr, [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xE000, 0x20000, 5)]):
        text = f"a{c}b 1{c} {c}2'{c}"
        assert [m.span() for m in automaton.split.finditer(text)] == [s for _, s in library.pre_tokenizer.pre_tokenize_str(text)]


def test_a_full_memo_changes_nothing(automaton, library, monkeypatch):
    monkeypatch.setattr("gatherline.llm.bpe.MEMO_UNITS", 3)
    automaton.memo = {}
    for text in ("one two three four", "five six one two", "one one one"):
        assert np.frombuffer(automaton.encode(text), "<u4").tolist() == library.encode(text).ids


def test_documents(odd, documents, library):
    for docs in (odd, documents):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (r.text or "").encode())]
            want.append((r.doc_id, len(ids), *digests))
        got = [tuple(r) for r in encode_documents(docs, FILE).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_documents(odd.limit(0), FILE).collect() == []


def test_workers_keep_one_operators_tables(spark, documents):
    """What a worker keeps for encoding stays between tasks and goes when tasks of another operator begin."""
    import pyarrow as pa

    from gatherline.llm import common

    def held(rows):
        for _ in rows:
            yield pa.RecordBatch.from_pydict({"n": [len(common._kept)]})

    one = documents.select("doc_id", "text").limit(50).coalesce(1)
    look = lambda: max(r.n for r in one.mapInArrow(held, "n bigint").collect())
    encode_documents(one, path("byte_bpe_50k.json")).count()
    encode_documents(one, path("byte_bpe_50k.json")).collect()
    assert look() <= 1
    for _ in range(8):  # tasks go to any idle worker
        common.mapped(one, lambda rows: rows, one.schema).collect()
    common.kept("a", lambda: 1)
    assert common.kept("a", lambda: 2) == 1 and common.kept("b", lambda: 3) == 3 and list(common._kept) == ["b"]
    common.keep_only("b")
    assert common._kept
    common.keep_only(None)
    assert not common._kept
