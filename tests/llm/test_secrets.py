import hashlib
import random
import re
import string

import pytest

from gatherline.llm import secrets as S


def expected(text):
    """Base spans by the stated patterns, each failing match dropped after it is found."""
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text, re.A | re.I) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def test_base_patterns():
    draw = random.Random(2)
    parts = ["token", "=", ":", " ", "'", "password", "Secret", "api_key", "APIKEY", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "xyz", ".", "é", "\n", "ſecret", "toKen"]
    scanner = S.Scanner(S.Formats([], None))
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        base, spans = scanner.spans(text)
        assert base == spans == expected(text), text


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    rows = []
    for i in range(400):
        words = [pick(string.ascii_lowercase, draw.randint(16, 22)) for _ in range(20)]
        if i % 4 == 0:
            words.append("password=" + pick("0123456789abcdefghij", 20))
        if i % 4 == 1:
            words.append("AKIA" + pick(string.ascii_uppercase + string.digits, 16))
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_learned_formats_find_unlabelled_credentials(spark, corpus):
    formats = S.learn(corpus)
    other = "he wrote q7x2k9d3m5j8h1f6g4b0 and a verylongordinarywordhere then ANOTHERLONGWORDHERE"
    docs = spark.createDataFrame([(1, other), (2, "plain text only")], "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in S.scan(docs, formats).collect()}
    assert found == {1: "format:9:29" if "q7x2k9d3m5j8h1f6g4b0" not in other else f"format:{other.index('q7x')}:{other.index('q7x') + 20}", 2: ""}
    again = S.learn(corpus)
    assert [a.states for a in again.credentials] == [a.states for a in formats.credentials]


def test_every_candidate_is_scored():
    """A credential of which a base pattern matches the middle is masked as a whole; one inside a base span is told once."""
    draw = random.Random(1)
    some = lambda classes, n: "".join(draw.choice(classes) for _ in range(n))
    tokens = ["lll_" + some("dh", 20) + some("Lld", 10) for _ in range(300)]
    formats = S.Formats([S.Automaton(tokens)], S.Automaton(["l" * (16 + i % 9) for i in range(300)]))
    scanner = S.Scanner(formats, margin=0.0)
    text = "see ghp_0123456789abcdef0123Zq9XyTtUvW, token = 0123Zq9XyTtUvW0123Zq, justanordinarylongword"
    base, spans = scanner.spans(text)
    assert base == expected(text) and [k for _, k, _ in base] == [2, 0]
    assert spans == base + [(4, 3, 38)]
    assert S.masked(text, spans) == "see [SECRET], [SECRET], justanordinarylongword"
    asked = []
    scanner._secret = lambda c: asked.append(c) or False
    scanner.spans(text)
    assert asked == [m.group() for m in S.CANDIDATE.finditer(text)] and len(asked) == 3


def test_sweep_is_as_all_pairs():
    draw = random.Random(8)
    for _ in range(2000):
        spans = sorted((a, a + draw.randint(1, 9)) for a in (draw.randrange(60) for _ in range(draw.randrange(8))))
        cuts = sorted(draw.sample(range(70), 2 * draw.randint(1, 5)))
        wanted = list(zip(cuts[::2], cuts[1::2], strict=True))
        assert S.covered(spans, wanted, False) == [any(s < e and b < f for s, f in spans) for b, e in wanted]
        assert S.covered(spans, wanted, True) == [any(s <= b and e <= f for s, f in spans) for b, e in wanted]


def test_likelihood_is_that_of_the_paths():
    """Against multiplying the share of each class and of ending, state by state; merged states pool their counts."""
    import math

    formats = ["dd", "dd", "dh", "l", "ll", "lll"] * 30
    tree = S.Automaton(formats, alpha=2.0)  # a bound of zero: nothing is merged but what is equal
    seen = lambda p: sum(f.startswith(p) for f in formats)
    for f in ("dd", "dh", "l", "lll"):
        chance = 1.0
        for i in range(len(f)):
            chance *= seen(f[: i + 1]) / seen(f[:i]) * (1 - S.UNSEEN * len(S.ALPHABET)) + S.UNSEEN
        chance *= formats.count(f) / seen(f)
        assert math.isclose(tree.log_likelihood(f), math.log(chance), rel_tol=1e-9)
    made = S.Automaton(formats)
    assert sum(s.n for s in made.states) == sum(len(f) + 1 for f in formats) and len(made.states) < len(tree.states)


def test_large_text_of_hex(spark):
    """A text of 4 MB full of base spans takes a linear time."""
    import time

    text = " ".join(f"{i:016x}" for i in range(240_000))
    scanner = S.Scanner(S.Formats([], None))
    started = time.process_time()
    base, spans = scanner.spans(text)
    assert len(base) == len(spans) == 240_000 and time.process_time() - started < 20
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id bigint, text string")
    assert S.scan(docs).where("doc_id = 1").first().n_hex == 240_000


def test_automata_generalise_and_sum_to_one():
    made = S.Automaton(["dd" + "h" * (i % 5) for i in range(400)])
    assert len(made.states) < 12
    total = sum(
        pow(2.718281828459045, made.log_likelihood("dd" + "h" * n)) for n in range(12)
    )
    assert 0.9 < total < 1.1


def test_odd_documents(odd):
    found = S.scan(odd).collect()
    texts = [r.text or "" for r in odd.collect()]
    want = sorted(hashlib.sha256(S.joined(expected(t)).encode()).hexdigest() for t in texts)
    assert sorted(r.base_sha256 for r in found) == want
    assert sum(r.n_access for r in found) == 1 and sum(r.n_hex for r in found) == 1 and sum(r.n_assign for r in found) == 2
    assert S.scan(odd.limit(0)).collect() == []


def test_masking(odd):
    assert S.masked("ab SECRET cd", [(3, 0, 7), (5, 2, 9)]) == "ab [SECRET] cd"
    out = S.without_secrets(odd, S.learn(odd)).collect()
    before = odd.collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in before] and out[0].__fields__ == odd.columns
    changed = next(r for r in out if r.doc_id == -6)
    assert changed.text == "[SECRET] [SECRET] [SECRET]" or "[SECRET]" in changed.text
    assert changed.n_chars == len(changed.text)
    assert [r for r in out if r.doc_id in (1, 2, 3, 4)] == [r for r in before if r.doc_id in (1, 2, 3, 4)]
