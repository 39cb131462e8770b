import random
import zlib

import numpy as np
import pytest

from gatherline.llm import language, quality, toxicity


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and abs(sum(r.shares.values()) - 1) < 1e-6 for r in found)


def test_language_shares_of_mixed_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 1500")
    models = language.learn(docs)
    texts = {r.lang: r.text for r in docs.collect()}
    mix = texts["de"][:1500] + "\n" + texts["es"][:700]
    row = language.predict(spark.createDataFrame([(1, mix)], "doc_id bigint, text string"), models).first()
    assert row.lang_pred == "de" and set(row.shares) == {"de", "es"}
    assert abs(row.shares["de"] - 1500 / 2200) < 0.1


def test_mixture_is_a_maximum():
    rng = np.random.default_rng(2)
    models = language.Models(["a", "b"], np.log(rng.dirichlet(np.ones(8), 2)).astype(np.float32))
    count = rng.integers(1, 50, 8).astype(float)
    share, chosen = language.mixture(np.arange(8), count, models, steps=400)
    value = lambda s: count @ np.log(s * np.exp(models.logs[0]) + (1 - s) * np.exp(models.logs[1]))
    best = max(np.linspace(0.001, 0.999, 999), key=value)
    if len(chosen) == 2:
        assert abs(share[0] - best) < 0.01
    else:
        assert value(best) - value(share[0]) < 0.5 * np.log(count.sum())


def test_language_of_odd_documents(odd):
    found = language.identify(odd, folds=5, held_out=0).collect()
    assert len(found) == odd.count()
    by_text = {r.doc_id: r for r in found}
    assert by_text[1].lang_pred == by_text[2].lang_pred == "und"
    assert language.identify(odd.limit(0)).collect() == []


def words(draw, n):
    return [draw.choice("lorem ipsum dolor sit amet magna aliqua tempor labore enim minim veniam".split()) for _ in range(n)]


def test_toxicity_of_unseen_misspellings(spark):
    draw = random.Random(6)
    texts, y = [], []
    for i in range(600):
        own = words(draw, 60)
        if i % 3 == 0:
            for _ in range(2):
                own[draw.randrange(60)] = draw.choice(["zorgwit", "zorgwits", "azorgwit", "zzorgwit"])
        texts.append(" ".join(own))
        y.append(float(i % 3 == 0))
    model = toxicity.train(texts, np.array(y), 1 / 3)
    bad, good = words(draw, 60), words(draw, 60)
    bad[7] = bad[30] = "zorgwitty!"  # never seen
    scores = toxicity.Scorer(model).scores([" ".join(bad), " ".join(good), None, ""])
    assert scores[0] > 0.6 and scores[1] < 0.1 and scores[2] == scores[3]
    again = toxicity.train(texts, np.array(y), 1 / 3)
    assert np.array_equal(model.vectors, again.vectors)


def average(model, text):
    """The logit of a text, vector by vector."""
    total = np.zeros(toxicity.SIZE)
    own = toxicity.words(text)
    for w in own:
        _, bucket = toxicity.word_grams([w])
        total += model.vectors[bucket].astype(float).mean(axis=0)
    both = toxicity.SCALE * (total / (toxicity.PAD + len(own))) @ model.softmax + model.bias
    return both[1] - both[0]


def test_toxicity_is_as_averaging_vectors():
    """Scores and slopes of the factorised form against vectors averaged one by one and small steps."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 0.1, (toxicity.BUCKETS, toxicity.SIZE)), rng.normal(0, 0.1, (toxicity.SIZE, 2)), np.array([0.2, -0.1]))
    texts = ["the cat sat. The cat sat", "Zorgwit! é <a>", "", "x" * 50 + " the"]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    probability = lambda t: 1 / (1 + np.exp(-average(model, t)))
    assert np.allclose(toxicity.Scorer(model).scores(texts), [probability(t) for t in texts], rtol=1e-6)

    def loss():
        p = np.array([probability(t) for t in texts])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    bags = toxicity.Bags([["other words"], texts])
    slopes = toxicity.slopes_of(model, bags, 1, y)
    used = toxicity.word_grams(["cat", "zorgwit!"])[1][:6]
    for part, values, places in ((0, model.vectors, [(b, 1) for b in used]), (1, model.softmax, [(0, 0), (2, 1)]), (2, model.bias, [(0,), (1,)])):
        for at in places:
            kept, values[at] = values[at], values[at] + 1e-4
            up, values[at] = loss(), kept - 1e-4
            down, values[at] = loss(), kept
            assert np.isclose((up - down) / 2e-4, slopes[part][at], rtol=1e-3, atol=1e-7), (part, at)


def test_word_scores_are_means_over_grams():
    word, bucket = toxicity.word_grams(["abcd", "x"])
    assert np.bincount(word).tolist() == [1 + 4 + 3 + 2, 1 + 1]  # "<abcd>" and "<x>" with the words themselves
    assert bucket.min() >= 0 and bucket.max() < toxicity.BUCKETS


@pytest.mark.parametrize("operator, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_scores_of_odd_documents(spark, odd, operator, label):
    rows = [(None, 1), (1, None), (3, 0), (4, 1), (4, 1), (5, 0), (-6, 1), (2, 7)]
    labels = spark.createDataFrame([(*r, "extra") for r in rows], f"doc_id bigint, {label} int, text string")
    found = operator(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    empty = {r.score for r in found if r.doc_id in (1, 2)}
    assert len(empty) == 1
    assert {r.doc_id for r in found if r.held_out} == {d for d in (1, 2, 3, 4, 5, -6) if zlib.crc32(str(d).encode()) % 4 == 2}
    assert operator(odd.limit(0), labels).collect() == []
    none = operator(odd, labels.limit(0)).collect()
    assert {round(r.score, 9) for r in none} == {0.5}


def test_quality_of_held_out_documents(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_passages_are_counted_as_one_by_one():
    """Features of passages against counting in each passage alone; no trigram crosses a passage."""
    text = " ".join(["some words, here"] * 50 + ["é#!"] + ["x" * 300] + ["end"] * 100)
    found = quality.passages(text)
    own = text.encode().split()
    for p, row in enumerate(found):
        part = own[p * quality.PASSAGE : (p + 1) * quality.PASSAGE]
        body = b"".join(part)
        assert np.allclose(row[: quality.KINDS], np.bincount(quality._kind[list(body)], minlength=quality.KINDS) / len(body))
        alone = quality.passages(b" ".join(part).decode())
        assert len(alone) == 1 and np.allclose(alone[0, quality.KINDS + 5 :], row[quality.KINDS + 5 :])
        assert np.isclose((row[quality.KINDS + 5 :] ** 2).sum(), 1)
    assert quality.passages("").shape == quality.passages("ab").shape == (1, quality.FEATURES)


def test_slopes_of_the_attention_model():
    """A step of training follows the numeric slope of the loss in every kind of weight."""
    texts = ["a b c " * 50, "### # " * 70 + "word " * 90, "one", ""]
    y, made = np.array([0.0, 1.0, 1.0, 0.0]), quality.train(["x"], np.array([1.0]), 0.5)
    rng = np.random.default_rng(1)
    made.params = [rng.normal(0, 0.5, p.shape) for p in made.params]
    bags = [quality.passages(t) for t in texts]
    rows, starts = np.concatenate(bags), np.cumsum([0, *[len(b) for b in bags[:-1]]])
    weight, z, logit, sizes = made.forward(rows, starts)[3:]
    assert np.allclose(np.add.reduceat(weight, starts), 1) and sizes.tolist() == [len(b) for b in bags]
    for i, bag in enumerate(bags):
        alone = made.forward(bag, np.array([0]))
        assert np.allclose(alone[4][0], z[i]) and np.isclose(alone[5][0], logit[i])
        h, t, s = alone[:3]
        energy = np.array([sum(t[p] * s[p] * made.params[4]) for p in range(len(bag))])
        assert np.allclose(alone[3], np.exp(energy) / np.exp(energy).sum())


def test_attention_slopes():
    """The trained direction lowers the loss: attention finds the one telling passage of a document."""
    draw = random.Random(8)
    texts, y = [], []
    for i in range(300):
        parts = [" ".join(words(draw, 64)) for _ in range(5)]
        if i % 2:
            parts[draw.randrange(5)] = " ".join("###" for _ in range(64))
        texts.append(" ".join(parts))
        y.append(float(i % 2))
    model = quality.train(texts[:200], np.array(y[:200]), 0.5)
    assert np.mean((model.scores(texts[200:]) > 0.5) == np.array(y[200:])) > 0.95
    bags = (quality.passages(texts[1]) - model.mean) / model.scale
    weight = model.forward(bags, np.array([0]))[3]
    assert weight.sum() == pytest.approx(1) and weight.argmax() == texts[1].split().index("###") // 64
