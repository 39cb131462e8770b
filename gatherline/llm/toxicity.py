"""Toxicity by bags of subword vectors under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with its ends
marked) and of the word itself, all hashed into one table; a document's is the mean over
its words and a fixed number of zero vectors. A linear softmax scores it. Table and softmax are trained together in numpy,
so that a misspelling never seen before still has the vectors of the n-grams it shares.

Both steps are linear: what a document's mean scores is the mean of what its n-grams
score. Training passes and scoring use that; the model stays the table and the softmax.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_fold, labelled_sample, mapped, release_memory, sliced

GRAMS = (3, 4, 5)
BUCKETS, SIZE = 1 << 17, 4
PER_CLASS = (6000, 1500)  # labelled documents to learn from, at most: not toxic, toxic
STEPS, BATCH, RATE, DECAY = 320, 256, 0.05, 2e-4
SCALE = 64.0  # of a document's mean: few of its words tell
PAD = 20  # zero vectors in every mean, so that a few odd words are no verdict
MEMO_WORDS = 100_000
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_grams(spelled: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the words, without the marks at their ends, and of each word."""
    marked = ["<" + (w.strip(EDGES) or w) + ">" for w in spelled]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    at, buckets = [np.arange(len(marked))], [np.array([zlib.crc32(m.encode()) for m in marked], np.int64) % BUCKETS]
    for n in GRAMS:
        if len(points) < n:
            continue
        value = np.zeros(len(points) - n + 1, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(value)] == owner[n - 1 :]
        at.append(owner[: len(value)][inside])
        buckets.append((value[inside] >> np.uint64(64 - 17)).astype(np.int64))
    return np.concatenate(at), np.concatenate(buckets)


class Bags:
    """Bags of the documents to learn from: the n-grams of every distinct word once, and each batch's words.

    A batch is (document, place of the word among the batch's distinct ones, weight in the document's mean,
    the distinct words' numbers); a document's words are shared by all that have them.
    """

    def __init__(self, batches_of_texts: list[list[str]]):
        numbers: dict[str, int] = {}
        sizes, grams = [], []
        self.batches = []
        for texts in batches_of_texts:
            docs, own, weights, fresh = [], [], [], []
            for i, text in enumerate(texts):
                counts = Counter(words(text))
                total = PAD + sum(counts.values())
                for word, n in counts.items():
                    if (number := numbers.get(word)) is None:
                        number = numbers[word] = len(numbers)
                        fresh.append(word)
                    docs.append(i)
                    own.append(number)
                    weights.append(n / total)
            for start in range(0, len(fresh), 5000):
                part = fresh[start : start + 5000]
                word, bucket = word_grams(part)
                order = np.argsort(word, kind="stable")
                grams.append(bucket[order].astype(np.int32))
                sizes.append(np.bincount(word, minlength=len(part)).astype(np.int32))
            distinct, place = np.unique(np.array(own, np.int32), return_inverse=True)
            self.batches.append((np.array(docs, np.int16), place.astype(np.int32), np.array(weights, np.float32), distinct))
        self.sizes = np.concatenate([np.zeros(0, np.int32), *sizes])
        self.grams = np.concatenate([np.zeros(0, np.int32), *grams])
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def of(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, bucket) of every n-gram of the words with these numbers."""
        size = self.sizes[distinct]
        place = np.repeat(np.arange(len(distinct), dtype=np.int32), size)
        first = np.cumsum(size, dtype=np.int64) - size
        return place, self.grams[np.arange(len(place)) - (first - self.starts[distinct])[place]]


@dataclass
class Model:
    """N-gram vectors, the softmax over (not toxic, toxic), and the shift to the labels' shares."""

    vectors: np.ndarray  # BUCKETS x SIZE
    softmax: np.ndarray  # SIZE x 2
    bias: np.ndarray  # 2

    def gram_scores(self) -> np.ndarray:
        """What each n-gram adds to the toxic logit less the other, per unit of weight."""
        return SCALE * (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))

    def intercept(self) -> float:
        return float(self.bias[1] - self.bias[0])


def slopes_of(model: Model, bags: Bags, batch: int, want: np.ndarray) -> list[np.ndarray]:
    """Slopes of the mean loss of a batch in the vectors, the softmax and the bias."""
    doc, place, weight, distinct = bags.batches[batch]
    word, bucket = bags.of(distinct)
    size, n = bags.sizes[distinct], len(want)
    lean = model.softmax[:, 1] - model.softmax[:, 0]
    word_score = np.bincount(word, (model.vectors @ lean)[bucket], len(distinct)) / size
    logit = SCALE * np.bincount(doc, weight * word_score[place], n) + model.intercept()
    error = (1 / (1 + np.exp(-logit)) - want) / n  # of the toxic class; the other's is its opposite
    word_error = np.bincount(place, weight * error[doc], len(distinct)) / size
    pull = SCALE * np.bincount(bucket, word_error[word], BUCKETS)
    mean_error = model.vectors.T @ pull
    return [
        np.outer(pull, lean).astype(np.float32),
        np.stack([-mean_error, mean_error], axis=1),
        np.array([-error.sum(), error.sum()]),
    ]


def train(texts: list[str], y: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit vectors and softmax together by Adam on batches of documents; ``share``: of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32), rng.normal(0, 0.1, (SIZE, 2)), np.zeros(2))
    if len(set(y.tolist())) < 2:
        model.vectors[:] = 0
        model.bias[:] = 0, np.log(share / (1 - share))
        return model
    order = rng.permutation(len(texts))
    parts = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    bags = Bags([[texts[i] for i in part] for part in parts])
    wanted = [y[part] for part in parts]
    params = [model.vectors, model.softmax, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    turn: list[int] = []
    for step in range(1, steps + 1):
        turn = turn or rng.permutation(len(parts)).tolist()
        at = turn.pop()
        rate = RATE * (1 - (step - 1) / steps)
        slopes = slopes_of(model, bags, at, wanted[at])
        slopes[0] += np.float32(DECAY) * model.vectors
        for p, g, m, v in zip(params, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    seen = y.mean()
    model.bias[1] += np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return model


class Scorer:
    """Scores texts; remembers what words score."""

    def __init__(self, model: Model):
        self.grams, self.intercept = model.gram_scores(), model.intercept()
        self.memo: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        cut = [words(t) for t in texts]
        own = {w for ws in cut for w in ws}
        new = list(own.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo, new = {}, list(own)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            word, bucket = word_grams(part)
            mean = np.bincount(word, self.grams[bucket], len(part)) / np.bincount(word, minlength=len(part))
            self.memo.update(zip(part, mean.tolist(), strict=True))
        value = self.memo.__getitem__
        logits = [self.intercept + sum(map(value, ws)) / (PAD + len(ws)) for ws in cut]
        return [float(1 / (1 + np.exp(-min(max(x, -500.0), 500.0)))) for x in logits]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document's whole text; a text without words has the intercept's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for doc_ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(scorer.scores(texts), pa.float64())], names=["doc_id", "score"]
            )

    return mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: tuple[int, int] = PER_CLASS) -> Model:
    model = train(*labelled_sample(docs, labels, "toxic", per_class, folds, held_out))
    release_memory()
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, per_class: tuple[int, int] = PER_CLASS
) -> DataFrame:
    """Toxicity of all documents of (doc_id, text, ...), learned from (doc_id, toxic, ...).

    Learns from at most ``per_class`` labelled documents of each class (0, 1) whose crc32(doc_id) modulo
    ``folds`` is not ``held_out``. Returns a row per row: doc_id, held_out, score (0 to 1),
    predicted (1 if score >= ``threshold``). NULL, empty and blank texts have the score of no
    words; NULL labels and ids teach nothing, and a NULL id is in no fold; with one class or none
    the score is the share of label 1; repeated rows are repeated; other columns are ignored; an
    empty table gives an empty one.
    """
    return scored(docs, fitted(docs, labels, folds, held_out, per_class)).select(
        "doc_id",
        in_fold("doc_id", folds, held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def not_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(rows, at):
            keep = [s < threshold for s in scorer.scores(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
