"""Document quality by attention over passages.

A document is a bag of passages of a fixed number of words; only the document has a label.
Each passage is encoded from its byte trigrams (hashed), kinds of characters, and lengths
and repeats of words, by a layer that is learned with the rest; a gated attention (a tanh and a sigmoid branch, multiplied) weighs the encodings, and the
weighted mean is scored. All weights are trained together in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_fold, labelled_sample

PASSAGE = 64  # words
HIDDEN, GATE = 16, 8
PER_CLASS = (3000, 3000)  # labelled documents of each class to learn from, at most
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4
THRESHOLD = 0.7

#: Kinds of bytes of UTF-8 text: each ASCII mark for itself, letters, digits, spaces, other bytes.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
KINDS = 6 + len(_MARKS)
_kind = np.full(256, 5, np.int64)
_kind[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_kind[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_kind[list(b"0123456789")] = 2
_kind[list(b" ")] = 3
_kind[[*range(9), *range(9, 32), 127]] = 4
_kind[_MARKS] = 6 + np.arange(len(_MARKS))
GRAMS, QUIET = 96, 8.0  # buckets of trigrams, and how much less they weigh than the rest at first
FEATURES = KINDS + 5 + GRAMS
_MIX = np.array([2_654_435_761, 2_246_822_519, 3_266_489_917], np.uint32)  # odd factors of the three bytes


def passages(text: str | None) -> np.ndarray:
    """Features of every passage of a text, a row each; an empty text is one passage without words."""
    words = text.encode().split() if text else []
    n = max(1, -(-len(words) // PASSAGE))
    out = np.zeros((n, FEATURES))
    if not words:
        return out
    sizes = np.array([len(w) for w in words])
    owner = np.arange(len(words)) // PASSAGE
    count = np.bincount(owner, minlength=n)
    chars = np.bincount(owner, sizes, n)
    body = np.frombuffer(b"".join(words), np.uint8)
    kinds = np.bincount(np.repeat(owner, sizes) * KINDS + _kind[body], minlength=n * KINDS).reshape(n, KINDS)
    out[:, :KINDS] = kinds / chars[:, None]
    mean = chars / count
    seen: set[bytes] = set()
    for p in range(n):
        own = set(words[p * PASSAGE : (p + 1) * PASSAGE])
        out[p, KINDS] = len(own) / count[p]
        out[p, KINDS + 1] = len(own - seen) / len(own)
        seen |= own
    out[:, KINDS + 2] = mean / 10
    out[:, KINDS + 3] = np.sqrt(np.maximum(np.bincount(owner, sizes.astype(float) ** 2, n) / count - mean**2, 0)) / 10
    out[:, KINDS + 4] = count / PASSAGE
    if len(body) > 2:
        wide = body.astype(np.uint32)
        mixed = (wide[:-2] * _MIX[0] ^ wide[1:-1] * _MIX[1] ^ wide[2:] * _MIX[2]) * _MIX[0]
        bucket = (mixed >> np.uint32(16)) % np.uint32(GRAMS)
        passage = np.repeat(owner, sizes)
        inside = passage[2:] == passage[:-2]
        grams = np.bincount(passage[2:][inside] * GRAMS + bucket[inside], minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, KINDS + 5 :] = np.sqrt(grams / np.maximum(grams.sum(axis=1, keepdims=True), 1))
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]  # encoder W, b; gates V, U, w; score c, b
    shift: float  # to the labels' shares

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> tuple:
        """Encodings, gates, attention weights, weighted means and logits of stacked documents."""
        encode, encode_bias, tanh_gate, sigmoid_gate, attend, out, out_bias = self.params
        h = np.tanh(rows @ encode + encode_bias)
        t, s = np.tanh(h @ tanh_gate), 1 / (1 + np.exp(-(h @ sigmoid_gate)))
        energy = (t * s) @ attend
        sizes = np.diff(np.append(starts, len(rows)))
        top = np.repeat(np.maximum.reduceat(energy, starts), sizes)
        weight = np.exp(energy - top)
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return h, t, s, weight, z, z @ out + out_bias[0], sizes

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [passages(t) for t in texts]
        rows = (np.concatenate(found) - self.mean) / self.scale
        starts = np.cumsum([0, *[len(f) for f in found[:-1]]])
        logits = self.forward(rows, starts)[5] + self.shift
        # Rounded: sums over a stack may differ in the last bits from stack to stack.
        return np.round(1 / (1 + np.exp(-np.clip(logits, -500, 500))), 12)


def train(texts: list[str], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 11, attention: bool = True) -> Model:
    """Fit encoder, attention and score by Adam on batches of documents; ``share``: of label 1 among all labels.

    Without ``attention`` all passages of a document weigh the same (to compare with).
    """
    rng = np.random.default_rng(seed)
    start = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    params = [
        start(FEATURES, HIDDEN), np.zeros(HIDDEN), start(HIDDEN, GATE), start(HIDDEN, GATE),
        start(GATE, 1)[:, 0], start(HIDDEN, 1)[:, 0], np.zeros(1),
    ]
    model = Model(np.zeros(FEATURES), np.ones(FEATURES), params, 0.0)
    learned = [attention or k not in (2, 3, 4) for k in range(len(params))]
    params[4][:] *= attention
    if len(set(y.tolist())) < 2:
        params[5][:] = 0
        model.shift = float(np.log(share / (1 - share)))
        return model
    bags = [passages(t) for t in texts]
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    model.scale[KINDS + 5 :] *= QUIET  # trigrams are many: few documents must not learn them by heart
    bags = [(b - model.mean) / model.scale for b in bags]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            rows = np.concatenate([bags[j] for j in part])
            starts = np.cumsum([0, *[len(bags[j]) for j in part[:-1]]])
            h, t, s, weight, z, logit, sizes = model.forward(rows, starts)
            encode, _, tanh_gate, sigmoid_gate, attend, out, _ = params
            error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y[part]) / len(part)
            to_z = np.repeat(error[:, None] * out, sizes, axis=0)
            value = (to_z * h).sum(axis=1)  # how the loss changes with each weight
            to_energy = weight * (value - np.repeat(np.add.reduceat(weight * value, starts), sizes))
            to_t = to_energy[:, None] * attend * s * (1 - t * t)
            to_s = to_energy[:, None] * attend * t * s * (1 - s)
            to_h = (weight[:, None] * to_z + to_t @ tanh_gate.T + to_s @ sigmoid_gate.T) * (1 - h * h)
            slopes = [rows.T @ to_h, to_h.sum(axis=0), h.T @ to_t, h.T @ to_s, (t * s).T @ to_energy, z.T @ error, np.array([error.sum()])]
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, m, v in (x for x, yes in zip(zip(params, slopes, first, second, strict=True), learned, strict=True) if yes):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    seen = y.mean()
    model.shift = float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return model


def quality(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, per_class: tuple[int, int] = PER_CLASS
) -> DataFrame:
    """Quality of all documents of (doc_id, text, ...), learned from (doc_id, quality, ...).

    Learns from at most ``per_class`` labelled documents of each class (0, 1) whose crc32(doc_id)
    modulo ``folds`` is not ``held_out``. Returns a row per row: doc_id, held_out, score (0 to 1),
    predicted (1 if score >= ``threshold``). NULL, empty and blank texts are one passage without
    words; NULL labels and ids teach nothing, and a NULL id is in no fold; with one class or none
    the score is the share of label 1; repeated rows are repeated; other columns are ignored; an
    empty table gives an empty one.
    """
    model = train(*labelled_sample(docs, labels, "quality", per_class, folds, held_out))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in batches(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(shared.value.scores(texts), pa.float64())], names=["doc_id", "score"]
            )

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    return found.select(
        "doc_id",
        in_fold("doc_id", folds, held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
