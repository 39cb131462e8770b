"""Language shares of documents by a mixture over n-gram models.

Each language has a model: smoothed frequencies of hashed character n-grams, counted over
the documents labelled with it. A document is a mixture of languages; expectation
maximisation estimates the shares under which its n-grams are likeliest. The set of
languages is the one with the best penalised likelihood: starting from all, the language
with the smallest share is dropped as long as what the likelihood loses is less than the
penalty of the freed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, in_fold

GRAM = 3
BUCKETS = 1 << 16  # a model has as many frequencies, whatever the corpus
STEPS = 12  # of expectation maximisation per language set
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, shares map<string,double>"


def grams(text: str, gram: int = GRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram of a text's lower-case letters, other runs being one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    if not len(points):
        return np.zeros(0, np.int64)
    points = np.where(_letters(points), points, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    if len(points) < gram:
        points = np.concatenate([points, np.full(gram - len(points), 32, np.uint64)])
    value = np.zeros(len(points) - gram + 1, np.uint64)
    for k in range(gram):
        value = value * np.uint64(0x110000) + points[k : len(points) - gram + 1 + k]
    value ^= value >> np.uint64(31)
    value *= MIX
    return (value >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


_table: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _table:
        _table.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _table[0][points]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Models:
    """Log frequencies of the n-gram buckets, a row per language."""

    languages: list[str]
    logs: np.ndarray  # languages x buckets, float32


def learn(labelled: DataFrame, gram: int = GRAM, buckets: int = BUCKETS) -> Models:
    """Models from all documents of (text, lang), counted inside tasks and then added up.

    Rows with a NULL text or language teach nothing. The driver gets a count per language and
    bucket that occurs, at most ``buckets`` for each language.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for langs, texts in batches(rows):
            for lang, text in zip(langs, texts, strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(buckets, np.int64)
                counts[lang] += np.bincount(grams(text, gram, buckets), minlength=buckets) if len(text) > buckets else 0
                if len(text) <= buckets:
                    np.add.at(counts[lang], grams(text, gram, buckets), 1)
        for lang, found in counts.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], names=["lang", "bucket", "n"]
            )

    texts = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'")
    counts = texts.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    table = np.zeros((len(names), buckets))
    index = {n: i for i, n in enumerate(names)}
    table[[index[n] for n in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    smoothed = table + 0.5
    return Models(names, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32))


def mixture(bucket: np.ndarray, count: np.ndarray, models: Models, steps: int = STEPS) -> tuple[np.ndarray, list[int]]:
    """(share of every language, chosen languages) of one document's counted buckets."""
    logs = models.logs[:, bucket].astype(np.float64)
    shift = logs.max(axis=0)
    likely = np.exp(logs - shift)  # of each gram, up to a factor that all sets share
    total = count.sum()
    penalty = 0.5 * np.log(total)

    def fit(chosen: list[int], shares: np.ndarray) -> tuple[np.ndarray, float]:
        part = likely[chosen]
        if len(chosen) > 1:
            for _ in range(steps):
                joint = part * shares[:, None]
                shares = joint @ (count / joint.sum(axis=0)) / total
        return shares, float(count @ np.log(shares @ part + 1e-300))

    chosen = list(range(len(models.languages)))
    shares, value = fit(chosen, np.full(len(chosen), 1 / len(chosen)))
    while len(chosen) > 1:
        weak = int(shares.argmin())
        fewer = chosen[:weak] + chosen[weak + 1 :]
        left = np.delete(shares, weak)
        less, lower = fit(fewer, left / left.sum() if left.sum() > 0 else np.full(len(left), 1 / len(left)))
        if value - lower >= penalty:
            break
        chosen, shares, value = fewer, less, lower
    out = np.zeros(len(models.languages))
    out[chosen] = shares
    return out, chosen


def predict(docs: DataFrame, models: Models, gram: int = GRAM) -> DataFrame:
    """(doc_id, lang_pred, score, shares) of every document's whole text.

    ``lang_pred`` has the largest share (the first by name of equal ones), ``score`` is that
    share. A text that is NULL or has no letter is ``und`` with score 0 and no shares, and so is
    every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        buckets = known.logs.shape[1]
        for doc_ids, texts in batches(rows):
            names, scores, shares = [], [], []
            for text in texts:
                if not known.languages or not has_letter(text):
                    names.append("und"), scores.append(0.0), shares.append([])
                    continue
                bucket, count = np.unique(grams(text, gram, buckets), return_counts=True)
                found, chosen = mixture(bucket, count.astype(np.float64), known)
                best = int(found.argmax())
                names.append(known.languages[best]), scores.append(min(1.0, float(found[best])))
                shares.append([(known.languages[c], float(found[c])) for c in chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(shares, pa.map_(pa.string(), pa.float64())),
                ],
                names=["doc_id", "lang_pred", "score", "shares"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, shares map<string,double>"
    )


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Languages of all documents of (doc_id, text, lang, ...), learned from the other folds.

    Learns from rows with a language whose crc32(doc_id) modulo ``folds`` is not ``held_out``
    (a NULL doc_id is in no fold and teaches). Returns a row per row: doc_id, held_out,
    lang_pred, score, shares. Repeated rows are repeated; other columns are ignored; an empty
    table gives an empty one.
    """
    models = learn(docs.where(~in_fold("doc_id", folds, held_out)))
    return predict(docs, models).select(
        "doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "lang_pred", "score", "shares"
    )
