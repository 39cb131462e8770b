"""The corpus pipeline: stages from raw documents to token counts.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps, with the columns of ``documents``; the last returns its result. Each
stage works on all that the one before kept: toxic documents go, one document of each
group of near copies stays, secrets are masked, sources are repeated or thinned to their
targets, and every row is encoded.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from gatherline.llm.bpe import encode_documents
from gatherline.llm.common import table, written
from gatherline.llm.mixing import repeated
from gatherline.llm.secrets import learn, without_secrets
from gatherline.llm.simhash import one_of_each
from gatherline.llm.toxicity import fitted, not_toxic

#: A SimHash stage uses the shingle length and bit distance of its operator's contract.
SHINGLE, BITS = 4, 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of three of four folds, does not reject."""
    return not_toxic(docs, fitted(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints, that of the smallest id."""
    return one_of_each(docs, SHINGLE, BITS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return without_secrets(docs, learn(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return encode_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and seeded draws have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
