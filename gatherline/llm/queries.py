"""Every operator of this package as a query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from . import line_frequency, negatives
from .common import table
from .conversations import damaged, repair_report
from .language import identify
from .mixing import mixed
from .packing import packed_pieces, piece_digests
from .quality import quality
from .secrets import scan
from .simhash import components
from .toxicity import toxicity
from .warc import archive_pages
from .winnow import compare_with_next


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    return encode_documents(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_winnow(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return compare_with_next(table(spark, folder, "documents"))


def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document, and whether the lines its source repeats leave enough of it."""
    return line_frequency.line_rules(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-copy group of every document."""
    return components(table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, by shares learned from the other folds."""
    return identify(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Index of the archives of all pages, in order of URL and time."""
    return archive_pages(table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the other folds' labels."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the other folds' labels."""
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    return mixed(table(spark, folder, "documents"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base matches and learned formats."""
    return scan(table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return piece_digests(packed_pieces(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json")))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair, and a digest of what that leaves."""
    rows = table(spark, folder, "conversations")
    return repair_report(damaged(rows), rows)


def text_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_winnow": op2_winnow,
        "op3_line_frequency": op3_line_frequency,
        "op4_simhash": op4_simhash,
        "op5_language": op5_language,
        "op6_warc": op6_warc,
        "op7_secrets": op7_secrets,
        "op8_toxicity": op8_toxicity,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_packing": op11_packing,
        "op12_negatives": op12_negatives,
        "op13_conversations": op13_conversations,
    }


def text_oracle() -> dict[str, str]:
    """SQL of the queries that it can express."""
    return {"op3_line_frequency": line_frequency.SQL, "op12_negatives": negatives.SQL}
