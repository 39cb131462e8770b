"""Line-frequency rules over documents: base counts, and lines that a host repeats.

All of it is column expressions. Lines are normalised and hashed to 128 bits; the
documents of each (host, line) are counted; lines in more documents than the limit are
removed, and a document that loses too many of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "[#*$%&|<>]"
#: White space that isn't a single space between words already, so that few places of a text are rewritten.
GAPS = "[\\x20\\x09-\\x0D](?:(?<!\\x20)[\\x20\\x09-\\x0D]*|[\\x20\\x09-\\x0D]+)"
LINE_DOCS = 50  # a line in more documents of its host is removed
LOST_SHARE = 0.5  # a document that loses more of its words is rejected
LEAST_WORDS = 50


def with_repeat_words(docs: DataFrame, w: str) -> DataFrame:
    """``docs`` with n_repeat_words: words inside 3-word windows that occur twice or more in the array ``w``.

    Windows are compared by 64-bit hashes, computed once. Only where a hash comes again they are
    sorted with their positions: equal neighbours are the repeated ones, each covers three words.
    """
    n = F.size(w)
    hashes = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda a, i: F.xxhash64(a, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)),
    )
    # Columns of their own bind a value once; distinct values and sorts outside lambdas run as compiled code.
    placed = F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    beside = lambda j: F.get(F.col("_placed"), j)["h"]
    again = F.filter("_placed", lambda x, j: (x["h"] == beside(j - 1)) | (x["h"] == beside(j + 1)))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    found = F.when(F.col("_placed").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return (
        docs.withColumn("_hashes", hashes)
        .withColumn("_placed", placed)
        .withColumn("n_repeat_words", found.cast("bigint"))
        .drop("_hashes", "_placed")
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = (
        # One-character patterns are split on without a regular expression.
        docs.withColumn("_words", F.array_remove(F.split(F.regexp_replace(t, "[\\x09-\\x0D]+", " "), " ", -1), ""))
        .withColumn("_lines", F.filter(F.split(t, "\n", -1), has_word))
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
                "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            }
        )
        .drop("_lines")
    )
    return with_repeat_words(counted, "_words").drop("_words")


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)) != ""


def single_spaced(text: Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.btrim(F.regexp_replace(text, GAPS, " "))


def normal_line(line: Column) -> Column:
    """A line in lower case, digits as 0, single spaces between its words."""
    return single_spaced(F.regexp_replace(F.lower(line), "[1-9]", "0"))


def line_key(line: Column) -> Column:
    """128-bit hash of a normalised line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def repeated_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(doc_id, host, text_key, lost, lines): what each document loses, and the keys of those lines.

    A row per document that loses any. A line counts once per document id, hosts may be NULL
    (a host of their own), and a NULL doc_id counts as one document. ``text_key`` is the text's
    hash: what a document loses follows from its host, its id and its text. Counts are
    combined before they are shuffled, first by (host, line, document), then by (host, line).
    """
    lines = F.split("text", "\n", -1)
    each = (
        docs.select("doc_id", F.col(host).alias("host"), text_key(F.col("text")).alias("text_key"), F.explode(lines).alias("line"))
        .where(has_word(F.col("line")))
        .withColumn("line", normal_line(F.col("line")))
        .select(
            "doc_id",
            "host",
            "text_key",
            line_key(F.col("line")).alias("key"),
            (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n"),
        )
    )
    of_line = (
        each.select("doc_id", "host", "key")
        .distinct()
        .groupBy("host", "key")
        .count()
        .where(F.col("count") > line_docs)
        .select(F.col("host").alias("l_host"), F.col("key").alias("l_key"))
    )
    frequent = each.join(
        of_line, (F.col("key") == F.col("l_key")) & F.col("host").eqNullSafe(F.col("l_host")), "left_semi"
    )
    return frequent.groupBy("doc_id", "host", "text_key").agg(F.sum("n").alias("lost"), F.collect_set("key").alias("lines"))


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def _with_lost(docs: DataFrame, lost: DataFrame) -> DataFrame:
    lost = lost.withColumnsRenamed({"doc_id": "l_doc", "host": "l_host", "text_key": "l_key"})
    return docs.join(
        lost,
        (F.col("text_key") == F.col("l_key"))
        & F.col("doc_id").eqNullSafe(F.col("l_doc"))
        & F.col("host").eqNullSafe(F.col("l_host")),
        "left",
    ).drop("l_doc", "l_host", "l_key")


def line_rules(
    docs: DataFrame,
    host: str = "source",
    line_docs: int = LINE_DOCS,
    lost_share: float = LOST_SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Base counts of every document of (doc_id, text, host column, ...), and whether it is kept.

    ``base_failed``: fewer than ``least_words`` words, or more than half of them in repeated
    windows. ``kept``: not failed, and at most ``lost_share`` of the words are in lines that
    more than ``line_docs`` documents of the host have. Returns doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words. A row per row:
    repeated rows have equal results and count as one document; a NULL text has no words; a
    NULL host is a host of its own; other columns are ignored; an empty table gives an empty one.
    """
    own = docs.select("doc_id", "text", F.col(host).alias("host"))
    counts = base_counts(own.withColumn("text_key", text_key(F.col("text")))).drop("text")
    joined = _with_lost(counts, repeated_lines(own, "host", line_docs).drop("lines"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("lost", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (gone <= lost_share * F.col("n_words"))).alias("kept"),
        gone.alias("lost_words"),
    )


def without_lines(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(doc_id, host, text) with the lines removed that more than ``line_docs`` documents of the host have."""
    own = docs.select("doc_id", "text", F.col(host).alias("host")).withColumn("text_key", text_key(F.col("text")))
    joined = _with_lost(own, repeated_lines(own, "host", line_docs).select("doc_id", "host", "text_key", "lines"))
    rest = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("lines"), line_key(normal_line(x))))
    return joined.select(
        "doc_id", "host", F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text")
    )


SQL = """
WITH base AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
win AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM base, unnest(range(1, len(w) - 1)) AS u(i)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
lines AS (
    SELECT rid, doc_id, source, line FROM base, unnest(string_split(t, chr(10))) AS u(line)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
norm AS (
    SELECT rid, doc_id, source,
           trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line
    FROM lines
),
often AS (SELECT source, line FROM norm GROUP BY source, line HAVING count(DISTINCT doc_id) > 50),
lost AS (
    SELECT rid, sum(len(string_split(line, ' '))) AS n FROM norm
    WHERE EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM norm.source AND o.line = norm.line)
    GROUP BY rid
),
counted AS (
    SELECT doc_id, len(w)::BIGINT AS n_words,
           length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
           coalesce(lost.n, 0)::BIGINT AS lost_words
    FROM base LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= 0.5 * n_words AS kept,
       lost_words
FROM counted
"""
