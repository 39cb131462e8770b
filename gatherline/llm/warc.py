"""WARC archives of pages, and their index merged to capture histories.

Pages become WARC records, written by Spark's text writer with the blank line between
records as separator, one gzip file (an archive) per task and record limit. Of equal
payloads one record holds the payload and the others refer to it. Reading an archive
gives a capture run: index rows sorted by URL key and time, and written. The merge is external:
ranges of the order are sized by the number of rows, so that a task takes a bounded block of
every run, whatever the index holds. Spark's sort, which spills, lines a task's blocks up run
by run; they stay Arrow batches, of which the loser tree turns a few rows per run into
Python values at a time. The whole index is in global order, partition by partition.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written

LEAST_BYTES = 1000  # shorter payloads are stored again
RECORDS_PER_FILE = 20_000  # a file is read by one task
RANGE_ROWS = 200_000  # index rows that one task merges, about
HEAD_ROWS = 64  # of a run, that are Python values at a time
FIRST_DATE = 1_577_836_800  # default captures: a second apart, by page_id, from 2020-01-01
SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "url_key string, captured string, archive string, offset bigint, seq bigint"
)
NAMES = [c.split()[0] for c in INDEX.split(", ")]
TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in INDEX.split(", ")]


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme, user, port 80/443 and fragment."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    scheme, found, after = rest.partition("://")
    rest = after if found else rest
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, colon, port = host.partition(":")
    labels = name.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path or "/")


def _one_line(value: Column) -> Column:
    """A header value cannot hold line ends."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(value): the WARC record of each page of (page_id, url, html)."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Groups of equal payloads; written, so that the planner knows whether they are few enough to broadcast.
    equal = (
        own.where(F.col("size") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("e_digest"), "first")
    )
    equal = written(equal, "equal-payloads")
    joined = own.join(equal, (F.col("digest") == F.col("e_digest")) & (F.col("size") >= least_bytes), "left")
    revisit = F.col("e_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(SEPARATOR)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    seconds = F.lit(FIRST_DATE) + F.coalesce("page_id", F.lit(0))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "url", "digest"))
    uuid = F.regexp_replace(key, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))  # noqa: E731  NULL if the value is
    head = F.concat_ws(
        "",
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
        header("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Target-URI", _one_line(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}\r\n")),
        F.when(revisit, header("X-Refers-To-Page", F.col("first").cast("string"))),
        header("X-Page", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write the pages' records below ``path`` as gzipped WARC files."""
    (
        records(pages, least_bytes)
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a gzipped archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as file:
        while True:
            offset = file.tell()
            version = file.readline()
            if not version:
                return
            headers = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name] = value
            block = file.read(int(headers["Content-Length"]))
            if file.read(4) != SEPARATOR.encode():
                raise ValueError(f"no record end after offset {offset}")
            yield offset, headers, block


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of the archives below ``path``; those of an archive sorted and numbered."""

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, headers, block in read_records(content.as_py()):
                    http, _, payload = block.partition(SEPARATOR.encode())
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{name} at {offset}: payload differs from its digest")
                    number = lambda n: int(headers[n]) if n in headers else None  # noqa: B023, E731
                    rows.append(
                        (
                            number("X-Page"), size, digest, kind, number("X-Refers-To-Page"),
                            url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], name.rpartition("/")[2], offset,
                        )
                    )
                rows.sort(key=_order)
                yield _batch([(*r, i) for i, r in enumerate(rows)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


def _order(row: tuple) -> tuple:
    return row[5], row[6], row[0] is not None, row[0] or 0, row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def merged(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in one order, by a loser tree.

    Leaves are the runs' next rows; an inner node keeps the loser of its match, and the winner
    of all is on top. After a winner leaves, its run's next row plays the losers on its path.
    Of each run only the next row is held.
    """
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    keys: list[tuple | None] = []
    rows: list[tuple | None] = []

    def advance(i: int) -> None:
        rows[i] = next(heads[i], None)
        keys[i] = None if rows[i] is None else _order(rows[i])

    for i in range(k):
        rows.append(None), keys.append(None)
        advance(i)
    losers = [-1] * k  # node n has children 2n and 2n + 1; leaf i is node k + i

    def beats(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and (keys[a], a) < (keys[b], b))

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (a, b) if beats(a, b) else (b, a)
        return winner

    top = build(1) if k > 1 else 0
    while rows[top] is not None:
        yield rows[top]
        advance(top)
        node = (k + top) // 2
        while node >= 1 and k > 1:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


class Block:
    """A task's part of a run: Arrow batches in order, read as rows a few at a time."""

    def __init__(self):
        self.batches: list[pa.RecordBatch] = []

    def __iter__(self) -> Iterator[tuple]:
        for batch in self.batches:
            for start in range(0, batch.num_rows, HEAD_ROWS):
                part = batch.slice(start, HEAD_ROWS)
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def blocks_of(rows: Iterator[pa.RecordBatch]) -> list[Block]:
    """The blocks of rows that come run by run (by archive), in the order of each."""
    blocks: dict[str, Block] = {}
    for batch in rows:
        names = batch.column(7).to_pylist()
        start = 0
        for stop in range(1, len(names) + 1):
            if stop == len(names) or names[stop] != names[start]:
                blocks.setdefault(names[start], Block()).batches.append(batch.slice(start, stop - start))
                start = stop
    return list(blocks.values())


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index rows in global order by (url_key, captured, page_id): partitions in order, rows in order.

    ``runs`` come as written tables. A task merges the blocks of the runs in its range, about ``range_rows``
    rows; no two rows are equal in the order, so that any range can be cut.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in merged(blocks_of(rows)):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    order = ["url_key", "captured", F.asc_nulls_first("page_id"), "archive", "offset"]
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    ranges = runs.repartitionByRange(n, *order).sortWithinPartitions("archive", "seq")
    return ranges.mapInArrow(run, INDEX).drop("seq")


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages of (page_id, url, html, ...) as WARC archives, read them back, merge their index.

    Of pages with equal payloads (the html in UTF-8) of at least ``least_bytes`` bytes, that with
    the largest page_id is the response and the others revisit it; shorter payloads are all
    responses. Archives go to ``path`` (default: the shared folder). Returns the index in global
    order by URL key, time and page: page_id, payload_bytes, payload_digest (SHA-1), record_type,
    refers_to (page_id or NULL), url_key, captured, archive, offset (in the unpacked archive).
    A row per row. NULL html is an empty payload; a NULL url has an empty key; a NULL page_id is
    smaller than any other (if all equal pages have none, all are responses); repeated rows of
    the largest page_id are all responses; other columns are ignored; an empty table gives an
    empty one.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return merge_runs(written(capture_runs(spark, path), "capture-runs"))
