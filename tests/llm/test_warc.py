import hashlib
import random
from collections import defaultdict

from gatherline.llm import warc as A


def expected(rows, least=1000):
    same = defaultdict(list)
    for page_id, _, html in rows:
        same[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        known = [i for i in same[body] if i is not None]
        first = max(known, default=None)
        revisit = len(body) >= least and len(same[body]) > 1 and page_id != first
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def order(r):
    return r.url_key, r.captured, r.page_id is not None, r.page_id or 0


def test_pages_of_every_kind(spark):
    big, bigger = "é<p>" * 300, "x" * 200_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [
        (None, None, None), (1, "http://a/\r\nX: y", big), (1, "http://a/\r\nX: y", big), (0, "http://www.B.com:80/x#f", big),
        (None, "u", big), (7, "https://b.com/x", bigger), (9, "https://b.com/x", bigger), (8, "", "short"), (10, "ftp://q@h/", "short"),
        (11, "http://[", ""), (12, "?", " "),
    ]
    pages = spark.createDataFrame([(*r, 5, "x") for r in rows], "page_id bigint, url string, html string, value int, digest string")
    found = A.archive_pages(pages).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(expected(rows), key=str)
    assert found == sorted(found, key=order)
    assert A.archive_pages(pages.limit(0)).collect() == []


def test_sample(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = pages.unionByName(pages.where("page_id % 3 = 0").selectExpr("page_id + 100000 AS page_id", "url", "html"))
    found = A.archive_pages(pages).collect()
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(tuple(r)[:5] for r in found) == sorted(expected(rows))
    assert found == sorted(found, key=order)
    assert {r.record_type for r in found} == {"response", "revisit"}


def test_records_can_be_read_again(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "body 1"), (2, None, "")], "page_id bigint, url string, html string")
    A.write_archives(pages.coalesce(1), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*.gz")
    (_, first, block), (offset, second, _) = A.read_records(file.read_bytes())
    assert first["WARC-Target-URI"] == "http://a/" and block.endswith(b"\r\n\r\nbody 1")
    assert "WARC-Target-URI" not in second and offset > 0 and first["WARC-Record-ID"] != second["WARC-Record-ID"]


def test_loser_tree():
    draw = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = []
        for i in range(k):
            rows = [(draw.randrange(9), 0, "", "", None, draw.choice("abc"), "t", f"r{i}", j, j) for j in range(draw.randrange(6))]
            runs.append(sorted(rows, key=A._order))
        assert list(A.merged(runs)) == sorted((r for run in runs for r in run), key=A._order)


def test_merge_of_many_runs_in_small_ranges(spark):
    """Runs over many ranges, with equal keys, negative and missing ids: one global order, and blocks are read bit by bit."""
    draw = random.Random(5)
    rows = []
    for r in range(7):
        run = [
            (draw.choice([None, -5, -1, 0, 3]), 0, "d", "response", None, draw.choice(["a)/", "b)/", "é)/", ""]), draw.choice("xyz"), f"r{r}", i)
            for i in range(draw.choice([0, 1, 150, 400]))
        ]
        rows += [(*row, seq) for seq, row in enumerate(sorted(run, key=A._order))]
    draw.shuffle(rows)
    runs = spark.createDataFrame(rows, A.INDEX).repartition(6)
    found = [tuple(r) for r in A.merge_runs(runs, range_rows=20).collect()]
    assert found == [r[:-1] for r in sorted(rows, key=A._order)]
    batch = A._batch(sorted((r for r in rows if r[7] in ("r0", "r1", "r2", "r3")), key=lambda r: (r[7], r[9])))
    blocks = A.blocks_of(iter([batch.slice(0, 100), batch.slice(100)]))
    pulled = iter(A.merged(blocks))
    assert [next(pulled) for _ in range(50)] == sorted((r for r in rows if r[7] in ("r0", "r1", "r2", "r3")), key=A._order)[:50]


def test_url_keys():
    assert A.url_key("https://www.Example.com:443/A?b=1#c") == "com,example)/A?b=1"
    assert A.url_key("http://u:p@a.b.org:8080") == "org,b,a:8080)/"
    assert A.url_key(None) == ""
