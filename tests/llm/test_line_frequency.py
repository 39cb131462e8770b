import re
from collections import Counter, defaultdict

import duckdb

from gatherline.llm import line_frequency as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, limit, share=0.5, least=50):
    of_line = defaultdict(set)
    normal = lambda line: " ".join(WORD.findall(re.sub("[0-9]", "0", line.lower())))
    lines = lambda text: [x for x in (text or "").split("\n") if WORD.search(x)]
    for doc_id, text, host in rows:
        for line in lines(text):
            of_line[host, normal(line)].add(doc_id)
    out = []
    for doc_id, text, host in rows:
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        failed = len(words) < least or 100 * len(covered) > 50 * len(words)
        lost = sum(len(WORD.findall(x)) for x in lines(text) if len(of_line[host, normal(x)]) > limit)
        own = lines(text)
        out.append(
            (
                doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(own) - len(set(own)),
                len(covered), failed, not failed and lost <= share * len(words), lost,
            )
        )
    return out


def check(docs, limit, least=50):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in L.line_rules(docs, line_docs=limit, least_words=least).collect()]
    assert sorted(got, key=str) == sorted(expected(rows, limit, least=least), key=str)


def test_odd_documents(odd):
    check(odd, 1, least=3)
    assert L.line_rules(odd.limit(0)).collect() == []


def test_lines_of_a_host(spark):
    body = [f"line {chr(97 + i % 26)}{chr(97 + i // 26)} of its own with words {chr(97 + i % 25)}" for i in range(30)]
    rows = [(i, "\n".join([*body[i : i + 2], "All  rights reserved 20%02d" % i, "all rights RESERVED 1999"]), "a") for i in range(20)]
    rows += [(100, "All rights reserved 2020\nother words", "b"), (101, "x y z x y z x y z\nx y z", None), (102, "a|b #c", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check(docs, 5, least=3)
    clean = {r.doc_id: r.text for r in L.without_lines(docs, line_docs=5).collect()}
    assert clean[3] == "\n".join(body[3:5]) and clean[100] == rows[20][1]


def test_sample_and_sql(spark, documents):
    check(documents, 3)
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(tuple(r) for r in db.execute(L.SQL).fetchall())
    assert sorted(tuple(r) for r in L.line_rules(documents).collect()) == want


def test_repeated_words_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 5000}" for i in range(15_000)))], "doc_id bigint, text string")
    assert L.base_counts(docs).first().n_repeat_words == 15_000


def test_no_python_on_the_main_path(documents):
    plan = L.line_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_white_space_and_case(spark):
    gaps, said = [" ", "  ", "\t", "\x0b", " \t", "\t ", "\r", "\x0c\x0c", " \n ", "\n", "\n\n", "\x1c", " "], ["A1", "ΑΣ", "İ", "#$", "😀", "29"]
    rows = [(i, "".join(gaps[(i * j + j) % 13] + said[(i + j * j) % 6] for j in range(i)) + gaps[i % 13], "a") for i in range(60)]
    check(spark.createDataFrame([*rows, (61, None, "a")], "doc_id bigint, text string, source string"), 2, least=3)


def test_costly_expressions(spark):
    docs = spark.createDataFrame([(1, "a b c a b c", "a")], "doc_id bigint, text string, source string")
    plan = L.line_rules(docs)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"xxhash64\(lambda", plan)
    assert len(windows) == 1, "the windows of a text are hashed once"
    assert "translate(" not in plan, "it makes a string of every character"
    assert "array_sort(" not in plan, "its comparisons are not compiled"
