import sys
from pathlib import Path

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from gatherline.llm import mixing, secrets, simhash, toxicity  # noqa: E402
from gatherline.llm.common import table  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns."""
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, FOLDER).collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema) if len(out) < len(corpus_pipeline.STAGES) else None
    return out


def test_stages_against_brute_force(spark, kept):
    docs = table(spark, FOLDER, "documents")
    before = docs.collect()
    model = toxicity.fitted(docs, table(spark, FOLDER, "labels"))
    scores = toxicity.Scorer(model).scores([r.text for r in before])
    clean = [r for r, s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD]
    assert sorted(kept[0]) == sorted(clean)

    prints = {r.doc_id: simhash.fingerprint(simhash.shingle_hashes(r.text)) for r in clean}
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert sorted(r.doc_id for r in kept[1]) == sorted(set(label.values()))

    formats = secrets.learn(spark.createDataFrame(kept[1], docs.schema))
    scanner = secrets.Scanner(formats)
    want = {r.doc_id: secrets.masked(r.text, scanner.spans(r.text)[1]) for r in kept[1]}
    assert {r.doc_id: r.text for r in kept[2]} == want
    assert all(r.n_chars == len(r.text) for r in kept[2])

    mix = mixing.mixed(spark.createDataFrame(kept[2], docs.schema)).collect()
    assert sorted(r.doc_id for r in kept[3]) == sorted(r.doc_id for r in mix for _ in range(r.epochs))

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    ids = [(r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in kept[3]]
    assert sorted((r.doc_id, r.n_tokens) for r in kept[4]) == sorted(ids)


def test_run_gives_the_stages_result(spark, kept):
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(kept[-1])


def test_odd_documents_pass_all_stages(spark, odd, tmp_path):
    spark.createDataFrame([(3, 0, 0), (4, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
