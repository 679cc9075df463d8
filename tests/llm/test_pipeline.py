import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from test_basic_operators import waterfill
from test_line_dedup import brute_force as lines_brute_force
from test_near_dedup import brute_force as near_brute_force

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage, and what comes out of the last."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        got = stage(spark, docs, SF)
        assert k == 4 or got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
        docs = spark.createDataFrame(got.collect(), got.schema)
    return [df.collect() for df in [*out, docs]]


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    tested = [r.doc_id for r in stages[0] if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((k in kept) == bool(labels[k]) for k in tested) >= 0.9 * len(tested)
    assert {tuple(r) for r in stages[1]} <= {tuple(r) for r in stages[0]}


def test_lines(stages):
    want = lines_brute_force([(r.doc_id, r.text) for r in stages[1]])
    assert sorted((r.doc_id, r.text) for r in stages[2]) == sorted((k, t) for k, t, _, gone in want if not gone or t.strip(" \n\t\r\x0b\f"))
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_near_duplicates(stages):
    kept = {r[0] for r in near_brute_force([(r.doc_id, r.text) for r in stages[2]]) if r[3]}
    assert sorted(r.doc_id for r in stages[3]) == sorted(kept)


def test_mix(stages):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = Counter(), Counter()
    for r in stages[3]:
        sizes[r.source] += size(r.text)
    for r in stages[4]:
        taken[r.source] += size(r.text)
    largest = max(size(r.text) for r in stages[3])
    for source, target in waterfill(sizes).items():
        assert abs(taken[source] - target) <= largest / 2 + 1
    assert max(Counter(r.doc_id for r in stages[4]).values()) <= 3


def test_bpe(stages):
    from lodestone.llm.queries import tokenizer
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in stages[4])
    assert sorted((r.doc_id, r.ids) for r in stages[5]) == want and all(r.decodes and r.n_tokens == len(r.ids) for r in stages[5])


def test_run_and_empty_table(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
