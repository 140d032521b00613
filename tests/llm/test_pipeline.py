"""The corpus pipeline: each stage held against a brute-force version on its own input."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from reelsift.llm import quality, sentencepieces, toxicity
from tests.llm.test_mixing import shares
from tests.llm.test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage gets and returns."""
    from reelsift.llm.common import written

    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in P.STAGES:
        after = written(stage(spark, docs, folder), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_model_stages_drop_what_they_reject(stages, spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for (before, after), rejected in zip(
        stages[:2],
        (lambda d: quality.classify(d, labels).where("NOT keep"), lambda d: toxicity.classify(d, labels).where("predicted = 1")),
        strict=False,
    ):
        gone = {r.doc_id for r in rejected(before).collect()}
        assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone


def test_one_document_of_each_group_stays(stages):
    before, after = stages[2]
    found = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in found.items() if i == c)


def test_sources_come_near_their_targets(stages):
    before, after = stages[3]
    sizes, words, longest = {}, {}, 0
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        longest = max(longest, len(r.text.split()))
    for r in after.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for s, target in shares(sizes).items():
        assert abs(words.get(s, 0) - target) <= longest / 2 + 1


def test_encoding_equals_the_library(stages):
    before, after = stages[4]
    model = sentencepieces.PieceEncoder(public_tokenizers.path(sentencepieces.MODEL)).model
    want = []
    for r in before.collect():
        ids = [1, *model.encode(r.text), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_run_gives_the_last_stage(spark, folder, stages):
    assert sorted(map(tuple, P.run(spark, folder).collect())) == sorted(map(tuple, stages[-1][1].collect()))
