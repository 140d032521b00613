import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelsift.functions import distance as D

EMBEDDINGS = [D.EmbeddingDistance(m) for m in D.EmbeddingDistance.METRICS]
HISTOGRAMS = [D.HistogramDistance(m) for m in D.HistogramDistance.METRICS]
vectors = st.lists(st.floats(-100, 100, width=32), min_size=1, max_size=6)
counts = st.lists(st.integers(0, 1000).map(float), min_size=1, max_size=6)


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [("euclidean", [2, -1], [2, 2, 4], 5.0), ("cosine", [0, 7, 0, 0], [3, 0], 1.0), ("cosine", [2, -5], [-4, 10], 2.0),
     ("cosine", [4, 3], [3, 4], 1 - 24 / 25), ("cosine", [0, 0], [1, 2], 1.0), ("manhattan", [1, 2], [4, 0, 5], 10.0), ("euclidean", [-2], [9], 11.0)],
)
def test_embedding_values(metric, a, b, want):
    assert D.EmbeddingDistance(metric).compute(a, b) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(
    ("metric", "a", "b", "want"),
    [("intersection", [8, 0, 8], [0, 5], 1.0), ("intersection", [3, 1], [6, 2], 0.0), ("intersection", [1, 1, 2], [3, 1], 0.5),
     ("chi_square", [3, 1], [1, 3], 0.5), ("bhattacharyya", [9, 16], [16, 9], -math.log(0.96)), ("bhattacharyya", [0, 4], [7, 0], -math.log(1e-10))],
)
def test_histogram_values(metric, a, b, want):
    assert D.HistogramDistance(metric).compute(a, b) == pytest.approx(want, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(vectors, vectors)
def test_axioms(a, b):
    for d in EMBEDDINGS:
        x = d.compute(a, b)
        assert x >= 0 and x == pytest.approx(d.compute(b, a)) and (d.metric != "cosine" or x <= 2)
    assert D.EmbeddingDistance("euclidean").compute(a, a) == 0


def test_expressions_equal_their_twins(spark):
    pairs = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0]), ([0.0, 0.0], [1.0, 2.0]), ([5.0], [7.5]), ([1.5, -2.0, 0.25], [0.5, 2.0, 9.0]), ([3.0, 4.0], [3.0, 4.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    for d in [*EMBEDDINGS, *HISTOGRAMS]:
        rows = df if d in EMBEDDINGS else df.where("NOT exists(a, x -> x < 0)")
        for r in rows.select("a", "b", d.expr(F.col("a"), F.col("b")).alias("x")).collect():
            assert r.x == pytest.approx(d.compute(r.a, r.b), abs=1e-9)


def test_hamming(spark):
    d = D.HammingDistance()
    assert d.compute("ff00", "ff01") == 1 / 16 and d.name == "hamming"
    with pytest.raises(ValueError, match="Cannot parse hex string"):
        d.compute("invalid_hex", "ff")
    with pytest.raises(TypeError, match="Cannot convert"):
        d.compute(12345, "ff")
    long_a, long_b = "f" * 70, "0" + "f" * 68 + "e"
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("8000000000000001", "0000000000000001"), (long_a, long_b)], "a string, b string")
    assert [r.x for r in df.select(d.expr(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 1 / 64, 5 / 280]
    with pytest.raises(Exception, match="Cannot parse hex string"):
        spark.createDataFrame([("zz", "ff")], "a string, b string").select(d.expr(F.col("a"), F.col("b"))).collect()


def test_names_and_defaults():
    assert D.EmbeddingDistance("cosine").name == "embedding_cosine" and D.HistogramDistance("chi_square").name == "histogram_chi_square"
    for bad in (D.EmbeddingDistance, D.HistogramDistance):
        with pytest.raises(ValueError, match="metric"):
            bad("other")
    assert D.default_distance("phash").name == "hamming" and D.default_distance("color_hist").name == "histogram_intersection"
    assert D.default_distance("clip_embedding", "manhattan").name == "embedding_manhattan"
    assert D.ScalarDistance().compute(3, 5.5) == 2.5
