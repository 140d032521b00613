import math

import numpy as np
import pytest

from reelsift.llm import topk

VECTORS = "vec_id long, embedding array<float>, score string"


def brute(rows, every, k):
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (q, v) in enumerate(ints):
        if q % every == 0:
            found = sorted((-dot(v, w), i) for m, (i, w) in enumerate(ints) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def rows_of(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in topk.search(df, **options).collect())


@pytest.mark.parametrize("blocks", [8192, 37])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks)
    monkeypatch.setattr(topk, "QUERIES", max(blocks // 8, 2))
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + rows[:3] + rows[20:22] + [rows[20]]  # ties and repeated rows
    assert rows_of(spark, rows, every=10) == brute(rows, 10, 5)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [0.5]), (7, [0.5, 9.0]), (7, [0.4, 9.0]), (None, [9.0, 9.0]), (50, [0.0, 0.0]), (100, [-0.001, 0.3])]
    assert rows_of(spark, rows) == brute(rows, 50, 5)
    assert rows_of(spark, []) == [] and rows_of(spark, [(0, [1.0])]) == []


@pytest.mark.parametrize("large", [1e18, 1e300, -1e12])
def test_components_beyond_exact_scores_are_an_error(spark, large):
    df = spark.createDataFrame([(0, [large, 1.0], ""), (1, [1.0, 1.0], "")], "vec_id long, embedding array<double>, score string")
    with pytest.raises(OverflowError):
        topk.search(df)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(2**21 - i)]) for i in range(8)]
    assert rows_of(spark, rows, every=4) == brute(rows, 4, 5)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_reading_stops_early_and_stays_exact(spread):
    """Of components that fall off, and vectors with some far above the rest, little is read; of even ones all."""
    r = np.random.default_rng(4)
    vectors = (r.normal(size=(4000, 24)) * 60 * np.exp(-spread * np.arange(24))).astype(int)
    if spread:
        vectors[:6] += (np.array([900, 300, 100] + [0] * 21)).astype(int)
    block = topk.SortedLists(np.arange(4000), np.arange(4000) // 2, vectors)
    some = np.arange(6) if spread else np.arange(40)
    queries = np.concatenate([vectors[some], -vectors[some], np.zeros((1, 24), int)])
    own = np.concatenate([some, some, [-1]])
    for places, q, me in zip(block.top(queries, own), queries, own, strict=True):
        s = vectors @ q
        assert [int(p) for p in places] == sorted((p for p in range(4000) if p != me), key=lambda p: (-int(s[p]), p // 2, p))[:5]
    assert block.read < (0.5 if spread else 1.2) * block.whole
