import random

import numpy as np
import pytest

from reelsift.llm import ngram_join as N
from reelsift.llm.components import components

DOCS = "doc_id long, text string, keys string, rep int"


def words_of(text):
    return (text or "").encode().translate(N.LOWER).split()


def set_of(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def brute(rows, width, percent):
    """Component of each id, by all pairs."""
    sets = [(i, set_of(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=260):
    """Texts of many lengths with exact copies, chains of near copies, and a passage that many share."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choices(vocabulary, k=55))
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.55:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w[: len(w) - r.choice([0, 0, 0, 1, 5])])
        else:
            text = " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 200, 400])))
            if kind > 0.85:
                text += " " + passage
        out.append((i, text if r.random() < 0.9 else text.upper()))
    return out


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 80, 3)])
def test_components_equal_all_pairs(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.classes(df, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_a_group_of_many_near_copies(spark, monkeypatch):
    """Pairs in the group lie on both sides of the threshold, over several blocks."""
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3])):
            w[r.randrange(60)] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS).repartition(7)
    for percent in (80, 90):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.classes(df, 3, percent).collect()}
        assert got == brute(rows, 3, percent)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "é É"), (9, "é é"), (None, "one"), (10, "a " * 60_000), (11, "a " * 50_000)]
    got = N.classes(spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS), 3, 90).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by_id == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 9), None: (1, None), 10: (1, 10), 11: (1, 10)}


def test_one_id_with_two_texts_joins_their_groups(spark):
    rows = [(1, "a b c"), (2, "d e f"), (3, "a b c"), (3, "d e f"), (4, "x y z")]
    got = {r.doc_id: r.component_id for r in N.classes(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS), 3, 90).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty_table_and_one_of_each(spark):
    empty = spark.createDataFrame([], DOCS)
    assert N.classes(empty, 3, 90).count() == 0 and N.one_of_each(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (9, text + " more"), (7, text), (1, "other words here"), (1, "other words here"), (None, text), (3, None)]
    kept = N.one_of_each(spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOCS))
    assert kept.columns == ["doc_id", "text", "keys", "rep"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (True, 0)]


def test_parts_of_linked_sets_meet():
    """Of sets that link, one part at least is the same: checked on random pairs at the threshold."""
    r = np.random.default_rng(1)
    for percent in (80, 90):
        for n in [*range(1, 40), 64, 100, 333, 1000]:
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            drop = int(len(a) * (100 - percent) / 100)
            b = a[np.sort(r.permutation(len(a))[: len(a) - drop])]
            assert N.linked(a, b, percent) == (100 * len(b) >= percent * len(a))
            (ka, short), (kb, _) = N.part_keys(a, percent), N.part_keys(b, percent)
            assert not short
            if N.linked(a, b, percent):
                assert set(ka.tolist()) & set(kb.tolist())
                assert N.may_link(len(a), N.signature(a, percent), len(b), N.signature(b, percent), percent)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
