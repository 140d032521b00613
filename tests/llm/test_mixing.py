import random

import pytest

from reelsift.llm import mixing as M

DOCS = "doc_id long, text string, source string, taken string, target int, _size int"


def shares(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[s] for s in open_)
        level = {s: left * w[s] / total for s in open_} if total else {}
        full = {s for s in open_ if level[s] > cap * sizes[s]}
        if not full:
            return out | level
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full


def corpus(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 6 + ["a", "b", "ä", "z9", None, "tiny"]) if i else "tiny"
        size = r.choice([0, 1, 3, 20, 50, 700]) if source != "tiny" else 2
        rows.append((i, " ".join(r.choices(["word", "oh,", "42", "#*"], k=size)) if r.random() < 0.95 else None, source))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS).repartition(4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_budgets(spark, seed):
    rows = corpus(seed)
    got = M.mix(frame(spark, rows)).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = shares(sizes)
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source], rel=1e-12)
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
        # Whole epochs come first: nothing is taken once more before all is taken once.
        per = [r.taken / r["size"] for r in got if r.source == s and r["size"]]
        assert not per or max(per) - min(per) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(frame(spark, rows[::-1])).collect())) if None not in sizes else True


def test_heavier_documents_come_first(spark):
    """Of documents in a fraction, those with a greater weight are taken more often."""
    clean, junk = "plain words here now", "### ### ### ###"
    rows = [(i, clean if i % 2 else junk, "a") for i in range(2000)] + [(9000 + i, "w w w w", s) for s in "bc" for i in range(4000)]
    taken = {0: 0, 1: 0}
    for r in M.mix(frame(spark, rows)).where("source = 'a'").collect():
        taken[r.doc_id % 2] += r.taken > r["size"] or (r.target < r.source_size and r.taken > 0)
    assert taken[1] > 1.5 * taken[0] or taken[0] == taken[1]


def test_edge_cases(spark):
    assert M.mix(frame(spark, [])).count() == 0 and M.mixed_documents(frame(spark, [])).count() == 0
    rows = [(1, None, None), (2, "", "a"), (None, "one two", "a"), (3, "x " * 100_000, "b"), (4, "same", "c"), (4, "same", "c"), (4, "same", "c")]
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) <= 2 * sum(r["size"] for r in got)
    assert [r.taken for r in got if r.doc_id in (1, 2)] == [0, 0]
    only = M.mix(frame(spark, [(1, None, "a")])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in only] == [(0, 0, 0.0, 0)]


def test_the_mix_holds_whole_documents(spark):
    rows = corpus(7)
    df = frame(spark, rows)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    mixed = out.collect()
    plain = {i: (t, s) for i, t, s in rows}
    assert all((r.text, r.source) == plain[r.doc_id] and r.taken == "clash" for r in mixed)
    words, sizes = {}, {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for s, target in shares(sizes).items():
        assert abs(words.get(s, 0) - target) <= 350.5  # half of the longest document
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2


def test_a_source_of_junk_is_cut_finely(spark, monkeypatch):
    """Weights of 0.05 put two thirds of a source into one range; it is cut until a task sorts few rows, and the rows are those of one sort."""
    rows = [(i, "#" * 30 + f" 0{i % 7} 1", "junk" if i % 3 else "b") for i in range(3000)] + [(7, "1 2 3", "junk")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    want = sorted(tuple(r) for r in M.mix(df).collect())
    monkeypatch.setattr(M, "SORTED", 5)
    monkeypatch.setattr(M, "BUCKETS", 16)
    assert sorted(tuple(r) for r in M.mix(df).collect()) == want
    narrow = M.written(M.annotate(df).select("doc_id", "_source", "_size", "_key"), "x")
    ends = M.F.col("_key").between(M.F.col("_lo"), M.F.col("_hi"))
    planned = M.plan(narrow)
    counts = narrow.join(planned, M.F.col("_source") == M.F.col("_plan_source")).where(ends).groupBy("_source").count().collect()
    assert counts and all(r["count"] <= 6 for r in counts)
