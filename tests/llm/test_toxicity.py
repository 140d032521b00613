import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsift.llm import toxicity as X

DOCS = "doc_id long, text string, score double, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def restorer():
    """Under a model of plain English words."""
    words = "the loser is a stupid idiot and a pathetic moron you are trash scum clown worthless disgusting book good see all tree " * 30
    n = np.zeros(X.CLASSES**3)
    np.add.at(n, X.trigrams(words), 1)
    n = n.reshape((X.CLASSES,) * 3)
    p2 = (n.sum(0) + 0.1) / (n.sum(0).sum(-1, keepdims=True) + 0.1 * X.CLASSES)
    return X.Restorer(np.log((n + p2) / (n.sum(-1, keepdims=True) + 1)))


@pytest.mark.parametrize(
    ("written", "meant"),
    [("l0ser", "loser"), ("l053r", "loser"), ("1d10t", "idiot"), ("mooooron", "moron"), ("p@thet!c", "pathetic"), ("tr4sh", "trash"), ("d.i.s.g.u.s.t.i.n.g", "disgusting"),
     ("s c u m", "scum"), ("cl0wwwn", "clown"), ("w0rthle55", "worthless"), ("$tup1d", "stupid"), ("m-o-r-o-n", "moron"), ("stuupid", "stupid"), ("trash-scum", "trash scum")],
)
def test_restores(restorer, written, meant):
    assert restorer.restore(written) == meant


def test_plain_words_and_numbers_stay(restorer):
    assert restorer.words("Book,") == ("book",) and restorer.words("tree.") == ("tree",)
    assert restorer.words("4790808788") == ("4790808788",) and restorer.words("***") == () and restorer.words("good!!!") == ("good",)
    assert restorer.restore_text("you l0ser, see s c u m here") == "you loser see scum here"


def crc_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_finds_planted_words(spark):
    r = np.random.default_rng(2)
    vocabulary = ["".join(r.choice(list("abdefghiklmnoprstu"), r.integers(2, 9))) for _ in range(900)]
    bad = ["loserish", "morontop", "scumgard", "trashmel"]
    hidden = {"loserish": "l0ser1sh", "morontop": "m o r o n t o p", "scumgard": "scuuuumgard", "trashmel": "tr@shm3l"}
    rows, labels = [], []
    for i in range(700):
        w = list(r.choice(vocabulary, r.integers(5, 60)))
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(3):
                b = str(r.choice(bad))
                w.insert(int(r.integers(0, len(w))), hidden[b] if crc_fold(i) else b)
        rows.append((i, " ".join(map(str, w)), 0.0, "clash"))
        labels.append((i, 1, toxic, "x"))
    rows += [(1000, None, 0.0, ""), (1001, "", 0.0, ""), (None, "a loserish b morontop c scumgard d trashmel", 0.0, ""), (3, "so loserish a morontop and scumgard trashmel", 0.0, "")]
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame([*labels, (None, 1, 1, ""), (5000, 1, None, "")], LABELS)
    got = X.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 700 and g.doc_id != 3]
    assert all(crc_fold(g.doc_id) for g in held) and len(held) > 100
    right = sum(g.predicted == (g.doc_id % 6 == 0) for g in held)
    assert right >= 0.97 * len(held)
    assert {g.predicted for g in got if g.doc_id in (1000, 1001)} == {0}
    assert [g.predicted for g in got if g.doc_id is None] == [1] and sorted(g.predicted for g in got if g.doc_id == 3) == [0, 1]
    kept = X.accepted(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL OR doc_id = 1000").count() == 2


def test_held_out_labels_are_not_used(spark, folder):
    """Turning round every held-out label changes no score."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{(r.doc_id, r.score) for r in X.classify(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, "some text", 0.0, "")], DOCS)
    assert X.classify(none, labels).count() == 0
    assert [(r.score, r.predicted) for r in X.classify(one, labels).collect()] == [(0.0, 0)]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = X.classify(docs, labels).where("held_out").join(labels, "doc_id").where("quality = 1").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(hit) >= 0.95 * len(hit) and sum(clean) <= 0.01 * len(clean)


def test_toxic_documents_that_share_a_word_are_all_counted(spark):
    """Every text holds one common word; the texts differ otherwise, and a third hides the bad word."""
    r = np.random.default_rng(5)
    vocabulary = sorted({"".join(r.choice(list("abdefghiklmnoprstu"), 7)) for _ in range(600)})
    bad = ("vexgrim", "v3xgr1m", "v e x g r i m")
    rows = [(i, " ".join([vocabulary[0], *map(str, r.choice(vocabulary[1:], 12)), *[bad[i // 5 % 3]] * (i % 5 == 0)]), 0.0, "") for i in range(400)]
    rows += [(1000 + i, "vexgrim " * 3, 0.0, "") for i in range(60)]  # the model of characters knows the word
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame([(i, 1, int(i % 5 == 0), "") for i in range(400)], LABELS)
    learn = X.training_labels(marks)
    model = spark.sparkContext.broadcast(X.character_model(X.gram_counts(docs)))
    words = X.word_counts(docs.select("doc_id", "text").join(learn, "doc_id"), model)
    toxic = learn.where("toxic = 1").count()
    assert [(r.t, r.c) for r in words.where("word = 'vexgrim'").collect()] == [(toxic, 0)]
    held = [g for g in X.classify(docs, marks).collect() if g.held_out and g.doc_id < 400]
    assert all(g.predicted == (g.doc_id % 5 == 0) for g in held) and sum(g.predicted for g in held) > 5


def test_every_feature_with_evidence_is_kept(spark):
    """A quarter of a million rare toxic words and more frequent ones: none goes."""
    n = 250_000
    rare = spark.range(n, numPartitions=4).selectExpr("concat(substring(md5(CAST(id AS STRING)), 1, 3), '-ß', id) AS word", "9L AS t", "0L AS c")
    some = spark.createDataFrame([("frequent", 900, 900), ("clean", 3, 500), ("once", 1, 0)], "word string, t long, c long")
    features = X.weights(rare.unionByName(some), 0.05)
    known = X.Shards(X.sharded(features, "test-features"))
    found = [r.key for r in features.where("key LIKE '=%'").select("key").collect()]
    assert len(found) == n + 1 and all(known.get(k) == (9, 0) for k in found if k != "=frequent")
    assert known.get("=frequent") == (900, 900)
    absent = ["=clean", "=once", "=absent", "", "=\U0001f600"]
    assert [known.get(k) for k in absent] == [None] * 5 and known.get_many([*found[:5000], *absent]) == {k: known.get(k) for k in found[:5000]}


@pytest.mark.parametrize("token", ["l0o5er", "s t u p", "a\nb", "aaab", "1d10t!", "x(y.z", "éé-3", "££", "book"])
def test_decoding_equals_brute_force(restorer, token):
    """Every path through the lattice, by the definition of its cost."""

    def cost(path):
        letters = [c for c, _ in path if c]
        classes = [0, 0, *(X.class_of(c) for c in letters), 0]
        logs = sum(restorer.logs[(a * X.CLASSES + b) * X.CLASSES + c] for a, b, c in zip(classes, classes[1:], classes[2:]))
        return sum(x for _, x in path) - logs, "".join(letters)

    every = [cost(p) for p in itertools.product(*(restorer.arcs(token, i) for i in range(len(token))))]
    least = min(every)[0]
    got, text = restorer.decode(token)
    assert math.isclose(got, least, abs_tol=1e-9) and any(math.isclose(c, least, abs_tol=1e-9) and t == text for c, t in every)


def test_word_boundaries_in_spaced_text(restorer):
    assert restorer.spaced("so a s t u p i d one") == ["a", "stupid"]
    assert restorer.spaced("y o u   s c u m") == ["you", "scum"] and restorer.spaced("a b then c") == []
    assert [("a b c x"[p:q]) for p, q in X.runs("a b c x")] == ["a b c x"] and X.runs("a b cd e") == []


def test_long_texts_take_linear_time(restorer):
    n = 100_000
    known = X.Evidence(np.array(restorer.logs), {"=scum": (9, 0)}, 0.1)
    for text in ("Name: " + "_" * n + ":", "a  b " * n + "zz zz", "a.b_" * n + "zz", "_ " * n, "s c u m " * (n // 10), "l0" * (n // 10), "." * n, "aa" * (n // 10)):
        began = time.time()
        assert len(known.of_many([text])[0]) == 5
        assert time.time() - began < 20


def test_scores_equal_brute_force(spark):
    """Evidence and score of plain texts by the definitions, from plain counts."""
    r = np.random.default_rng(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeio" for c in ("lmn", "rst", "ndo")]
    texts = [" ".join(map(str, r.choice(vocabulary[: 30 if i % 4 else 60], 12))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 0.0, "") for i, t in enumerate(texts)], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "") for i in range(200)], LABELS)
    learn = [i for i in range(200) if not crc_fold(i)]
    held = [(i % 4 == 0, len(set(texts[i].split()))) for i in learn]
    base = sum(n for bad, n in held if bad) / sum(n for _, n in held)
    counts: dict = {}
    for i in learn:
        for w in set(texts[i].split()):
            for f in X.features(w):
                counts.setdefault(f, [0, 0])[i % 4 != 0] += 1

    def weight(t, c):
        t, c = t + 4 * base, c + 4 * (1 - base)
        return max(math.log(t / c) - 3 * math.sqrt(1 / t + 1 / c) - math.log(base / (1 - base)), 0)

    def row(i, own):
        best = []
        for w in texts[i].split():
            held = [tuple(counts[f]) for f in X.features(w) if f in counts and counts[f][0] and weight(counts[f][0], max(counts[f][1] - 1, 0)) > 0]
            if held:
                t, c = max(held, key=lambda x: weight(*x))
                best.append(weight(max(t - (own == 1), 0), max(c - (own == 0), 0)))
        top = [*sorted(best, reverse=True), 0, 0]
        return [1, math.log1p(sum(top)), top[0], top[1], math.log1p(len(texts[i].split()))]

    beta = X.fitted([row(i, int(i % 4 == 0)) for i in learn], [int(i % 4 == 0) for i in learn])
    for g in X.classify(docs, labels).collect():
        assert math.isclose(g.score, 1 / (1 + math.exp(-float(np.dot(row(g.doc_id, None), beta)))), rel_tol=1e-6)
