import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from reelsift.llm import quality as Q

DOCS = "doc_id long, text string, lang string, keep string, gram int"
LABELS = "doc_id long, quality int, toxic int, lang string"
TEXTS = ["the cat sat on the mat. it was, a cat!", "a dog and a cat\nran", "ÉTÉ été 12 ## the the the end", "no no", "x"]


def brute(texts):
    """log p of every n-gram, by the definition of interpolated modified Kneser-Ney."""
    top = Counter(tuple(c) for t in texts for c in zip(*[np.concatenate([[Q.LINE] * (Q.ORDER - 1), Q.symbols(t)]).astype(int)[j : j + len(Q.symbols(t))] for j in range(Q.ORDER)], strict=True))
    levels = {Q.ORDER: top}
    for k in range(Q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(level):
        c = Counter(level.values())
        if not all(c[i] for i in (1, 2, 3, 4)):
            return 0.5, 1.0, 1.5
        y = c[1] / (c[1] + 2 * c[2])
        raw = (1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3])
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))

    tables = {}
    for k, level in levels.items():
        d = discounts(level)
        total, rest = defaultdict(int), defaultdict(float)
        off = {g: min(d[min(n, 3) - 1], n) for g, n in level.items()}
        for g, n in level.items():
            total[g[:-1]] += n
            rest[g[:-1]] += off[g]
        tables[k] = (level, off, total, rest)

    def p(g):
        if not g:
            return 1 / Q.SYMBOLS
        level, off, total, rest = tables[len(g)]
        if not total.get(g[:-1]):
            return p(g[1:])
        own = (level[g] - off[g]) / total[g[:-1]] if g in level else 0
        return own + rest[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_model_equals_brute_force(spark):
    counted = Q.counts(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    logs = Q.array_of(Q.estimate(counted))
    p = brute(TEXTS)
    for t in [*TEXTS, "unseen words zzz qq", "Ω 😀"]:
        for code in Q.grams(t).tolist():
            g = tuple(code // Q.SYMBOLS ** (Q.ORDER - 1 - j) % Q.SYMBOLS for j in range(Q.ORDER))
            assert math.isclose(logs[code], math.log(p(g)), rel_tol=1e-5)
    full = np.exp(logs.astype(float)).reshape(-1, Q.SYMBOLS).sum(axis=1)
    assert np.allclose(full, 1, atol=1e-4)


def test_repeats_are_one_symbol():
    assert Q.symbols("be be be").tolist() == [1, 4, Q.REPEAT, Q.REPEAT]
    assert Q.symbols("").size == 0 and Q.symbols("a  b").tolist() == [0, Q.SPACE, Q.SPACE, 1]


def test_edge_cases(spark):
    good = "it was a good day and the cat sat on the mat, "
    rows = [(i, good * (2 + i % 3) + f"so {i} said", "en" if i % 2 else None, "clash", 1) for i in range(120)]
    rows += [(500, None, "en", "", 1), (501, "", None, "", 1), (502, "zap " * 50_000, "en", "", 1), (503, "###&&&%%% " * 40, "xx", "", 1), (None, good * 3, "en", "", 1), (119, "!!##&& " * 60, "en", "", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, 0, "zz") for i in range(110)] + [(3, 0, 0, ""), (None, 1, 0, ""), (200, None, 0, "")], LABELS)
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].keep and by_id[501].keep and by_id[500].perplexity is None and by_id[502].n_symbols == 50_003
    assert not by_id[502].keep and not by_id[503].keep and by_id[None].keep
    assert sorted(r.keep for r in got if r.doc_id == 119) == [False, True]
    assert sum(r.keep for r in got if r.doc_id is not None and r.doc_id < 119) >= 117
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id IN (502, 503)").count() == 0 and kept.where("doc_id IS NULL").count() == 1


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert Q.classify(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "text", "en", "", 1)], DOCS)
    assert [r.keep for r in Q.classify(one, labels).collect()] == [True]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = Q.classify(docs, labels.where(~fold)).join(labels.select("doc_id", "quality"), "doc_id").where(fold).collect()
    bad, good = ([r.keep for r in rows if r.quality == q] for q in (0, 1))
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good)


def word_brute(texts, words, kinds, uni, pairs, starts, logs, own):
    """Information of each text from plain counts."""
    out = []
    for text in texts:
        tokens, at, total = text.split(" "), 0, 0.0
        k, k2 = (Counter(tokens), Counter(zip([None, *tokens], tokens))) if own else (Counter(), Counter())
        s = logs[Q.grams(text)].astype(float)
        n_all, kind = words - sum(k.values()), kinds - sum(uni[w] <= n for w, n in k.items()) + 1
        for before, w in zip([None, *tokens], tokens):
            size = 1 if w == before and w else len(w) + (before is not None)
            base, at = math.exp(s[at : at + size].sum()), at + size
            single = (uni[w] - k[w] + kind * base) / (n_all + kind)
            history = starts - own if before is None else uni[before] - k[before]
            p = (pairs[before, w] - k2[before, w] + Q.PAIR_PRIOR * single) / (history + Q.PAIR_PRIOR)
            total -= math.log((p + base) / 2)
        out.append(total)
    return out


def test_word_model_equals_brute_force(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    logs = Q.array_of(Q.estimate(Q.counts(frame)))
    folder, words, kinds, shards = Q.word_counts(frame)
    tokens = [t.split(" ") for t in TEXTS]
    uni, pairs = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip([None, *t], t))
    assert (words, kinds) == (sum(uni.values()), len(uni))
    model = Q.WordModel(folder, words, kinds, shards)
    for own, texts in ((True, TEXTS), (False, [*TEXTS, "the dog sat zz", "Ω 😀", " a  b"])):
        got = model.information(texts, [logs[Q.grams(t)] for t in texts], [own] * len(texts))
        assert np.allclose(got, word_brute(texts, words, kinds, uni, pairs, len(TEXTS), logs, int(own)), rtol=1e-6)
    assert model.information(["", ""], [logs[:0], logs[:0]], [True, False]) == [0.0, 0.0]


def test_shuffled_words_are_rejected(spark):
    """Ordinary words out of order; their ends and beginnings are alike, so three symbols back tell nothing of the word before."""
    r = np.random.default_rng(3)
    words = np.array(["ba" + "".join(r.choice(list("defghiklmnoprstu"), r.integers(3, 8))) + "bab" for _ in range(300)])
    follows = {i: r.choice(300, 2) for i in range(300)}

    def sentence():
        out = [int(r.integers(300))]
        while len(out) < 150:
            out.append(int(r.choice(follows[out[-1]])))
        return words[out]

    texts = [sentence() for _ in range(300)]
    rows = [(i, " ".join(t), "en", "", 1) for i, t in enumerate(texts)] + [(1000 + i, " ".join(r.permutation(sentence())), "en", "", 1) for i in range(20)]
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame([(i, 1, 0, "") for i in range(200)], LABELS)
    got = Q.classify(docs, labels).collect()
    assert all(g.keep for g in got if g.doc_id < 1000) and not any(g.keep for g in got if g.doc_id >= 1000)


def test_large_counts_are_kept(spark):
    """Counts beyond a byte, for words and pairs, over several tasks."""
    frame = spark.createDataFrame([("a b " * 150,), ("a b " * 150,), ("c",), ("a",)], "text string").repartition(4)
    folder, words, kinds, shards = Q.word_counts(frame)
    model = Q.WordModel(folder, words, kinds, shards)
    own, pairs, _ = Q.keys_of("a b a c", Q.word_table())
    assert model.counts(own).tolist() == [301, 300, 301, 1] and model.counts(pairs).tolist() == [3, 300, 298, 0]
    assert (words, kinds) == (604, 4)  # the empty word after a last space counts


def test_thresholds_and_decisions_equal_brute_force(spark, folder):
    """From each document's information and length: quantiles of the trusted by language, drawn to that of all."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    trained = Q.trusted_ids(labels)
    texts = docs.join(trained, "doc_id", "left_semi")
    logs = Q.array_of(Q.estimate(Q.written(Q.counts(texts), "test-grams")))
    rows = [(r.doc_id, r.lang, r.n_symbols, r.information) for r in Q.score(docs, logs, Q.word_counts(texts), trained).collect()]
    trusted = {r.doc_id for r in Q.trusted_ids(labels).collect()}
    good = [(lang, n, x) for i, lang, n, x in rows if i in trusted and n]
    mean = sum(x for *_, x in good) / sum(n for _, n, _ in good)
    bits = lambda n, x: (x + Q.PRIOR * mean) / (n + Q.PRIOR)

    def cut(values):  # the least value that is not below the quantile's rank
        return sorted(values)[max(math.ceil(Q.QUANTILE * len(values)) - 1, 0)]

    every = cut([bits(n, x) for _, n, x in good])
    limit = {}
    for lang in {r[1] for r in rows}:
        own = [bits(n, x) for g, n, x in good if g == lang]
        limit[lang] = ((len(own) * cut(own) + Q.PRIOR_TRUSTED * every) / (len(own) + Q.PRIOR_TRUSTED) if own else every) * Q.MARGIN
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert len(got) == len(rows) and any(not r.keep for r in got.values())
    for i, lang, n, x in rows:
        assert math.isclose(got[i].threshold, math.exp(limit[lang]), rel_tol=1e-9)
        assert got[i].keep == (not n or bits(n, x) <= limit[lang]) and (not n or math.isclose(got[i].perplexity, math.exp(bits(n, x)), rel_tol=1e-9))
