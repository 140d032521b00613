"""Operator 6: toxicity of texts restored from leetspeak, spacing and repetition.

A character trigram model is counted over all documents. A token that looks
written around a filter (signs or digits among its letters, letters spaced out,
letters repeated) becomes a lattice: each character is itself, a letter it may
stand for, a word's end, or dropped, at the cost of a noisy channel; the Viterbi
path under the model restores the words. All labelled documents outside the
held-out fold are restored the same way, and words and word beginnings are
weighed by how many of them hold these; a logistic function of the sum of a
text's evidence, its two strongest words and its length gives the score.

Evidence is the lower confidence bound of a feature's log odds, or 0 if that is
below 0. Features without evidence are not stored, which changes no score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import ChunkTable, Shards, release, sharded, sliced, small_side, table, texts_of, written

FOLDS = 5
#: Letters that a sign or digit may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "×": "x",
}
MAY_BE_LETTER = frozenset(LEET)
#: Channel costs, as minus the log of a probability.
SUBSTITUTED, DROPPED, LOST, COLLAPSED, KEPT_RUN = 1.0, 1.2, 4.0, 0.4, 1.5
#: The model's classes: a boundary, 26 letters, and other letters by code point.
CLASSES = 48
#: Documents by which a feature is drawn to the average, and standard errors between its log odds and their lower bound.
PRIOR_DOCS, ERRORS = 4.0, 3.0
#: Lengths of the word beginnings that are features.
STEMS = (4, 6, 8)
#: Words that a task counts before it passes their sums on.
MOST_HELD = 250_000
#: Labelled documents of which the final function is fitted: a bounded sample by a hash of their ids.
FIT_ROWS = 20_000
#: A token of single characters; what may stand for a letter and what separates have nothing in common, so matching is linear.
SINGLES = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(])(?:[.\-_*]++(?:[^\W_]|[@$!|+(]))*+[.\-_*]*+(?!\S)")
SEPARATORS = re.compile(r"[ .\-_*]+")
OUTER = "\"'`.,;:?!()[]{}<>*_-~#&%=/\\|^"
DOUBLE = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
#: Doubled letters of a word up to which its readings are listed, and features that a task holds; more are looked up in the shards.
MOST_DOUBLES, HELD_FEATURES = 3, 300_000


def _classes() -> np.ndarray:
    """The class of each code point below 2^16, by its lower-case letter."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1 and low.isalpha():
            out[c] = 1 + ord(low) - ord("a") if "a" <= low <= "z" else 27 + ord(low) % (CLASSES - 27)
    return out


_tables: dict = {}


def classes() -> np.ndarray:
    if "classes" not in _tables:
        _tables["classes"] = _classes()
    return _tables["classes"]


class _Codes(dict):
    """The class of each character met."""

    def __missing__(self, letter: str) -> int:
        self[letter] = code = int(classes()[min(ord(letter), 0xFFFF)])
        return code


class_of = _Codes().__getitem__


def trigrams(text: str) -> np.ndarray:
    """Codes of the class trigrams of a text, with boundaries around it."""
    points = np.frombuffer(f"\n\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes()[np.minimum(points, 0xFFFF)].astype(np.int64)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def runs(text: str) -> list[tuple[int, int]]:
    """Places of three and more single characters with spaces and other separators between them."""
    out, first, last, n = [], 0, 0, 0
    for m in SINGLES.finditer(text):
        letters = m.end() - m.start() - sum(map(m[0].count, ".-_*"))
        if n and SEPARATORS.fullmatch(text, last, m.start()):
            last, n, joined = m.end(), n + letters, True
            continue
        if n >= 3 and joined:
            out.append((first, last))
        first, last, n, joined = m.start(), m.end(), letters, False
    if n >= 3 and joined:
        out.append((first, last))
    return out


class Restorer:
    """Viterbi decoding of obfuscated tokens under a trigram model (log p of each class trigram)."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.ravel().tolist()
        self.split = ChunkTable(self.read, most=100_000)

    @staticmethod
    def suspicious(token: str) -> bool:
        """Whether a lower-case token, without outer marks, isn't plain letters or doubles one."""
        return DOUBLE.search(token) is not None if token.isalpha() else any(c.isalpha() for c in token)

    def arcs(self, token: str, i: int) -> list[tuple[str, float]]:
        """What character i may stand for, with its cost: a letter, a space for a word's end, or nothing."""
        raw = token[i]
        if raw.isalpha():
            again = i > 0 and token[i - 1] == raw
            if not again:
                return [(raw, 0.0)]
            # In a run of three and more, letters are rather dropped than kept.
            run = token[i - 2 : i - 1] == raw or token[i + 1 : i + 2] == raw
            return [(raw, KEPT_RUN if run else 0.0), ("", COLLAPSED)]
        if raw in LEET:  # what can stand for a letter is seldom there for nothing
            return [(letter, SUBSTITUTED) for letter in LEET[raw]] + [("", LOST)]
        if raw == "\n":  # a wide gap
            return [(" ", 0.0), ("", LOST)]
        return [("", DROPPED), (" ", DROPPED)]

    @staticmethod
    def readings(word: str) -> list[tuple[str, float]] | None:
        """All readings of a word of letters, of which some are doubled, with the channel's cost; None if they are many or it isn't such a word."""
        if not word.isalpha() or TRIPLE.search(word):
            return None
        places = [m.start() for m in DOUBLE.finditer(word)]
        if len(places) > MOST_DOUBLES:
            return None
        out = [(word, 0.0)]
        for at in reversed(places):
            out += [(w[:at] + w[at + 1 :], cost + COLLAPSED) for w, cost in out]
        return out

    def _spelled(self, word: str) -> float:
        """Minus the log of a word's probability under the model."""
        logs, total, ab = self.logs, 0.0, 0
        for letter in word:
            at = ab * CLASSES + class_of(letter)
            total -= logs[at]
            ab = at % CLASSES**2
        return total - logs[ab * CLASSES]

    def decode(self, token: str) -> tuple[float, str]:
        """The least cost of a path through the token's lattice, and what it reads.

        A state is the last two classes and the last character; what it read is
        a chain of characters, so long tokens take linear time.
        """
        if (readings := self.readings(token)) is not None:
            return min(((cost + self._spelled(w), w) for w, cost in readings), key=lambda x: x[0])
        logs = self.logs
        states: dict[tuple[int, str], tuple[float, tuple | None]] = {(0, ""): (0.0, None)}
        for i, raw in enumerate(token):
            if raw.isalpha() and (not i or token[i - 1] != raw):  # one arc without cost
                c = class_of(raw)
                if len(states) == 1:
                    [((ab, _), (cost, chain))] = states.items()
                    at = ab * CLASSES + c
                    states = {(at % CLASSES**2, raw): (cost - logs[at], (raw, chain))}
                    continue
                arcs = ((raw, 0.0),)
            else:
                arcs = self.arcs(token, i)
            step: dict[tuple[int, str], tuple[float, tuple | None]] = {}
            for letter, extra in arcs:
                c = class_of(letter) if letter else 0
                for state, (cost, chain) in states.items():
                    if letter:
                        at = state[0] * CLASSES + c
                        key, total, chain = (at % CLASSES**2, letter), cost + extra - logs[at], (letter, chain)
                    else:
                        key, total = state, cost + extra
                    if key not in step or total < step[key][0]:
                        step[key] = (total, chain)
            states = step
        total, chain = min(((cost - logs[ab * CLASSES], chain) for (ab, _), (cost, chain) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return total, "".join(reversed(out))

    def restore(self, token: str) -> str:
        """The best path through the token's lattice, its words apart."""
        return " ".join(self.decode(token)[1].split())

    def read(self, token: str) -> tuple[str, ...]:
        """The token without outer marks, and the words it is restored to if those are something else."""
        low = token.lower()
        plain = low.strip(OUTER)
        if plain.isalpha() and not DOUBLE.search(plain) and (plain == low or MAY_BE_LETTER.isdisjoint(low)):
            return (plain,)
        found = [plain] if plain else []
        if plain and self.suspicious(plain):
            found += self.restore(plain).split()
        if plain != low and any(c in LEET for c in low[: len(low) - len(low.lstrip(OUTER))] + low[len(low.rstrip(OUTER)) :]):
            # Outer marks may stand for letters; longer tails of marks are decoration.
            whole = re.sub(r"^(\W)\1+|(\W)\2+$", "", low)
            if whole != plain and not whole.isalpha():
                found += self.restore(whole).split()
        return tuple(dict.fromkeys(found))

    def words(self, token: str) -> tuple[str, ...]:
        """``read``, kept for each distinct token."""
        return self.split[token]

    def run(self, spaced: str) -> str:
        """A run of single characters, restored; two spaces and more are a wide gap."""
        return self.restore(SEPARATORS.sub(lambda m: "\n" if "  " in m[0] else " ", spaced.lower()))

    def spaced(self, text: str) -> list[str]:
        """Words that are spaced out in the text, restored."""
        return [w for a, b in runs(text) for w in self.run(text[a:b]).split()]

    def restore_text(self, text: str) -> str:
        """The text with every token restored."""
        parts, at = [], 0
        for a, b in runs(text):
            parts += [text[at:a], self.run(text[a:b])]
            at = b
        text = "".join([*parts, text[at:]])
        return re.sub(r"\S+", lambda m: self.restore(low) if self.suspicious(low := m[0].lower().strip(OUTER)) and not low.isalpha() else m[0], text)


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in STEMS if len(word) >= n)]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of the class trigrams of all documents; each task sums its own."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in sliced(batch, 256):
                total += np.bincount(np.concatenate([trigrams(t) for t in texts_of(part.column("text"))]), minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])
        release()

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(rows: DataFrame, sent) -> DataFrame:
    """(word, t, c) of labelled rows (text, toxic): the toxic and the clean documents that hold the restored word, each once."""

    def run(batches):
        restorer = Restorer(sent.value)
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            for counter, is_toxic in zip(held, (False, True), strict=True):
                items = iter(counter.items())
                while some := list(islice(items, 1 << 14)):
                    words, values = zip(*some, strict=True)
                    values, zero = pa.array(values, pa.int64()), pa.array(np.zeros(len(words), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), values if is_toxic else zero, zero if is_toxic else values], ["word", "t", "c"])
                counter.clear()

        for batch in batches:
            for part in sliced(batch, 256):
                for text, label in zip(texts_of(part.column("text")), part.column("toxic").to_pylist(), strict=True):
                    found = set(restorer.spaced(text))
                    held[label].update(found.union(*map(restorer.split.__getitem__, set(text.split()))))
                if sum(map(len, held)) > MOST_HELD:
                    yield from flush()
        yield from flush()
        del restorer
        release()

    return rows.select("text", "toxic").mapInArrow(run, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def character_model(grams: DataFrame) -> np.ndarray:
    """log p of each class trigram, interpolated with bigrams and unigrams; the table has CLASSES ** 3 rows at most."""
    t = grams.toArrow()
    n3 = np.zeros(CLASSES**3)
    n3[t["gram"].to_numpy()] = t["n"].to_numpy()
    n3 = n3.reshape(CLASSES, CLASSES, CLASSES)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    kinds2 = (n2 > 0).sum(axis=1, keepdims=True)
    p2 = (n2 + (kinds2 + 1) * p1[None, :]) / (n2.sum(axis=1, keepdims=True) + kinds2 + 1)
    kinds3 = (n3 > 0).sum(axis=2, keepdims=True)
    p3 = (n3 + (kinds3 + 1) * p2[None, :, :]) / (n3.sum(axis=2, keepdims=True) + kinds3 + 1)
    return np.log(p3)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the folds to learn from; an id that is labelled both ways is toxic."""
    learn = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    return learn.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def weights(words: DataFrame, base: float) -> DataFrame:
    """(key, t, c): toxic and clean documents of every feature that has evidence, also when one clean document is left out."""
    beginnings = [F.when(F.length("word") >= n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in STEMS]
    every = F.explode(F.array_compact(F.array(F.concat(F.lit("="), F.col("word")), *beginnings)))
    found = words.select(every.alias("key"), "t", "c").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 0")
    t, c = F.col("t") + PRIOR_DOCS * base, F.greatest(F.col("c") - 1, F.lit(0)) + PRIOR_DOCS * (1 - base)
    bound = F.log(t / c) - ERRORS * F.sqrt(1 / t + 1 / c)
    return found.where(bound > float(np.log(base / (1 - base)))) if 0 < base < 1 else found.where(F.lit(False))


class Evidence:
    """What the words of a text say, by the counts of their features (``known``: a ``Shards`` or dict of them)."""

    MOST = 400_000

    def __init__(self, logs: np.ndarray, known: Shards | dict[str, tuple[int, int]], base: float):
        self.restorer, self.base = Restorer(logs), base
        self.known = known if isinstance(known, dict) else known.held(HELD_FEATURES) or known
        self.held = self._split(self.known) if isinstance(self.known, dict) else None
        self.seen: set[str] = set()
        #: Tokens that have evidence, and the counts of the feature that says most.
        self.strong: dict[str, tuple[int, int]] = {}

    def _best(self, words) -> tuple[int, int] | None:
        return max((c for w in words for f in features(w) if (c := self.known.get(f))), key=self.weight, default=None)

    def meet(self, tokens: set[str]) -> None:
        """Looks up the tokens that weren't met before."""
        if len(self.seen) > self.MOST:
            self.seen, self.strong = set(), {}
        tokens = tokens - self.seen
        self.seen |= tokens
        known = self.known
        if isinstance(known, Shards):
            known = known.get_many({f for t in tokens for w in self._forms(t) for f in features(w)})
        if not known:
            return
        whole, stems = self.held or self._split(known)
        for token in tokens:
            for word in self._forms(token):
                if word in whole or any([word[:n] in stems for n in STEMS]):
                    if held := [c for w in self.restorer.read(token) for f in features(w) if (c := known.get(f))]:
                        self.strong[token] = max(held, key=self.weight)
                    break

    @staticmethod
    def _split(known: dict) -> tuple[set[str], set[str]]:
        """Whole words, and beginnings, whose lengths say which they are."""
        return {f[1:] for f in known if f[0] == "="}, {f[1:] for f in known if f[0] == "^"}

    def _forms(self, token: str) -> list[str] | tuple[str, ...]:
        """Words among which are all that the token is restored to; for doubled letters every reading, which is sooner told than the best."""
        low = token.lower()
        plain = low if low.isalpha() else low.strip(OUTER)
        if plain.isalpha() and (plain is low or MAY_BE_LETTER.isdisjoint(low)):
            if not DOUBLE.search(plain):
                return (plain,)
            if (readings := self.restorer.readings(plain)) is not None:
                return [w for w, _ in readings]
        return self.restorer.read(token)

    def weight(self, counts: tuple[int, int], own: int | None = None) -> float:
        """Lower bound of the log odds above the base, 0 at least; ``own``: the label of a training text, which is left out."""
        if not 0 < self.base < 1:
            return 0.0
        t = max(counts[0] - (own == 1), 0) + PRIOR_DOCS * self.base
        c = max(counts[1] - (own == 0), 0) + PRIOR_DOCS * (1 - self.base)
        return max(math.log(t / c) - ERRORS * math.sqrt(1 / t + 1 / c) - math.log(self.base / (1 - self.base)), 0.0)

    def of_many(self, texts: list[str], own: list[int | None] | None = None) -> list[list[float]]:
        """For each text 1, log of the sum of evidence, the two strongest weights, log of the length."""
        split, out = [t.split() for t in texts], []
        self.meet(set().union(*split))
        strong = self.strong
        for text, words, label in zip(texts, split, own or [None] * len(texts), strict=True):
            found = [strong[w] for w in words if w in strong]
            if "  " in text or any(len(w) < 3 for w in words):
                found += [c for w in self.restorer.spaced(text) if (c := self._best([w]))]
            top = sorted((self.weight(c, label) for c in found), reverse=True) + [0.0, 0.0]
            out.append([1.0, math.log1p(sum(top)), top[0], top[1], math.log1p(len(words))])
        return out


def fitted(rows: list[list[float]], labels: list[int]) -> np.ndarray:
    """Coefficients of a logistic function, by Newton's method with a small ridge."""
    x, y = np.array(rows, float).reshape(-1, 5), np.array(labels, float)
    beta = np.zeros(5)
    ridge = np.diag([1e-3, 1, 1, 1, 1]) * 0.5
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (doc_id, text).

    labels: doc_id, toxic (0 or 1); only rows outside the held-out fold are
    used. Null and empty texts have the score of a text without evidence. A
    null id isn't held out. Rows that repeat an id are scored by their own
    texts, and all of them are counted; in the sample that the final function is
    fitted on such an id has one place, the row of least evidence. Without
    labels, or with labels of one kind, there is no evidence. Very long texts
    and tokens take time in proportion to their length. Other columns are
    ignored; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    learn = written(training_labels(labels), "toxic-training")
    n, toxic = learn.agg(F.count("*"), F.sum("toxic")).first()
    model = context.broadcast(character_model(gram_counts(docs)))
    labelled = docs.select("doc_id", "text").join(small_side(learn), "doc_id")
    words = written(word_counts(labelled, model), "toxic-words")
    # Of all words that documents hold, the share that toxic ones do: these may be longer.
    t, c = (x or 0 for x in words.agg(F.sum("t"), F.sum("c")).first())
    base = t / (t + c) if t + c else 0.0
    sent = context.broadcast((sharded(weights(words, base), "toxic-features"), base))

    sample = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)

    def measure(batches):
        evidence = Evidence(model.value, Shards(sent.value[0]), sent.value[1])
        for batch in batches:
            for part in sliced(batch, 256):
                y = part.column("toxic").to_pylist()
                x = evidence.of_many(texts_of(part.column("text")), y)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])
        del evidence
        release()

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(measure, "doc_id long, toxic int, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("x").alias("x")).collect() if n else []
    beta = fitted([r["x"] for r in rows], [r["toxic"] for r in rows]) if len({r["toxic"] for r in rows}) == 2 else np.array([np.inf if toxic else -np.inf, 0, 0, 0, 0])

    def run(batches):
        evidence = Evidence(model.value, Shards(sent.value[0]), sent.value[1])
        for batch in batches:
            for part in sliced(batch, 256):
                x = np.array(evidence.of_many(texts_of(part.column("text"))))
                with np.errstate(over="ignore"):
                    score = 1 / (1 + np.exp(-(x @ beta if np.isfinite(beta[0]) else np.full(len(x), beta[0]))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])
        del evidence
        release()

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that aren't predicted toxic; a row goes if its id is."""
    gone = classify(docs, labels).where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(small_side(written(gone, "toxic-ids")), "doc_id", "left_anti").select(*docs.columns)


def op6_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
