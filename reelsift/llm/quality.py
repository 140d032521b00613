"""Operator 10: quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is over symbols of text: letters, classes of other characters, and
one symbol for a word that repeats the word before it. Each task counts the
n-grams of its trusted documents in an array; the counts are summed by n-gram,
and continuation counts, context totals, discounts and interpolated
probabilities come from joins of these tables on n-grams and their contexts.
A model has at most SYMBOLS ** ORDER n-grams, whatever the corpus, so it is
sent to the tasks as one array of proven size; a document's perplexity takes a
look-up for each of its symbols.

This model is the base of a word model, which grows with the trusted text: all
its words and pairs of words, unfolded, are counted in sorted shards in the
shared folder, which the tasks map and search. A word that wasn't seen has the
probability of its symbols (Witten-Bell), a pair that wasn't seen that of its
word (Dirichlet). A trusted document is scored without its own counts, so
thresholds, the quantiles of trusted documents in each language, hold for
documents that weren't counted.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import ChunkTable, bound_batches, files_of, release, sliced, small_side, table, texts_of, written
from reelsift.session import replace_file, shared_dir

ORDER = 4
#: Symbols: 26 letters, 14 classes of other letters, and those below.
UPPER, DIGIT, SPACE, LINE, STOP, COMMA, MARK, SIGN, REPEAT, OTHER = range(40, 50)
SYMBOLS = 50
#: A trusted document is above its language's threshold with this probability at most ...
QUANTILE = 0.999
#: ... and a document is rejected if its mean information is above the threshold by this factor.
MARGIN = 1.05
#: Trusted documents by which a language's threshold is drawn to that of all.
PRIOR_TRUSTED = 30
#: Symbols of average text that are added to each document, so few symbols decide little.
PRIOR = 100
#: Observations that the word's own probability is worth after another word.
PAIR_PRIOR = 5.0
#: Share of the word model; the rest is the probability of a word's symbols.
WORD_SHARE = 0.5
#: Files of the table of words and pairs at least, bytes of the source's files for each, and words that a task counts before it passes their sums on.
SHARDS, SHARD_BYTES = 128, 4 << 20
MOST_HELD = 1 << 20


def _classes() -> np.ndarray:
    """The symbol of each code point below 2^16; those above count as OTHER."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in range(0x80, 1 << 16):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            out[c] = UPPER if ch.isupper() else 26 + c % 14
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch.isspace():
            out[c] = SPACE
    for c in range(0x80):
        ch = chr(c)
        if ch.islower():
            out[c] = c - ord("a")
        elif ch.isupper():
            out[c] = UPPER
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch in "\n\r":
            out[c] = LINE
        elif ch.isspace():
            out[c] = SPACE
        elif ch in ".?!":
            out[c] = STOP
        elif ch == ",":
            out[c] = COMMA
        elif ch in "'\"()-:;/":
            out[c] = MARK
        elif ch.isprintable():
            out[c] = SIGN
    out[1] = REPEAT
    return out


_tables: dict = {}


def symbols(text: str) -> np.ndarray:
    """The symbols of a text; a word that repeats the one before is one symbol, without its space."""
    if "classes" not in _tables:
        _tables["classes"] = _classes()
    words = text.split(" ")
    if len(words) > 1:
        text = words[0] + "".join(["\x01" if w == p and w else " " + w for p, w in zip(words, words[1:])])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _tables["classes"][np.minimum(points, 0xFFFF)]


def grams(text: str) -> np.ndarray:
    """Codes of the n-grams that end at each symbol; before the text there are line ends."""
    s = symbols(text).astype(np.int64)
    n = len(s)
    s = np.concatenate([np.full(ORDER - 1, LINE, np.int64), s])
    code = np.zeros(n, np.int64)
    for j in range(ORDER):
        code = code * SYMBOLS + s[j : j + n]
    return code


def counts(texts: DataFrame) -> DataFrame:
    """(gram, n) of all texts; each task sums its own before anything is shuffled."""

    def run(batches):
        total = np.zeros(SYMBOLS**ORDER, np.uint32)
        held, size = [], 0

        def add():
            nonlocal held, size
            if held:
                codes, n = np.unique(np.concatenate(held), return_counts=True)
                total[codes] += n.astype(np.uint32)
            held, size = [], 0

        for batch in batches:
            for part in sliced(batch, 256):
                for text in texts_of(part.column("text")):
                    held.append(grams(text))
                    size += len(held[-1])
                if size > 1 << 19:
                    add()
        add()
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 1 << 16):
            some = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["gram", "n"])
        del total
        release()

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(grams_: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; 0.5, 1 and 1.5 where those are degenerate."""
    c1, c2, c3, c4 = grams_.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first()
    if not all((c1, c2, c3, c4)):
        return 0.5, 1.0, 1.5
    y = c1 / (c1 + 2 * c2)
    found = (1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def estimate(counted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of seen n-grams and (context, rest), the weight left to the order below.

    Orders below the highest count the different symbols seen before a gram.
    """
    levels = [counted]
    for order in range(ORDER - 1, 0, -1):
        size = SYMBOLS**order
        levels.append(levels[-1].groupBy((F.col("gram") % size).alias("gram")).agg(F.count("*").alias("n")))
    out = []
    below = None
    for order, level in enumerate(reversed(levels), 1):
        level = written(level, f"grams-{order}")
        d1, d2, d3 = discounts(level)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.floor(F.col("gram") / SYMBOLS).cast("long")
        held = level.withColumn("context", context).withColumn("_off", F.least(off, F.col("n")))
        contexts = held.groupBy("context").agg(F.sum("n").alias("_total"), F.sum("_off").alias("_rest"))
        rest = contexts.select("context", (F.col("_rest") / F.col("_total")).alias("rest"))
        own = held.join(contexts.select("context", "_total"), "context").join(rest, "context")
        own = own.withColumn("_p", (F.col("n") - F.col("_off")) / F.col("_total"))
        if below is None:
            p = own.select("gram", (F.col("_p") + F.col("rest") / SYMBOLS).alias("p"))
        else:
            suffix = (F.col("gram") % SYMBOLS ** (order - 1)).alias("_suffix")
            lower = below.select(F.col("gram").alias("_suffix"), F.col("p").alias("_lower"))
            p = own.select("gram", "_p", "rest", suffix).join(lower, "_suffix").select("gram", (F.col("_p") + F.col("rest") * F.col("_lower")).alias("p"))
        below = written(p, f"p-{order}")
        out.append((below, rest))
    return out


def array_of(model: list[tuple[DataFrame, DataFrame]]) -> np.ndarray:
    """log p of every n-gram. The rows fetched for it are n-grams of the model, SYMBOLS ** ORDER at most."""
    lower = np.full(1, 1 / SYMBOLS)
    for order, (p, rest) in enumerate(model, 1):
        weight = np.ones(SYMBOLS ** (order - 1))
        t = rest.toArrow()
        weight[t["context"].to_numpy()] = t["rest"].to_numpy()
        # What isn't seen has the probability of its suffix, by the weight that its context leaves.
        if order == 1:
            full = np.full(SYMBOLS, weight[0] / SYMBOLS)
        else:
            full = (weight.reshape(SYMBOLS, -1, 1) * lower.reshape(1, -1, SYMBOLS)).reshape(-1)
        t = p.toArrow()
        full[t["gram"].to_numpy()] = t["p"].to_numpy()
        lower = full
    return np.log(lower).astype(np.float32)


#: What stands before the first word. A word is what single spaces separate, as for ``REPEAT``.
START = np.uint64(0x9E3779B97F4A7C15)


def word_table() -> ChunkTable:
    """64-bit hashes of words; the lowest bit is 1, so they differ from those of pairs."""
    return ChunkTable(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1, most=100_000)


def keys_of(text: str, table: ChunkTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a text: its key, that of its pair with the word before, and its number of symbols."""
    words = text.split(" ") if text else []
    own = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    before = np.concatenate([[START], own[:-1]]).astype(np.uint64)[: len(own)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    again = np.concatenate([[False], (own[1:] == own[:-1]) & (size[1:] > 0)])[: len(own)]
    size[1:] += 1
    size[again] = 1
    mixed = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + own
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return own.view(np.int64), (mixed & ~np.uint64(1)).view(np.int64), size


def word_counts(texts: DataFrame) -> tuple[str, int, int, int]:
    """Counts the words and pairs of all texts: the folder of the shards, the words in all, the different ones, and the number of shards.

    A task sends sorted keys and counts of each shard as one value, so keys move
    as they are. A shard is three files: sorted keys, their counts in a byte,
    and (place, count) of those of 255 and more. There are more shards for
    larger sources, so one task can hold a shard's keys.
    """
    spark = texts.sparkSession
    size = int(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(SHARDS, -(-size // SHARD_BYTES)) if size < 1 << 60 else SHARDS
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/reelsift-words-{uuid.uuid4().hex}"

    def count(batches):
        table, held, size = word_table(), [], 0

        def flush():
            nonlocal held, size
            if held:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                of = (keys >> 1) % shards
                order = np.argsort(of, kind="stable")
                keys, n, ends = keys[order], n[order].astype(np.int64), np.searchsorted(of[order], np.arange(shards + 1))
                for at in range(0, shards, 64):
                    some = [(i, slice(ends[i], ends[i + 1])) for i in range(at, min(at + 64, shards)) if ends[i] < ends[i + 1]]
                    columns = [pa.array([i for i, _ in some], pa.int32()), *(pa.array([x[part].tobytes() for _, part in some], pa.binary()) for x in (keys, n))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "keys", "counts"])
            held, size = [], 0

        for batch in batches:
            for part in sliced(batch, 256):
                for text in texts_of(part.column("text")):
                    own, pairs, _ = keys_of(text, table)
                    held += [own, pairs, np.full(min(len(own), 1), START).view(np.int64)]
                    size += len(own)
                    if size > MOST_HELD:
                        yield from flush()
        yield from flush()
        release()

    def write(batches):
        files, root = files_of(folder)
        files.create_dir(root, recursive=True)
        words = kinds = 0
        at, held = None, []

        def close():
            nonlocal words, kinds
            keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, back, np.concatenate([c for _, c in held]))
            is_word = (keys & 1 == 1) & (keys != START.view(np.int64))
            words, kinds = words + int(n[is_word].sum()), kinds + int(is_word.sum())
            more = np.flatnonzero(n >= 255)
            for end, values in (("keys", keys), ("counts", np.minimum(n, 255).astype(np.uint8)), ("more", np.concatenate([more, n[more]]).astype(np.int64))):
                temp = f"{root}/{at}.{end}.{uuid.uuid4().hex}"
                with files.open_output_stream(temp, compression=None) as stream:
                    stream.write(values.tobytes())
                replace_file(files, temp, f"{root}/{at}.{end}")

        for batch in batches:
            for shard, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if held:
                        close()
                    at, held = shard, []
                held.append((np.frombuffer(keys, np.int64), np.frombuffer(n, np.int64)))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([kinds])], ["words", "kinds"])
        release()

    rows = texts.select("text").mapInArrow(count, "shard int, keys binary, counts binary")
    dealt = rows.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard")
    words, kinds = dealt.mapInArrow(write, "words long, kinds long").agg(F.sum("words"), F.sum("kinds")).first()
    return folder, words or 0, kinds or 0, shards


class WordModel:
    """Information of words, by look-ups in the shards of ``word_counts``; files are mapped, so memory doesn't grow with them."""

    def __init__(self, folder: str, words: int, kinds: int, shards: int = SHARDS):
        self.folder, self.words, self.kinds, self.n_shards = folder, words, kinds, shards
        self.table, self.shards = word_table(), {}

    def _shard(self, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if shard not in self.shards:
            files, root = files_of(self.folder)
            found = []
            for end, kind in (("keys", np.int64), ("counts", np.uint8), ("more", np.int64)):
                path = f"{root}/{shard}.{end}"
                if not files.get_file_info(path).size:
                    found.append(np.zeros(0, kind))
                elif isinstance(files, fs.LocalFileSystem):
                    found.append(np.memmap(path, kind, "r"))
                else:  # only local files can be mapped
                    found.append(np.frombuffer(files.open_input_file(path).read(), kind))
            self.shards[shard] = tuple(found)
        return self.shards[shard]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, 0 for those that weren't seen."""
        keys, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        of = (keys >> 1) % self.n_shards
        order = np.argsort(of, kind="stable")
        for where in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            held, n, more = self._shard(int(of[where[0]])) if len(where) else ((), (), ())
            if len(held):
                at = np.minimum(held.searchsorted(keys[where]), len(held) - 1)
                found = np.where(held[at] == keys[where], n[at], 0).astype(np.int64)
                large = np.flatnonzero(found == 255)
                if len(large):  # the byte is full: the count is in the table of large ones
                    found[large] = more[len(more) // 2 + np.searchsorted(more[: len(more) // 2], at[large])]
                out[where] = found
        return out[back]

    def information(self, texts: list[str], symbols_: list[np.ndarray], own: list[bool]) -> list[float]:
        """Minus the sum of log p of each text. ``symbols_``: log p of its symbols; ``own``: whether the text was counted, and is left out."""
        keys = [keys_of(t, self.table) for t in texts]
        if not any(len(k[0]) for k in keys):
            return [0.0] * len(texts)
        start = START.view(np.int64)
        seen = self.counts(np.concatenate([x for k in keys for x in k[:2]] + [[start]]))
        starts, at, out = int(seen[-1]), 0, []
        for (words, pairs, size), logs, mine in zip(keys, symbols_, own, strict=True):
            n = len(words)
            if not n:
                out.append(0.0)
                continue
            c, c2, total, kinds = seen[at : at + n].astype(float), seen[at + n : at + 2 * n].astype(float), self.words, self.kinds
            at += 2 * n
            first = float(starts)
            if mine:
                (_, inverse, k), (_, inverse2, k2) = (np.unique(x, return_inverse=True, return_counts=True) for x in (words, pairs))
                k = k[inverse]
                kinds -= float((1 / k[c <= k]).sum())  # words that no other text holds
                c, c2, total, first = np.maximum(c - k, 0), np.maximum(c2 - k2[inverse2], 0), max(total - n, 0), max(first - 1, 0)
            ends = np.cumsum(size)
            sums = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
            base = sums[ends] - sums[ends - size]  # log p of each word's symbols
            kinds = max(kinds, 0.0) + 1.0
            known = np.log(np.maximum(c, 1e-300)) - np.log(total + kinds)
            single = np.logaddexp(np.where(c > 0, known, -np.inf), base + np.log(kinds) - np.log(total + kinds))
            history = np.concatenate([[first], c[:-1]])
            pair = np.where(c2 > 0, np.log(np.maximum(c2, 1e-300)), -np.inf)
            both = np.logaddexp(pair, np.log(PAIR_PRIOR) + single) - np.log(history + PAIR_PRIOR)
            out.append(-float(np.logaddexp(both + np.log(WORD_SHARE), base + np.log(1 - WORD_SHARE)).sum()))
        return out


def score(docs: DataFrame, logs: np.ndarray, words: tuple[str, int, int, int], counted: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols and information (minus the sum of log p) of each document; ``counted``: ids whose texts were."""
    sent = docs.sparkSession.sparkContext.broadcast((logs, words))

    def run(batches):
        logs, words = sent.value
        model = WordModel(*words)
        for batch in batches:
            for part in sliced(batch, 256):
                texts = texts_of(part.column("text"))
                symbols_ = [logs[grams(t)] for t in texts]
                n = pa.array(map(len, symbols_), pa.int64())
                information = pa.array(model.information(texts, symbols_, part.column("own").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), n, information], ["doc_id", "lang", "n_symbols", "information"])
        del model
        release()

    rows = docs.select("doc_id", "text", "lang").join(counted.withColumn("own", F.lit(True)), "doc_id", "left")
    rows = rows.select("doc_id", "text", "lang", F.coalesce("own", F.lit(False)).alias("own"))
    return rows.mapInArrow(run, "doc_id long, lang string, n_symbols long, information double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never bad."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep of every row of documents (doc_id, text, lang).

    labels: doc_id, quality (1: trusted). Documents without text have a null
    perplexity and are kept: nothing speaks against them. A null language is a
    language; one without trusted documents has the threshold of all, and one
    with few of them is drawn to it.
    Without any trusted documents every document is kept. Very long texts are
    scored whole; an empty table gives no rows. Rows that
    repeat an id are judged by their own texts. Other columns are ignored.
    """
    trained = small_side(written(trusted_ids(labels), "trusted"))
    texts = docs.select("doc_id", "text").join(trained, "doc_id", "left_semi")
    counted = written(counts(texts), "grams")
    scored = written(score(docs, array_of(estimate(counted)), word_counts(texts), trained), "scores")

    trusted = written(scored.join(trained, "doc_id", "left_semi").where("n_symbols > 0"), "trusted-scores")
    mean = trusted.agg(F.sum("information") / F.sum("n_symbols")).first()[0] or 0.0
    bits = (F.col("information") + PRIOR * mean) / (F.col("n_symbols") + PRIOR)
    cut = F.percentile_approx(bits, QUANTILE, 10000)
    every = trusted.agg(cut).first()[0]
    by_lang = trusted.groupBy("lang").agg(cut.alias("_cut"), F.count("*").alias("_n"))
    drawn = (F.col("_n") * F.col("_cut") + PRIOR_TRUSTED * F.lit(every).cast("double")) / (F.col("_n") + PRIOR_TRUSTED)
    by_lang = small_side(written(by_lang.select(F.col("lang").alias("_lang"), drawn.alias("_own")), "thresholds"))
    rows = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce(F.col("_own"), F.lit(every).cast("double")) * MARGIN
    keep = F.coalesce(bits <= limit, F.lit(True)) | (F.col("n_symbols") == 0)
    ppl = F.when(F.col("n_symbols") > 0, F.exp(bits))
    return rows.select("doc_id", "lang", "n_symbols", ppl.alias("perplexity"), F.exp(limit).alias("threshold"), keep.alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier keeps; a row goes if its id is rejected."""
    gone = classify(docs, labels).where("NOT keep AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(small_side(written(gone, "rejected")), "doc_id", "left_anti").select(*docs.columns)


def op10_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
