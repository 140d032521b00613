"""Operator 2: n-gram Jaccard join, lossless.

A document is the set of hashes of its distinct word shingles. Sets can only
link with sets of about their own size, so sizes are cut into bands. Within a
band every set is cut into parts by ranges of the hashes. Sets that link differ
in at most d elements, so of the first d + 1 parts that the smaller set fills,
one at least is the same in the other: sets that share a part make a tile. (A
set sends parts to its own band and, if it is near the band's lower end, to the
band below.) Shared passages spread over all parts and make few tiles.

A tile's sets are first held against its smallest member only, so a tile of n
sets asks for n - 1 pairs. A pair passes a bound first: set sizes and the bit
count of the exclusive-or of two bitmap signatures, in which each element flips
one bit, bound the overlap from above. What passes is decided by intersecting
the exact sorted arrays, made from the texts again. Tiles that are not
connected by then are compared in blocks of signatures, all pairs between
different components, inside the workers; again only pairs that pass the bound
leave them and are decided exactly: first the nearest pairs that would connect
what can be connected, then all that are left between what stayed apart. No
link between different sets that would connect two components is missed.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelsift.llm.common import ChunkTable, release, sliced, small_side, table, written
from reelsift.llm.components import components

#: Upper end of a band of sizes over its lower end.
BAND = 1.5
#: Bits of a signature for each element of the largest set of a band: with few collisions the bound is tight.
BITS = 2
#: Sets of a block in which signatures are compared all with all.
BLOCK = 512
#: Distinct sets that a task remembers, to send the parts of copies once.
REMEMBERED = 50_000
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_words: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, one for the whole sequence."""
    words = text.translate(LOWER).split()  # bytes split at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if "hash" not in _words:
        _words["hash"] = ChunkTable(xxhash.xxh3_64_intdigest, most=100_000)
    h = np.fromiter(map(_words["hash"].__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = mix(h[: len(h) - n + 1] + np.uint64(n))
    for j in range(1, n):
        out = mix(out ^ h[j : len(h) - n + 1 + j])
    return np.unique(out)


@lru_cache(maxsize=None)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the size bands."""
    lo, hi = [1], [1]
    while hi[-1] < 2**40:
        lo.append(hi[-1] + 1)
        hi.append(int(lo[-1] * BAND))
    assert BAND * percent >= 100, "a set must not reach over a whole band"
    return np.array(lo), np.array(hi)


def differing(n: int, percent: int) -> int:
    """Most elements in which a set of n can differ from a linked set that isn't smaller."""
    return n * (100 - percent) // percent


@lru_cache(maxsize=None)
def parts(band: int, percent: int, finer: int) -> int:
    """Parts of a band: few, but so many that all its sets fill d + 1 of them (six deviations to spare)."""
    lo, hi = (int(x[band]) for x in bands(percent))
    if not differing(hi, percent):
        return 1

    def fills(m: int) -> bool:
        for n in (lo, hi):
            x = math.exp(-n / m)
            spread = math.sqrt(max(m * x * (1 - (1 + n / m) * x), 0))
            if m * (1 - x) - 6 * spread < differing(n, percent) + 1:
                return False
        return True

    m = differing(hi, percent) + 1
    while not fills(m) and m < 2**20:
        m = math.ceil(m * 1.05)
    return min(m * finer, 2**30)


def part_keys(sets: np.ndarray, percent: int, finer: int = 1) -> tuple[np.ndarray, bool]:
    """The keys of a set's parts, and whether it fills too few for the guarantee."""
    n = len(sets)
    lo, hi = bands(percent)
    own = int(np.searchsorted(hi, n))
    wanted = differing(n, percent) + 1
    out, short = [], False
    for band in (own, own - 1):
        if band < 0 or band < own and 100 * int(hi[band]) < percent * n:
            continue
        m = parts(band, percent, finer)
        part = ((sets >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        short |= band == own and len(starts) < wanted
        ends = np.append(starts, n)[: wanted + 1]
        starts = starts[:wanted]
        sums = np.add.reduceat(mix(sets[: ends[-1]] if len(ends) > wanted else sets), starts)
        out.append(mix(sums ^ mix(part[starts] + (np.uint64(band) << np.uint64(40)))))
    return np.concatenate(out), short


def signature(sets: np.ndarray, percent: int) -> bytes:
    """A bitmap of about ``BITS`` bits for each element, in which each element flips the bit of its low bits."""
    bits = max(64, BITS << (int(bands(percent)[1][np.searchsorted(bands(percent)[1], len(sets))]) - 1).bit_length())
    flips = np.bincount((sets & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def most_apart(na: int, nb: int, percent: int) -> int:
    """Most elements in which linked sets of these sizes differ."""
    return (100 - percent) * (na + nb) // (100 + percent)


def folded(sig: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        sig = (sig >> bits) ^ (sig & ((1 << bits) - 1))
    return sig


def may_link(na: int, sa: bytes, nb: int, sb: bytes, percent: int) -> bool:
    """The bound by sizes and signatures; never false for sets that link."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    bits = 8 * min(len(sa), len(sb))
    a, b = (folded(int.from_bytes(s, "little"), 8 * len(s), bits) for s in (sa, sb))
    return (a ^ b).bit_count() <= most_apart(na, nb, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on sorted arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


SETS = "doc_id long, n long, d1 long, d2 long, sig binary, keys array<long>, short boolean"


def sets_of(docs: DataFrame, width: int, percent: int, finer: int) -> DataFrame:
    """A row for each document: set size, digest, signature, and keys unless its task sent that set's before."""

    def run(batches):
        known: set = set()
        for batch in batches:
            for part in sliced(batch, 256):
                ids, rows, keys, ends = part.column("doc_id"), [], [], [0]
                for doc_id, text in zip(ids.to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    found = shingles(text or b"", width)
                    if not len(found):
                        rows.append((0, None, None, None, False))
                        ends.append(ends[-1])
                        continue
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    d1, d2 = np.frombuffer(digest, np.int64).tolist()
                    if digest in known or doc_id is None:
                        rows.append((len(found), d1, d2, signature(found, percent), False))
                        ends.append(ends[-1])
                        continue
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(digest)
                    own, short = part_keys(found, percent, finer)
                    keys.append(own)
                    ends.append(ends[-1] + len(own))
                    rows.append((len(found), d1, d2, signature(found, percent), short))
                values = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                n, d1, d2, sig, short = zip(*rows, strict=True)
                columns = [ids, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), listed, pa.array(short, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "sig", "keys", "short"])
        known.clear()
        _words.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures let them link."""
    side = sets.select("rep", "n", "sig")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(
        side.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"
    )

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")]
            kept = pa.array([may_link(*x, percent) for x in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(kept)

    return both.mapInArrow(run, "a long, b long").distinct()


def decided(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the exact sets of their texts."""
    texts = docs.select("doc_id", "text")
    one = pairs.join(texts.alias("tb"), F.col("b") == F.col("tb.doc_id")).select("a", "b", F.col("tb.text").alias("text_b"))
    both = one.join(texts.alias("ta"), F.col("a") == F.col("ta.doc_id")).select("a", "b", "text_b", F.col("ta.text").alias("text_a"))

    def run(batches):
        last, held = None, None
        for batch in batches:
            for part in sliced(batch, 256):
                ids, kept = part.column("a").to_pylist(), []
                for a, tb, ta in zip(ids, *(part.column(c).cast(pa.binary()).to_pylist() for c in ("text_b", "text_a")), strict=True):
                    if (a, ta) != last:
                        last, held = (a, ta), shingles(ta or b"", width)
                    kept.append(linked(held, shingles(tb or b"", width), percent))
                yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        _words.clear()
        release()

    return both.mapInArrow(run, "a long, b long").distinct()


def _block_pairs(percent: int, forest: bool):
    """Pairs between different components in the rows of two blocks of a tile.

    forest: just the nearest pairs that would connect all that can be connected.
    """

    def run(key, rows):
        d = {c: rows.column(c).to_pylist() for c in ("rep", "label", "n", "sig", "block")}
        width = min(map(len, d["sig"]))
        sig = np.array([np.frombuffer(folded(int.from_bytes(s, "little"), 8 * len(s), 8 * width).to_bytes(width, "little"), np.uint8) for s in d["sig"]])
        sig = sig.view(np.uint64)
        rep, label, n, block = (np.array(d[c], np.int64) for c in ("rep", "label", "n", "block"))
        _, first, second = (int(k.as_py()) for k in key)
        found = [np.zeros((3, 0), np.int64)]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        for i in left:
            apart = np.bitwise_count(sig[i] ^ sig[right]).sum(axis=1, dtype=np.int64)
            good = (apart <= (100 - percent) * (n[i] + n[right]) // (100 + percent)) & (label[right] != label[i])
            good &= 100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
            if first == second:
                good &= right > i
            js = right[good]
            found.append(np.stack([apart[good], np.full(len(js), i), js]))
        pairs = np.concatenate(found, axis=1)
        if forest and pairs.shape[1]:
            i, j = pairs[1], pairs[2]
            order = np.lexsort((np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j]), pairs[0]))
            over: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := over.get(x, x)) != x:
                    over[x] = x = over.get(y, y)
                return x

            kept = []
            for k, x, y in zip(order.tolist(), label[i][order].tolist(), label[j][order].tolist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    over[x] = y
                    kept.append(k)
            pairs = pairs[:, kept]
        a, b = rep[pairs[1]], rep[pairs[2]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def leftover_pairs(tiles: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs that pass the bound, between different components of one tile, in tiles of three sets and more.

    forest: of each two blocks only the nearest pairs, enough to connect what can be connected.
    """
    labelled = tiles.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    apart = labelled.groupBy("key").agg(
        F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("same")
    ).where("l0 <> l1 AND c > 2")
    # Tiles of the same members are compared once.
    once = apart.groupBy("c", "same").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.col("c") / BLOCK)
    rows = labelled.join(once.select("key", "c"), "key").join(sets.select("rep", "n", "sig"), "rep")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "rep", "label", "n", "sig", "block"
    )
    return rows.groupBy("key", "first", "second").applyInArrow(_block_pairs(percent, forest), "a long, b long").distinct()


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents (doc_id, text).

    Null and empty texts and texts without words have the empty set, which links
    with nothing. Rows without an id link with nothing and have no component.
    Rows that repeat an id are one document: it links by any of its texts. Other
    columns are ignored; an empty table gives no rows.
    """
    finer = 1
    while True:
        made = written(sets_of(docs, width, percent, finer), "sets")
        if not made.where("short").limit(1).count():
            break
        if finer > 2**20:
            raise RuntimeError("a set fills too few parts, however fine they are: its hashes aren't spread")
        finer *= 4
    filled = made.where("n > 0 AND doc_id IS NOT NULL")
    sets = written(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")), "distinct-sets")

    # Tiles: what is alone with its key is dropped at once, then copies become their representative.
    w = W.partitionBy("key").orderBy("doc_id")
    sent = made.where(F.size("keys") > 0)
    listed = sent.select(F.explode("keys").alias("key"), "doc_id").withColumns({"_before": F.lag("doc_id").over(w), "_after": F.lead("doc_id").over(w)})
    shared = listed.where("_before IS NOT NULL OR _after IS NOT NULL").select("key", "doc_id")
    senders = sent.select("doc_id", "d1", "d2").join(sets.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep")
    members = written(shared.join(senders, "doc_id").select("key", "rep").distinct(), "tile-members")
    heads = members.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("_last")).where("head < _last").select("key", "head")
    tiles = written(members.join(heads, "key").select("key", "head", "rep"), "tiles")

    stars = tiles.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    asked = written(bounded(stars, sets, percent), "star-pairs")
    # Only texts of tile members are ever compared: they are picked once, and those alone move afterwards.
    ids = small_side(written(tiles.select(F.col("rep").alias("doc_id")).distinct(), "tile-ids"))
    texts = written(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "tile-texts")
    links = written(decided(asked, texts, width, percent), "star-links")

    mapped = made.join(sets.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("doc_id", "n", "rep")
    # Different sets under one id belong together.
    several = mapped.where("rep IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).where("a <> _b")
    same_id = several.join(mapped, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = links.unionByName(same_id)
    labels = components(links)

    # First the nearest pairs only; then, between what they left apart, every pair that isn't decided yet.
    for forest in (True, False):
        rest = written(leftover_pairs(tiles, labels, sets, percent, forest).join(asked, ["a", "b"], "left_anti"), "leftover-pairs")
        if rest.isEmpty():
            continue
        links = written(links.unionByName(decided(rest, texts, width, percent)), "links")
        asked = asked.unionByName(rest)
        labels = components(links)
    out = mapped.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Documents without links stay.

    Of rows that repeat an id, one stays; rows without an id stay.
    """
    found = written(classes(docs, width, percent).where("doc_id IS NOT NULL"), "near-copies")
    gone = small_side(written(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies-gone"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return left
    again = small_side(again)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op2_ngram_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), 3, 90)


OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
