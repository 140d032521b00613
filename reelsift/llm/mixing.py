"""Operator 9: mixing sources to target weights, with DataFrame functions only.

Efraimidis-Spirakis sampling without replacement: document i gets the key
-ln(u_i) / w_i, u_i a uniform number that is a hash of its id, w_i its quality
weight. In the order of ascending keys within a source, prefix sums of sizes
are held against the source's budget of words. Budgets above the source's size
take complete epochs first; the rest is the fractional selection.

No source is sorted in one task: keys fall into ``BUCKETS`` ranges, only sums of
(source, range) are put in order, and rows are sorted only within the one range
in which a source's budget ends. Weights make ranges uneven, so a range of more
than ``SORTED`` rows is cut again, between its least and its greatest key, as
often as that takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelsift.llm.common import WORD, small_side, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
BUCKETS = 4096
#: Rows of one source that a task sorts.
SORTED = 1 << 16
#: Characters that count against a document's quality weight.
JUNK = "#$%&*|!0123456789_=<>{}[]~^\\"


def quality_weight(text: Column) -> Column:
    """Share of characters outside ``JUNK``, 0.05 at least; 1 for empty texts."""
    n = F.length(text)
    clean = F.length(F.translate(text, JUNK, ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), clean.cast("double") / n.cast("double"))).otherwise(F.lit(1.0))


def annotate(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``_source``, ``_size`` and ``_key`` to documents (doc_id, text, source, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|" + seed)))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return docs.withColumns(
        {
            "_source": F.col("source"),
            "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "_key": -F.log(uniform) / quality_weight(text),
        }
    )


def bucket(key: Column) -> Column:
    """The range of a key; it grows with the key."""
    return F.least(F.floor((1 - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_source, source_size) with ``target``: ``share`` of all sizes by weight.

    No target passes ``cap`` times its source's size; the excess goes to the
    others by weight until none is above. That has a closed form: in the order
    of cap/weight, sources are full up to some place, and those after it share
    what is left in proportion. Rows here are sources, not documents.
    """
    by_name = W.orderBy(F.asc_nulls_last("_source"))
    listed = sizes.withColumn("_at", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    )
    full = (F.col("source_size") * cap).cast("long")
    order = W.orderBy((full / F.col("_w")).asc(), F.col("_at").asc())
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    filled = (
        listed.withColumn("_full", full)
        .withColumn("_rest", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_full").over(before), F.lit(0)))
        .withColumn("_ws", F.sum("_w").over(after))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_open", F.col("_full") > F.col("_w") * F.col("_rest") / F.col("_ws"))
    )
    first = filled.withColumn("_first", F.min(F.when(F.col("_open"), F.col("_place"))).over(every))
    level = first.withColumn("_r", F.max(F.when(F.col("_place") == F.col("_first"), F.col("_rest"))).over(every)).withColumn(
        "_v", F.max(F.when(F.col("_place") == F.col("_first"), F.col("_ws"))).over(every)
    )
    shared = F.col("_w") * F.col("_r") / F.col("_v")
    target = F.when(F.col("_place") >= F.col("_first"), shared).otherwise(F.col("_full").cast("double"))
    return level.select("_source", "source_size", target.alias("target"))


def _ending(sums: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each source's ranges the one in which its budget ends: ``_lo`` and ``_hi``, its keys' ends, the words before it, and its rows.

    sums: _source, _bucket, _sum, _n, _lo, _hi and ``_before``, the words before all of them.
    """
    w = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = sums.withColumn("_offset", F.col("_before") + F.coalesce(F.sum("_sum").over(w), F.lit(0)))
    at = placed.alias("p").join(sources.alias("s"), F.col("p._source").eqNullSafe(F.col("s._source")))
    ends = (F.col("p._offset") < F.col("s._left")) & (F.col("s._left") <= F.col("p._offset") + F.col("p._sum"))
    return at.where(ends).select(*(F.col(f"p.{c}").alias(c) for c in ("_source", "_lo", "_hi", "_offset", "_n")))


def _sums(rows: DataFrame, before: Column, cut: Column) -> DataFrame:
    sums = rows.groupBy("_source", before.alias("_before"), cut.alias("_bucket"))
    return written(sums.agg(F.sum("_size").alias("_sum"), F.count("*").alias("_n"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi")), "mix-sums")


def plan(narrow: DataFrame) -> DataFrame:
    """One row for each source: target, epochs, words left for the fraction, and the range of keys where they end."""
    sums = _sums(narrow, F.lit(0).cast("long"), bucket(F.col("_key")))
    sources = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("source_size")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(budget / F.col("source_size")), F.lit(CAP))).otherwise(0).cast("long")
    sources = sources.withColumn("_epochs", epochs).withColumn(
        "_left", F.when(F.col("source_size") > 0, F.least(budget - F.col("_epochs") * F.col("source_size"), F.col("source_size"))).otherwise(0).cast("long")
    )
    sources = written(sources, "mix-sources")
    end = written(_ending(sums, sources), "mix-ends")
    while True:
        large = (F.col("_n") > SORTED) & (F.col("_lo") < F.col("_hi"))
        if end.where(large).isEmpty():
            break
        cuts = small_side(end.where(large).select(F.col("_source").alias("_of"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_offset"))
        within = narrow.join(cuts, F.col("_source").eqNullSafe(F.col("_of")) & F.col("_key").between(F.col("_from"), F.col("_to")))
        place = F.floor((F.col("_key") - F.col("_from")) / (F.col("_to") - F.col("_from")) * BUCKETS)
        finer = _ending(_sums(within, F.col("_offset"), F.least(place, F.lit(BUCKETS - 1)).cast("int")), sources)
        end = written(end.where(~large).unionByName(finer), "mix-ends")
    end = end.withColumnRenamed("_source", "_end_source")
    joined = sources.join(end, F.col("_source").eqNullSafe(F.col("_end_source")), "left")
    nowhere = F.lit(float("-inf"))
    return joined.select(
        F.col("_source").alias("_plan_source"), "source_size", "target", "_epochs", "_left",
        F.coalesce("_lo", nowhere).alias("_lo"), F.coalesce("_hi", nowhere).alias("_hi"), F.coalesce("_offset", F.lit(0)).alias("_offset"),
    )


def apply(annotated: DataFrame, planned: DataFrame, whole: bool = False) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``taken`` to annotated rows.

    ``whole``: the document in which the budget ends is taken or left as a
    whole, whichever is nearer; otherwise the mix takes just the words left.
    """
    sources = small_side(written(planned, "mix-plan"))
    rows = annotated.join(sources, F.col("_source").eqNullSafe(F.col("_plan_source")))
    ends = F.col("_key").between(F.col("_lo"), F.col("_hi"))
    inner, ending = rows.where(~ends), rows.where(ends)
    w = W.partitionBy("_source").orderBy("_key", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("_size").over(w), F.lit(0))
    if whole:
        part = F.when(2 * F.col("_before") + F.col("_size") <= 2 * F.col("_left"), F.col("_size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - F.col("_before")))
    ending = ending.withColumn("_before", before).withColumn("_part", part.cast("long")).drop("_before")
    inner = inner.withColumn("_part", F.when(F.col("_key") < F.col("_lo"), F.col("_size")).otherwise(0).cast("long"))
    taken = (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long")
    return inner.unionByName(ending).withColumn("taken", taken).drop("_plan_source", "_epochs", "_left", "_lo", "_hi", "_offset", "_part")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of documents.

    Null texts and texts without words have size 0 and nothing is taken of
    them. A null source is a source, the last one. Rows that repeat an id are
    rows of their own with equal keys. An empty table gives an empty result.
    Other columns are ignored. Reruns give the same rows.
    """
    narrow = written(annotate(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_size", "_key"), "mix-rows")
    out = apply(narrow, plan(narrow))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken.

    Only narrow columns are written and sorted; texts move just within the
    range of keys in which a budget ends.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")  # other columns may have any names
    wide = annotate(docs.select(row, "doc_id", "text", "source"), seed)
    narrow = written(wide.select("doc_id", "_source", "_size", "_key"), "mix-rows")
    out = apply(wide, plan(narrow), whole=True)
    copies = F.when(F.col("_size") > 0, (F.col("taken") / F.col("_size")).cast("int")).otherwise(0)
    taken = out.select("_row", copies.alias("_copies")).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op9_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / (CASE WHEN length(t) > 0 THEN greatest(0.05, CAST(length(translate(t, '#$%&*|!0123456789_=<>{}[]~^\', '')) AS DOUBLE) / CAST(length(t) AS DOUBLE)) ELSE 1.0 END) AS key
  FROM d
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(n - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM src
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, n) AS place,
         (SELECT sum(source_size) FROM w) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w
), f AS (
  SELECT *, (SELECT min(place) FROM o WHERE cap > w * rest / ws) AS first FROM o
), t AS (
  SELECT source, source_size,
         CASE WHEN place >= first THEN w * CAST((SELECT rest FROM f WHERE place = first) AS DOUBLE) / CAST((SELECT ws FROM f WHERE place = first) AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target
  FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target + 0.5) AS BIGINT) // source_size, 2) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, CAST(floor(b.target + 0.5) AS BIGINT) - b.epochs * b.source_size AS left_over,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, left_over - before)) AS BIGINT) AS taken FROM p
"""
