"""Operator 3: exact top-k search by aggregation without random access.

Rows are dealt into blocks of candidates, and queries into blocks of their own;
both are written once, so a task loads one block of candidates and streams
queries past it, and nothing is shuffled once for every pair of blocks. A block
keeps one list of its vectors for each component, in the order of that
component. For a query the lists are read from the end that contributes most,
depth by depth. What has been read of a vector gives its partial score; the
rest is bounded by the lists' current contributions and by the norms of what is
unread in query and vector (Cauchy-Schwarz), from above and from below. Reading
stops when no vector outside a small set can reach the k-th best lower bound;
the final scores of that set are then resolved in whole numbers.

Reading lists to their ends is one product of matrices. Where a block's queries
all come to that, as with components that are alike and independent, those that
follow read that way at once, and one in ``PROBE`` tries to stop earlier.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelsift.llm.common import files_of, release, table, written
from reelsift.session import replace_file, shared_dir

K = 5
EVERY = 50
SCALE = 256
#: Vectors of a block of candidates, and queries that go past it together.
CANDIDATES = 32768
QUERIES = 1024
#: Shares of the lists read at each depth before all of them, and queries of which one tries these where they don't help.
DEPTHS = (1 / 64, 1 / 16, 1 / 4)
PROBE = 64
HITS = "query_row long, query_id long, vec_row long, vec_id long, score long"


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


class SortedLists:
    """A block's vectors with one sorted list for each component. ``read`` counts entries of lists, ``whole`` those there are for the queries."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.values = vectors.astype(np.float64)
        self.norms = (self.values**2).sum(axis=1)
        self.order = None
        self.read = self.whole = self.asked = 0

    def _sort(self) -> None:
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32).copy()
        self.lists = np.take_along_axis(self.values.T, self.order, axis=1)

    def _stopped(self, query: np.ndarray, own: int, k: int) -> np.ndarray | None:
        """Places that can be among the k best, if reading could stop before the lists' ends."""
        n, width = self.vectors.shape
        if self.order is None:
            self._sort()
        q = query.astype(np.float64)
        known, seen_v, seen_q = np.zeros(n), np.zeros(n), np.zeros(n)
        at = 0
        for share in DEPTHS:
            to = int(n * share)
            if to <= at:
                continue
            edge = np.zeros(width)
            for j in np.flatnonzero(q).tolist():
                part = slice(n - to, n - at) if q[j] > 0 else slice(at, to)
                places, values = self.order[j, part], self.lists[j, part]
                known[places] += q[j] * values
                seen_v[places] += values * values
                seen_q[places] += q[j] * q[j]
                edge[j] = q[j] * self.lists[j, n - to if q[j] > 0 else to - 1]
                self.read += to - at
            at = to
            rest = np.sqrt(np.maximum((q @ q) - seen_q, 0) * np.maximum(self.norms - seen_v, 0))
            # A component that isn't read yet contributes no more than its list's edge.
            lower, upper = known - rest, known + np.minimum(rest, np.maximum(edge, 0).sum())
            lower[self.rows == own] = -np.inf
            slack = 1 + 1e-9 * np.sqrt((q @ q) * self.norms.max())
            open_ = np.flatnonzero(upper >= np.partition(lower, n - k)[n - k] - slack) if n > k else np.arange(n)
            if len(open_) <= max(4 * k, n // 64):
                return open_
        return None

    def top(self, queries: np.ndarray, own: np.ndarray, k: int = K) -> list[np.ndarray]:
        """For each query the places of its k best vectors but its own row, ties to smaller ids, then rows."""
        out: list = [None] * len(queries)
        n, width = self.vectors.shape
        helps, left = True, []
        for i in range(len(queries)):
            self.asked += 1
            self.whole += n * width
            found = self._stopped(queries[i], own[i], k) if helps or self.asked % PROBE == 1 else None
            helps = found is not None
            if helps:
                out[i] = self._resolved(found, queries[i], own[i], k)
            else:
                left.append(i)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            q = queries[some].astype(np.float64)
            scores = self.values @ q.T
            self.read += n * width * len(some)
            scores[self.rows[:, None] == own[some]] = -np.inf
            slack = 1 + 1e-9 * np.sqrt((q * q).sum(axis=1) * self.norms.max(initial=0.0))
            kth = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(len(some), -np.inf)
            for j, i in enumerate(some):
                out[i] = self._resolved(np.flatnonzero(scores[:, j] >= kth[j] - slack[j]), queries[i], own[i], k)
        return out

    def scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[places] @ query

    def _resolved(self, places: np.ndarray, query: np.ndarray, own: int, k: int) -> np.ndarray:
        places = places[self.rows[places] != own]
        return places[np.lexsort((self.rows[places], self.ids[places], -self.scores(places, query)))[:k]]


def _stored(rows: DataFrame, blocks: int, label: str) -> str:
    """Writes (row, vec_id, v) in ``blocks`` Arrow files by a hash of the row; gives the folder."""
    folder = f"{shared_dir(rows.sparkSession)}/reelsift-{label}-{uuid.uuid4().hex}"
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "row", "vec_id", "v").repartition(blocks, "block").sortWithinPartitions("block", "row")

    def run(batches):
        files, root = files_of(folder)
        files.create_dir(root, recursive=True)
        at, temp, stream, sink = None, None, None, None

        def close():
            if sink is not None:
                sink.close()
                stream.close()
                replace_file(files, temp, f"{root}/{at}.arrow")

        for batch in batches:
            of = batch.column(0).to_numpy()
            for block in np.unique(of).tolist():
                if block != at:
                    close()
                    at, temp = block, f"{root}/{block}.arrow.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temp)
                    sink = pa.ipc.new_file(stream, batch.select(["row", "vec_id", "v"]).schema)
                first, last = np.searchsorted(of, [block, block + 1])
                sink.write_batch(batch.slice(first, last - first).select(["row", "vec_id", "v"]))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["block"])

    dealt.mapInArrow(run, "block int").count()
    return folder


def _loaded(folder: str, block: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and vectors of a block; shorter vectors are filled up with zeros."""
    files, root = files_of(folder)
    path = f"{root}/{block}.arrow"
    if not files.get_file_info(path).size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    with files.open_input_file(path) as file:
        t = pa.ipc.open_file(file).read_all()
    column = t["v"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return t["row"].to_numpy(), t["vec_id"].to_numpy(), out


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k best rows but itself.

    vectors: vec_id, embedding. Rows whose id or vector is null, or whose vector
    holds a null or non-finite component, take no part. Rows that repeat an id
    are rows of their own, as queries and as candidates; ties go to smaller ids.
    Shorter vectors count as if filled up with zeros. Scores are exact; an
    ``OverflowError`` if components are so large that a score could pass 2^62.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    ints = written(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole(F.col("embedding")).alias("v")), "topk-vectors")
    largest = F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double")))
    n, asked, width, most = ints.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v")), largest).first()
    if (most or 0.0) ** 2 * (width or 0) >= 2.0**62:
        raise OverflowError("components are too large for exact scores of 64 bits")
    blocks, query_blocks = -(-n // CANDIDATES) or 1, -(-asked // QUERIES) or 1
    candidates = _stored(ints, blocks, "topk-candidates")
    queries = _stored(ints.where(F.col("vec_id") % every == 0), query_blocks, "topk-queries")
    # A task has one block of candidates and a share of the query blocks: as many tasks as there are cores, or one for each block.
    shares = min(query_blocks, max(1, -(-spark.sparkContext.defaultParallelism // blocks)))
    work = spark.range(blocks * shares).repartition(blocks * shares, "id")

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                at, share = divmod(task, shares)
                block = SortedLists(*_loaded(candidates, at, width or 0))
                for part in range(share, query_blocks, shares):
                    rows, ids, asked = _loaded(queries, part, width or 0)
                    out: list[list] = [[], [], [], [], []]
                    for row, qid, q, places in zip(rows.tolist(), ids.tolist(), asked, block.top(asked, rows, k), strict=True):
                        found = (np.full(len(places), row), np.full(len(places), qid), block.rows[places], block.ids[places], block.scores(places, q))
                        for held, values in zip(out, found, strict=True):
                            held.append(values)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["query_row", "query_id", "vec_row", "vec_id", "score"])
                del block
        release()

    hits = work.mapInArrow(run, HITS)
    w = W.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("vec_row"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH i AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS m, CAST(list_sum(list_transform(range(1, 65), lambda j: q.v[j] * c.v[j])) AS BIGINT) AS score
  FROM i q JOIN i c ON q.n <> c.n WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
