"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.session import file_system as files_of
from reelsift.session import replace_file, shared_dir

libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a side of (id, small values) is broadcast; 64-bit ids take about 16 MB then.
BROADCAST_ROWS = 1_000_000


#: Bytes of an Arrow batch between Spark and Python, where the session has Spark's own limit of 64 MB.
BATCH_BYTES = 2 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's own limit: several texts and what is made of them are held at once."""
    if spark.conf.get(BATCH_KEY).rstrip("bB") == str(64 << 20):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a finished task held back to the system; workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc is not None:
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends here.

    The files are in ``spark.checkpoint.dir``, so they outlive the executor
    that wrote them; the folder's owner removes them, as with ``checkpoint()``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/reelsift-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Files of a sharded table, and rows of one of its blocks.
SHARDS = 16
SHARD_ROWS = 1 << 16


def hash_of(key: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def sharded(df: DataFrame, label: str, shards: int = SHARDS, make: Callable[[], Callable[[list[str]], list[bytes]]] | None = None) -> str:
    """Writes (key string, further columns), keys once each, for ``Shards``; returns the folder.

    Rows are dealt out by the key's hash and sorted by Spark; a task writes its
    shard block by block, under a temporary name until it is complete, and the
    last hash of each block to a file beside it. make: gives a function from
    distinct keys to their values; keys may repeat then, and have no columns.
    """
    spark = df.sparkSession
    bound_batches(spark)
    folder = f"{shared_dir(spark)}/reelsift-{label}-{uuid.uuid4().hex}"
    names = [n for n in df.columns if n != "key"]
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    # Hashes don't compress, so they are made again after the shuffle.
    rows = df.where("key IS NOT NULL").repartition(shards, shard).select(F.xxhash64("key").alias("hash"), "key", *names, shard.alias("shard"))
    rows = rows.sortWithinPartitions("shard", "hash", "key")

    def run(batches):
        files, root = files_of(folder)
        files.create_dir(root, recursive=True)
        made = make() if make else None
        stream, sink, at, temporary, lasts, before = None, None, None, None, [], None

        def close():
            if sink is not None:
                sink.close()
                stream.close()
                replace_file(files, temporary, f"{root}/{at}.arrow")
                with files.open_output_stream(f"{temporary}.last") as out:
                    out.write(np.array(lasts, np.int64).tobytes())
                replace_file(files, f"{temporary}.last", f"{root}/{at}.last")

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            if made:
                keys = whole["key"].to_pylist()
                whole = whole.filter(pa.array([k != p for p, k in zip([before, *keys], keys)], pa.bool_()))
                before = keys[-1] if keys else before
            of = whole["shard"].to_numpy()
            for shard in np.unique(of).tolist():
                first, last = np.searchsorted(of, [shard, shard + 1])
                part = whole.slice(first, last - first).drop_columns("shard")
                if made:
                    part = part.append_column("value", pa.array(made(part["key"].to_pylist()), pa.binary()))
                if shard != at:
                    close()
                    at, lasts = shard, []
                    temporary = f"{root}/{shard}.{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temporary)
                    sink = pa.ipc.new_file(stream, part.schema)
                for block in part.combine_chunks().to_batches(max_chunksize=SHARD_ROWS):
                    sink.write_batch(block)
                    lasts.append(block.column(0)[-1].as_py())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["shard"])
        release()

    rows.mapInArrow(run, "shard int").count()
    return folder


class Shards:
    """Look-ups in a table that ``sharded`` wrote.

    Local files are mapped; of others a bounded number of blocks is held. So
    memory doesn't grow with the table.
    """

    #: Bits of the map that tells most absent keys at once, and blocks that are held of files that can't be mapped.
    MAP_BITS, HELD = 1 << 23, 64

    def __init__(self, folder: str, shards: int = SHARDS):
        self.folder, self.shards, self.open, self.blocks, self.map = folder, shards, {}, {}, None

    def _shard(self, shard: int):
        """The last hash of each block, and the file; no blocks if the shard has no rows."""
        if shard not in self.open:
            files, root = files_of(self.folder)
            path, lasts, file = f"{root}/{shard}.arrow", np.zeros(0, np.int64), None
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(f"{root}/{shard}.last") as f:
                    lasts = np.frombuffer(f.read(), np.int64)
                file = pa.ipc.open_file(pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path))
            self.open[shard] = (lasts, file, isinstance(files, fs.LocalFileSystem))
        return self.open[shard]

    def _block(self, shard: int, i: int):
        if (shard, i) not in self.blocks:
            _, file, mapped = self._shard(shard)
            if not mapped and len(self.blocks) >= self.HELD:
                self.blocks.clear()
            b = file.get_batch(i)
            self.blocks[shard, i] = (b.column(0).to_numpy(), b.column(1), b.columns[2:])
        return self.blocks[shard, i]

    def get(self, key: str) -> tuple | None:
        """The values of a key."""
        h = hash_of(key)
        shard = h % self.shards
        lasts = self._shard(shard)[0]
        for i in range(int(lasts.searchsorted(h)), min(int(lasts.searchsorted(h, "right")) + 1, len(lasts))):
            hashes, keys, values = self._block(shard, i)
            at = int(hashes.searchsorted(h))
            while at < len(hashes) and hashes[at] == h:  # different keys may have one hash
                if keys[at].as_py() == key:
                    return tuple(v[at].as_py() for v in values)
                at += 1
        return None

    def held(self, limit: int) -> dict[str, tuple] | None:
        """The whole table, if it has no more than ``limit`` keys."""
        files = [self._shard(i)[1] for i in range(self.shards)]
        if sum(f.get_batch(i).num_rows for f in files if f for i in range(f.num_record_batches)) > limit:
            return None
        rows = (f.get_batch(i) for f in files if f for i in range(f.num_record_batches))
        return {k: v for b in rows for k, *v in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)}

    def _possible(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the table may have keys of these hashes."""
        if self.map is None:
            self.map = np.zeros(self.MAP_BITS, bool)
            for shard in range(self.shards):
                for i in range(len(self._shard(shard)[0])):
                    self.map[self._block(shard, i)[0] & (self.MAP_BITS - 1)] = True
        return self.map[hashes & (self.MAP_BITS - 1)]

    def get_many(self, keys, mostly_absent: bool = True) -> dict[str, tuple]:
        """The values of those keys that the table has; ``mostly_absent``: a map of all hashes sorts out most others."""
        keys = list(keys)
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(k.encode("utf-8", "surrogatepass"), 42) for k in keys), np.uint64, len(keys)).view(np.int64)
        at = np.flatnonzero(self._possible(h)) if mostly_absent else np.arange(len(h))
        of = h[at] % self.shards
        order = np.lexsort((h[at], of))
        at, of = at[order], of[order]
        out: dict[str, tuple] = {}
        for shard in np.unique(of).tolist():
            some = at[slice(*np.searchsorted(of, [shard, shard + 1]))]
            lasts = self._shard(shard)[0]
            blocks = lasts.searchsorted(h[some])
            for i in np.unique(blocks).tolist():
                if i == len(lasts):
                    continue
                places = some[slice(*np.searchsorted(blocks, [i, i + 1]))]
                hashes, names, values = self._block(shard, i)
                found = np.minimum(hashes.searchsorted(h[places]), len(hashes) - 1)
                hit = hashes[found] == h[places]
                take = pa.array(found[hit])
                columns = [c.take(take).to_pylist() for c in (names, *values)]
                wanted = [keys[p] for p in places[hit].tolist()]
                if columns[0] == wanted:
                    out.update(zip(wanted, zip(*columns[1:], strict=True), strict=True))
                    continue
                for place, name, *row in zip(places[hit].tolist(), *columns, strict=True):
                    if name == keys[place]:
                        out[name] = tuple(row)
                    elif (row := self.get(keys[place])) is not None:  # another key of that hash
                        out[keys[place]] = row
        return out

    def values_of(self, keys: pa.Array) -> pa.Array:
        """The value of each of the different ``keys``, in their order, null for those that the table lacks; its keys have one binary value."""
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(k, 42) for k in keys.cast(pa.large_binary()).to_pylist()), np.uint64, len(keys)).view(np.int64)
        of = h % self.shards
        order = np.lexsort((h, of))
        h, of, keys = h[order], of[order], keys.take(pa.array(order))
        parts = []
        for shard in np.unique(of).tolist():
            start, end = np.searchsorted(of, [shard, shard + 1]).tolist()
            lasts = self._shard(shard)[0]
            blocks = lasts.searchsorted(h[start:end])
            for i in np.unique(blocks).tolist():
                first, last = (start + np.searchsorted(blocks, [i, i + 1])).tolist()
                if i == len(lasts):
                    parts.append(pa.nulls(last - first, pa.binary()))
                    continue
                hashes, names, values = self._block(shard, i)
                take = pa.array(np.minimum(hashes.searchsorted(h[first:last]), len(hashes) - 1))
                part, wanted = values[0].take(take), keys.slice(first, last - first)
                same = pc.equal(names.take(take).cast(wanted.type), wanted)
                if same.false_count:  # absent, or another key of that hash
                    rows = zip(same.to_pylist(), part.to_pylist(), wanted.to_pylist(), strict=True)
                    part = pa.array([v if hit else (self.get(k) or (None,))[0] for hit, v, k in rows], pa.binary())
                parts.append(part)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays([p.cast(pa.large_binary()) for p in parts] or [pa.array([], pa.large_binary())]).take(pa.array(back))


def cut_at_spaces(column: pa.Array, space: str, runs: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, each with the space before it, and how many words are before each text and at the end.

    A space is put before every text; the character ``space`` counts as one
    too. ``runs``: spaces in a row stay with the word after them, or are a word
    at the end, and empty texts have no words; else every space begins one.
    """
    texts = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), space, " ")
    front = pa.scalar(" ", pa.large_string())
    if runs:
        front = pc.if_else(pc.equal(texts, ""), pa.scalar("", pa.large_string()), front)
    texts = pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string()))
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    blank = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] == 32
    starts = blank
    if runs:
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(starts)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, offsets[-1]).astype(np.int64)), texts.buffers()[2])
    return words, np.searchsorted(at, offsets)


def joined_words(values: pa.Array, word: np.ndarray, before: np.ndarray, begin: bytes = b"", end: bytes = b"") -> pa.Array:
    """The ``values`` of each text's words in a row, between ``begin`` and ``end``; before: as ``cut_at_spaces`` gives it."""
    n = len(before) - 1
    shift = 2 * np.arange(n)
    of = np.repeat(np.arange(n), np.diff(before))
    places = np.empty(len(word) + 2 * n, np.int64)
    places[np.arange(len(word)) + 2 * of + 1] = word
    places[before[:-1] + shift] = len(values)
    places[before[1:] + shift + 1] = len(values) + 1
    row = pa.concat_arrays([values, pa.array([begin, end], pa.large_binary())]).take(pa.array(places))
    offsets = np.frombuffer(row.buffers()[1], np.int64)[row.offset : row.offset + len(row) + 1]
    ends = offsets[np.append(before[:-1] + shift, len(places))] if n else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), row.buffers()[2]])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else as it is.

    ``df`` should be cheap to count, a written table for instance. Beyond the
    limit the join that follows shuffles, and gives the same rows.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sliced(batch, rows: int):
    """Slices of an Arrow batch, so what is made of it at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts_of(column) -> list[str]:
    """Strings of an Arrow column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


class ChunkTable(dict):
    """Distinct chunks of text and what ``make`` gives for each, made once.

    The table starts anew when it has ``most`` entries, and long chunks aren't
    kept, so its memory is bounded; neither changes a result.
    """

    def __init__(self, make: Callable[[str], object], most: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value
