"""Operator 5: token ids in Arrow stream files of equal-length sequences.

Documents are ordered by id into shards, each written by one task: a token
file, whose record batches hold fixed-size lists of ids and a mask (bits, false
in the padding at the shard's end), and an index file with each document's
place. Batches of a file are equally long, so sequence i is found by division
and read from a memory map without copying. Shards go to the shared folder
under a temporary name and are renamed when complete, so a task that is run
again replaces its own shard by the same bytes.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelsift.llm.common import cut_at_spaces, joined_words, sliced, table, texts_of
from reelsift.session import file_system, shared_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
PER_BATCH = 64
#: Bytes of the source's files for each shard.
SHARD_BYTES = 128 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
SHARDS = "shard int, n_docs long, n_tokens long"
#: Letters of Latin-1, and marks that are cut off after one.
LETTERS, MARKS = "".join(c for c in map(chr, range(256)) if c.isalpha()), ",.;:!?"
_tokenizers: dict = {}


def _narrow(chunk: str) -> bool:
    """Within Latin-1 case folds by character and nothing is composed."""
    try:
        chunk.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """A tokenizers file, with a table of the distinct chunks between spaces or line ends.

    Where the file's own rules keep pieces within white space, each distinct
    chunk is encoded once and its ids are joined by position; other files
    encode whole texts. Where the rules fold case and cut letters from marks,
    chunks that differ in no more are encoded as one. New chunks go to the
    library many at a time, with a special token between them, at which it cuts
    before all else; its id shows where each chunk's ids end. The table has two
    generations of bounded size. ``dtype`` is the narrowest that holds every id.
    """

    MOST, LONGEST = 600_000, 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.inner.get_vocab_size() <= 2**16 else "<u4")
        spec = json.loads(self.inner.to_str())
        normal = spec["normalizer"] or {}
        steps = [s["type"] for s in normal.get("normalizers", [normal]) if s]
        before = spec["pre_tokenizer"] or {}
        first = (before.get("pretokenizers") or [before])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        # Only runs of letters, single numbers and runs of marks become pieces; white space is dropped.
        self.cuts = first.get("behavior") == "Removed" and first.get("invert") is True and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and set(steps) <= {"NFC", "Replace", "Lowercase"}
        self.folds = self.cuts and "Lowercase" in steps
        added = self.inner.get_added_tokens_decoder().items()
        self.between = next(((i, t.content) for i, t in added if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.special = tuple(t.content for _, t in added)
        # For words that the normalizer leaves as they are and that are one piece: the same model with nothing
        # before it but the bytes' letters, and without its cache, as it gets each word once.
        self.bare = None
        if self.folds and (before.get("pretokenizers") or [{}])[-1].get("type") == "ByteLevel" and hasattr(self.inner.model, "_resize_cache"):
            self.bare = Tokenizer(self.inner.model)
            self.bare.model._resize_cache(0)
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _plain(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Chunks with the same ids but for a mark at the end, and where in ``MARKS`` that mark is (null: none)."""
        # Beyond Latin-1 a letter may be written with marks of its own, which would join the one at the end.
        ends = pc.match_substring_regex(chunks, f"[{LETTERS}][{re.escape(MARKS)}]$")
        mark = pc.if_else(ends, pc.index_in(pc.utf8_slice_codeunits(chunks, -1), pa.array(list(MARKS), pa.large_string())), pa.scalar(None, pa.int32()))
        chunks = pc.if_else(ends, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        if self.folds:
            # Within Latin-1 case folds by character and nothing is composed; special tokens are found before case is folded.
            lower = pc.utf8_lower(chunks)
            fold = pc.match_substring_regex(chunks, r"^[\x{00}-\x{FF}]*$")
            for special in self.special:
                fold = pc.and_(fold, pc.invert(pc.match_substring(lower, special.lower())))
            chunks = pc.if_else(fold, lower, chunks)
        return chunks, mark

    def _encode_many(self, chunks: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        if self.bare is not None:
            easy = [c for c in chunks if c.isalpha() and c.islower() and _narrow(c)]
            kind = self.dtype.char
            for at in range(0, len(easy), 4096):
                some = easy[at : at + 4096]
                out.update((c, array(kind, e.ids).tobytes()) for c, e in zip(some, self.bare.encode_batch_fast(some, add_special_tokens=False), strict=True))
        hard = [c for c in chunks if c not in out]
        out.update((c, self._encode(c)) for c in hard if self.between is None or any(s in c for s in self.special))
        hard = [c for c in hard if c not in out]
        if hard:
            out.update(self._joined(hard))
        return out

    def _joined(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are encoded with a special token between them."""
        out = {}
        cut, between = self.between
        for at in range(0, len(chunks), 1024):
            some = chunks[at : at + 1024]
            ids = np.array(self.inner.encode(between.join(some), add_special_tokens=False).ids, np.uint32)
            ends = [*np.flatnonzero(ids == cut).tolist(), len(ids)]
            if len(ends) != len(some):
                out.update((c, self._encode(c)) for c in some)
                continue
            data, size, start = ids.astype(self.dtype).tobytes(), self.dtype.itemsize, 0
            for chunk, end in zip(some, ends, strict=True):
                out[chunk] = data[start * size : end * size]
                start = end + 1
        return out

    def _values(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks; long ones are used but not kept."""
        if len(self.words) > self.MOST:
            self.words, self.older = {}, self.words
        values = list(map(self.words.get, chunks))
        absent = [i for i, v in enumerate(values) if v is None]
        found = {c: ids for c in (chunks[i] for i in absent) if (ids := self.older.get(c)) is not None} if self.older else {}
        made = self._encode_many([c for c in (chunks[i] for i in absent) if c not in found])
        self.words.update(found)
        self.words.update((c, ids) for c, ids in made.items() if len(c) <= self.LONGEST)
        made.update(found)
        for i in absent:
            values[i] = made[chunks[i]]
        return values

    def encode_column(self, column: pa.Array, end: bytes = b"") -> pa.Array:
        """The ids of texts as bytes, and ``end`` after each."""
        if not self.cuts:
            return pa.array([self._encode(t) + end for t in texts_of(column)], pa.large_binary())
        words, before = cut_at_spaces(column, "\n", runs=False)
        words = words.dictionary_encode()
        plain, mark = self._plain(pc.utf8_slice_codeunits(words.dictionary, 1))
        plain = plain.dictionary_encode()
        ids = pa.array(self._values(plain.dictionary.to_pylist()), pa.large_binary()).take(plain.indices)
        marks = pa.array(self._values(list(MARKS)), pa.large_binary()).take(mark)
        whole = pc.binary_join_element_wise(ids, pc.fill_null(marks, b""), pa.scalar(b"", pa.large_binary()))
        return joined_words(whole, words.indices.to_numpy(), before, end=end)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _names(path: str, shard: int) -> tuple[str, str]:
    return f"{path}/shard-{shard:06d}.arrow", f"{path}/shard-{shard:06d}.index.arrow"


def token_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one shard, holding one batch of sequences at most."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int = LENGTH, per_batch: int = PER_BATCH):
        self.fs, path = file_system(folder)
        self.fs.create_dir(path, recursive=True)
        self.final, own = _names(path, shard), uuid.uuid4().hex
        self.temp = tuple(f"{p}.{own}" for p in self.final)
        self.length, self.batch, self.dtype = length, length * per_batch, dtype
        self.schema = token_schema(dtype, length)
        self.files = [self.fs.open_output_stream(p) for p in self.temp]
        self.tokens = pa.ipc.new_stream(self.files[0], self.schema)
        self.index = pa.ipc.new_stream(self.files[1], INDEX)
        self.held, self.rows, self.n_docs, self.n_tokens = bytearray(), [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        self.held += ids
        step = self.batch * self.dtype.itemsize
        at = 0
        while len(self.held) - at >= step:
            self._put(np.frombuffer(bytes(self.held[at : at + step]), self.dtype))
            at += step
        if at:
            del self.held[:at]
        if len(self.rows) >= 4096:
            self._put_rows()

    def _put(self, flat: np.ndarray) -> None:
        kept = len(flat)
        flat = np.concatenate([flat, np.zeros(-kept % self.length, self.dtype)])
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < kept), self.length)
        self.tokens.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def _put_rows(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=INDEX))
        self.rows = []

    def close(self) -> None:
        if self.held:
            self._put(np.frombuffer(bytes(self.held), self.dtype))
        if self.rows:
            self._put_rows()
        for x in (self.tokens, self.index, *self.files):
            x.close()
        for temp, final in zip(self.temp, self.final, strict=True):
            try:
                self.fs.move(temp, final)
            except OSError:  # stores that don't replace: an earlier try left the same bytes
                self.fs.delete_file(final)
                self.fs.move(temp, final)


class ShardReader:
    """Random access to a shard, one batch at a time: of a local file sequences and masks are views of its map, of others one batch is read."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        files, path = file_system(folder)
        tokens, index = _names(path, shard)
        local = isinstance(files, fs.LocalFileSystem)
        opened = pa.memory_map if local else files.open_input_file
        self.file = opened(tokens)
        self.schema = pa.ipc.read_schema(self.file)
        self.length = self.schema.field("ids").type.list_size
        # All batches but the last take as many bytes as the first, so each is found by its number.
        self.start, size = self.file.tell(), self.file.size()
        self.held: tuple[int, pa.RecordBatch] | None = None
        first = self._read(self.start)
        self.bytes = self.file.tell() - self.start
        self.per = first.num_rows if first is not None else 1
        self.step = self.per * self.length
        self.count = max(size - self.start - 1, 0) // self.bytes + 1 if first is not None else 0
        last = self._batch(self.count - 1) if first is not None else None
        if first is not None and last is None:  # what is left after the last full one is the mark of the end
            self.count -= 1
            last = self._batch(self.count - 1)
        self.rows = (self.count - 1) * self.per + last.num_rows if first is not None else 0
        self._index = lambda: pa.ipc.open_stream(opened(index))

    def documents(self):
        """Batches of (doc_id, start, n_tokens), one at a time."""
        with self._index() as stream:
            yield from stream

    def _read(self, at: int) -> pa.RecordBatch | None:
        self.file.seek(at)
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        except (EOFError, pa.ArrowInvalid):
            return None

    def _batch(self, i: int) -> pa.RecordBatch | None:
        if self.held is None or self.held[0] != i:
            self.held = (i, self._read(self.start + i * self.bytes))
        return self.held[1]

    def _flat(self, i: int) -> np.ndarray:
        return self._batch(i).column(0).values.to_numpy(zero_copy_only=True)

    def __len__(self) -> int:
        return self.rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i; the ids of a mapped file aren't copied."""
        if not 0 <= i < self.rows:
            raise IndexError(i)
        b, at = divmod(i, self.per)
        batch = self._batch(b)
        return self._flat(b)[at * self.length : (at + 1) * self.length], batch.column(1)[at].values

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from the shard's token ``start`` on; a view if one batch holds them."""
        if not n:
            return np.zeros(0, np.uint16)
        b, at = divmod(start, self.step)
        parts = []
        while n > 0:
            parts.append(self._flat(b)[at : at + n])
            n -= len(parts[-1])
            b, at = b + 1, 0
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes documents (doc_id, text) in ascending doc_id and gives one row per shard: shard, n_docs, n_tokens.

    Null texts count as empty and have just the end id; null ids come first;
    rows of equal ids are ordered by a hash of their texts, then by these, so a
    hot id is spread over shards. Other columns are ignored, and very long texts
    are one document of many sequences. An empty table writes empty shards.
    shards: how many; else as many as shuffles have partitions, or more, so that
    none holds much more than ``SHARD_BYTES`` of the source's files.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select("doc_id", "text")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(size, 1 << 50) // SHARD_BYTES) if size < 1 << 60 else 0)
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.asc_nulls_first("text"))

    def run(batches):
        made = tokenizer(path)
        end = np.array([end_id], made.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        out = ShardWriter(folder, shard, made.dtype)
        for batch in batches:
            for part in sliced(batch, 1024):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), made.encode_column(part.column("text"), end).to_pylist(), strict=True):
                    out.add(doc_id, ids)
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": out.n_docs, "n_tokens": out.n_tokens}], pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return ordered.mapInArrow(run, SHARDS)


def read(spark, folder: str, shards: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of ``shards`` (rows of ``write``).

    The list has a row for each file, not for each document. ``start`` counts
    the ids of all documents before, in this shard and those before it.
    """
    base, rows = 0, []
    for s in sorted(shards, key=lambda s: s["shard"]):
        if s["n_docs"]:
            rows.append((s["shard"], base))
        base += s["n_tokens"]
    listed = spark.createDataFrame(rows, "shard int, base long")
    listed = listed.repartitionByRange(len(rows), "shard") if rows else listed

    def run(batches):
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = ShardReader(folder, shard)
                for part in reader.documents():
                    starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crcs = [zlib.crc32(reader.tokens(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts + base), part.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir):
    folder = f"{shared_dir(spark)}/reelsift-tokens-{uuid.uuid4().hex}"
    return read(spark, folder, write(table(spark, sf_dir, "documents"), folder).collect())
