"""Operator 4: SentencePiece encoding and decoding through a table of distinct chunks.

In models whose pieces never hold a white space mark after another character,
no merge crosses from a word to the mark that follows it. The normalized text
then splits into marked words (marks, then other characters), each of which is
segmented on its own; the ids of the text are those of its words by position.
So the distinct marked words of all documents, each task's once, are dealt out
by hash; each is segmented once, by the task that writes it to its place in a
table of sorted shards. The tasks that encode look their distinct words up in
the table and join the ids back by position. A row for each word of the corpus,
several times the corpus itself, never moves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import Shards, cut_at_spaces, joined_words, release, sharded, sliced, table, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Texts whose words are gathered, and whose words are looked up, at once.
SLICE, ENCODED = 256, 1024
#: Files of the table of distinct words.
SHARDS = 64
_models: dict = {}


class PieceEncoder:
    """A model's encode and decode; marked words that a table of distinct ones lacks are segmented where they stand."""

    #: Words that a task gathers, and characters of a word that is in the table; longer ones are segmented where they stand.
    MOST, LONGEST = 400_000, 256

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # The normalizer must change nothing but spaces, else words may not be cut before it ran.
        probe = "a  b ﬁ\tÅ é "
        alone = self.model.piece_to_id(MARK)
        self.splits = not crossing and alone != self.model.unk_id() and self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.alone = np.array([alone], "<u4").tobytes()

    def segmented(self, marked: list[str]) -> list[bytes]:
        """The ids of marked words. The model puts a mark before what it gets; a word has it already. An empty text would have none."""
        return [np.array(ids, "<u4").tobytes() if word != " " else self.alone for word, ids in zip(marked, self.model.encode([w[1:] for w in marked], num_threads=1), strict=True)]

    def encode_column(self, column: pa.Array, known: Shards | None = None) -> pa.Array:
        """Ids with begin and end as little-endian unsigned 32-bit integers; ``known``: the table of distinct words."""
        if not self.splits:
            bodies = self.model.encode(texts_of(column), num_threads=1)
            return pa.array([self.begin + np.array(ids, "<u4").tobytes() + self.end for ids in bodies], pa.large_binary())
        words, before = cut_at_spaces(column, MARK, runs=True)
        words = words.dictionary_encode()
        distinct, at = words.dictionary, words.indices.to_numpy()
        values = pa.nulls(len(distinct), pa.large_binary())
        if known is not None:
            short = np.flatnonzero(self.short(distinct))
            values = pa.concat_arrays([known.values_of(distinct.take(pa.array(short))), pa.nulls(1, pa.large_binary())])
            where = np.full(len(distinct), len(short))
            where[short] = np.arange(len(short))
            values = values.take(pa.array(where))
        if values.null_count:
            new = values.is_null()
            values = pc.replace_with_mask(values, new, pa.array(self.segmented(distinct.filter(new).to_pylist()), pa.large_binary()))
        return joined_words(values, at, before, self.begin, self.end)

    def short(self, words: pa.Array) -> np.ndarray:
        """Whether words may be in the table."""
        return pc.less_equal(pc.utf8_length(words), self.LONGEST).to_numpy(zero_copy_only=False)

    def encode_many(self, texts: list[str], known: Shards | None = None) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()), known).to_pylist()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a model file."""
    if path not in _models:
        _models[path] = PieceEncoder(path)
    return _models[path]


def chunk_table(df: DataFrame, text_col: str, path: str) -> str | None:
    """Segments every distinct marked word of a column once; gives the table's folder, or None for models whose pieces cross words."""
    if not encoder(path).splits:
        return None

    def run(batches):
        made, held, n = encoder(path), [], 0

        def flush():
            words = held.pop()
            held.clear()
            for at in range(0, len(words), 1 << 15):
                yield pa.RecordBatch.from_arrays([words.slice(at, 1 << 15).cast(pa.string())], ["key"])

        for batch in batches:
            for part in sliced(batch, SLICE):
                words = cut_at_spaces(part.column(0), MARK, runs=True)[0].unique()
                held.append(words.filter(pa.array(made.short(words))))
                n += len(held[-1])
                if n > 2 * made.MOST:
                    held[:] = [pa.chunked_array(held).unique()]
                    n = len(held[0])
                    if n > made.MOST:
                        yield from flush()
                        n = 0
        if held:
            held[:] = [pa.chunked_array(held).unique()]
            yield from flush()
        release()

    return sharded(df.select(text_col).mapInArrow(run, "key string"), "pieces", SHARDS, lambda: encoder(path).segmented)


def _added(df: DataFrame, text_col: str | None, ids_col: str, decoded_col: str | None, model: str | None) -> DataFrame:
    """One pass that encodes ``text_col`` (dropped) or reads ``ids_col``, and decodes if asked: one worker for each task."""
    path = model or public_tokenizers.path(MODEL)
    rest = [c for c in df.columns if c != text_col]
    added = ([ids_col] if text_col else []) + ([decoded_col] if decoded_col else [])
    if clash := set(added) & set(rest):
        raise ValueError(f"{sorted(clash)} are columns already: name others")
    folder = chunk_table(df, text_col, path) if text_col else None

    def run(batches):
        made, known = encoder(path), Shards(folder, SHARDS) if folder else None
        for batch in batches:
            for part in sliced(batch, ENCODED):
                ids = made.encode_column(part.column(text_col), known) if text_col else part.column(ids_col)
                columns = [part.column(c) for c in rest] + ([ids.cast(pa.binary())] if text_col else [])
                if decoded_col:
                    columns.append(pa.array([made.decode(i or b"") for i in ids.to_pylist()], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*rest, *added])
        # Workers serve other stages afterwards; the model stays.
        release()

    kinds = {ids_col: T.BinaryType(), decoded_col: T.StringType()}
    return df.mapInArrow(run, T.StructType([df.schema[c] for c in rest] + [T.StructField(c, kinds[c]) for c in added]))


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """Replaces ``text_col`` by ``ids_col``: little-endian unsigned 32-bit ids, begin and end included.

    ``decoded_col`` adds the decoding of those ids in the same pass. Null and
    empty texts have just the begin and end ids; very long texts and words are
    encoded whole. Rows are independent, so repeated rows and other columns stay
    as they are; a ``ValueError`` if one has a name that is to be added. An
    empty table stays empty. The table of distinct words is written at once.
    """
    return _added(df, text_col, ids_col, decoded_col, model)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """Adds ``text_col``, the library's decoding of ``ids_col``; null ids give an empty text."""
    return _added(df, None, ids_col, text_col, model)


def op4_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document."""
    both = encode(docs.select("doc_id", "text"), decoded_col="decoded")
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
