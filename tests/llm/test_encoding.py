"""SentencePiece (operator 4) and token files (operator 5) against their libraries on whole texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelsift.llm import sentencepieces as S
from reelsift.llm import token_files as K
from reelsift.llm.common import hash_of

TEXTS = [
    None, "", " ", "  ", "a", " a  b ", "▁x ▁", "a\tb\nc", "\x00 <s> </s> <0x41>", "ﬁ Å é é", "x" * 5000, "word " * 3000, "the the the", "İI ΣΑΣ ΟΔΟΣ",
    "x<|endoftext|>, y's <|startoftext|>b ", "don't, it's! THE.", "a ́b", "ends.", "ª º µ ß.", "日本語 テキスト", "😀 😀",
]
DOCS = "doc_id long, text string, ids string, n_tokens string"
text_strategy = st.text(alphabet=st.sampled_from("aAbBzZéÉßΣσİ'’.,!?-<|> \n\t́ ▁日0123456789"), max_size=60)


@pytest.fixture(scope="module")
def pieces():
    return S.PieceEncoder(public_tokenizers.path(S.MODEL))


@pytest.fixture(scope="module")
def words():
    return K.WordTokenizer(public_tokenizers.path(K.TOKENIZER))


@settings(max_examples=300, deadline=None)
@given(text_strategy)
def test_pieces_equal_the_library(pieces, text):
    want = [1, *pieces.model.encode(text), 2]
    assert np.frombuffer(pieces.encode(text), "<u4").tolist() == want


@settings(max_examples=300, deadline=None)
@given(text_strategy)
def test_words_equal_the_library(words, text):
    assert np.frombuffer(words.encode(text), words.dtype).tolist() == words.inner.encode(text, add_special_tokens=False).ids


def test_a_small_table_changes_nothing(words, folder, monkeypatch):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()]
    small = K.WordTokenizer(public_tokenizers.path(K.TOKENIZER))
    monkeypatch.setattr(small, "MOST", 50)
    got = [x for i in range(0, len(texts), 16) for x in small.encode_many(texts[i : i + 16])]
    assert got == [np.array(words.inner.encode(t, add_special_tokens=False).ids, words.dtype).tobytes() for t in texts]


def test_pieces_query(spark, pieces):
    rows = [(i, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(0, "again", "", ""), (None, "no id", "", "")]
    got = sorted(map(repr, (tuple(r) for r in S.digests(spark.createDataFrame(rows, DOCS)).collect())))
    want = []
    for i, t, *_ in rows:
        ids = [1, *pieces.model.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.model.decode(ids).encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    assert S.digests(spark.createDataFrame([], DOCS)).count() == 0
    ids = S.encode(spark.createDataFrame([(1, "a word"), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.decoded for r in S.decode(ids.unionByName(spark.createDataFrame([(3, None)], ids.schema))).collect()} == {1: "a word", 2: "", 3: ""}


def expected(rows, words):
    at, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, 42 if r[1] is None else hash_of(r[1]), r[1] or "")):
        ids = [*words.inner.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_query(spark, words, tmp_path):
    rows = [(i * 3 % 23, t) for i, t in enumerate(TEXTS)] + [(5, "again"), (None, "no id"), (-4, "first")]
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], DOCS).repartition(3)
    shards = K.write(df, str(tmp_path / "t"), shards=4).collect()
    got = sorted((tuple(r) for r in K.read(spark, str(tmp_path / "t"), shards).collect()), key=lambda r: r[1])
    assert got == expected(rows, words)
    empty = K.write(spark.createDataFrame([], DOCS), str(tmp_path / "e"), shards=2).collect()
    assert K.read(spark, str(tmp_path / "e"), empty).count() == 0


def test_shards_give_sequences_without_copies(tmp_path):
    out = K.ShardWriter(str(tmp_path), 0, np.dtype("<u2"), length=8, per_batch=2)
    ids = np.arange(1, 78, dtype="<u2")
    for i, part in enumerate(np.split(ids, [3, 3, 40, 41])):
        out.add(i, part.tobytes())
    out.close()
    back = K.ShardReader(str(tmp_path), 0)
    assert len(back) == 10 and np.concatenate([back.sequence(i)[0] for i in range(10)])[:77].tolist() == ids.tolist()
    assert sum(back.sequence(i)[1].to_pylist().count(True) for i in range(10)) == 77
    flat, _ = back.sequence(3)
    assert not flat.flags.owndata and np.shares_memory(flat, back._flat(1)) and back.held[0] == 1
    for s, n in ((r["start"], r["n_tokens"]) for b in back.documents() for r in b.to_pylist()):
        assert back.tokens(s, n).tolist() == ids[s : s + n].tolist()
    with pytest.raises(IndexError):
        back.sequence(10)
    for n, per in ((16, 2), (17, 2), (8, 1), (0, 2), (1, 4)):  # the last batch full, short, the only one, or none
        out = K.ShardWriter(str(tmp_path / f"n{n}"), 0, np.dtype("<u2"), length=8, per_batch=per)
        out.add(1, ids[:n].tobytes())
        out.close()
        one = K.ShardReader(str(tmp_path / f"n{n}"), 0)
        assert len(one) == -(-n // 8) and one.tokens(0, n).tolist() == ids[:n].tolist()
    with pa.ipc.open_stream(pa.memory_map(str(tmp_path / "shard-000000.arrow"))) as stream:
        assert stream.schema.field("ids").type == pa.list_(pa.uint16(), 8)


def test_a_hot_id_is_spread(spark, tmp_path):
    """Rows without an id are more than one shard's; all are read back in one order."""
    df = spark.range(0, 4000, 1, 4).selectExpr("CAST(NULL AS LONG) AS doc_id", "CONCAT('text ', id) AS text")
    shards = K.write(df, str(tmp_path / "h"), shards=4).collect()
    assert max(s.n_docs for s in shards) < 2000
    got = sorted(r.start for r in K.read(spark, str(tmp_path / "h"), shards).collect())
    assert len(got) == 4000 and got == sorted(set(got))


def test_clashing_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, ids string")
    with pytest.raises(ValueError, match="columns already"):
        S.encode(df)


def test_words_are_segmented_by_the_table(spark, pieces):
    """Every distinct marked word is in the table once; words too long for it are segmented where they stand."""
    from reelsift.llm.common import Shards

    df = spark.createDataFrame([("a b  b c.",), ("b a", ), (None,), ("x" * 300 + " a",)], "text string").repartition(3)
    folder = S.chunk_table(df, "text", public_tokenizers.path(S.MODEL))
    known = Shards(folder, S.SHARDS)
    words = [" a", " b", "  b", " c."]
    assert known.get_many([*words, " x", " " + "x" * 300], mostly_absent=False) == {w: (ids,) for w, ids in zip(words, pieces.segmented(words), strict=True)}


def test_values_of_differs_by_key_not_only_by_hash(tmp_path):
    """Another key of a hash is passed over; absent keys are null; the order is that of the keys."""
    from reelsift.llm.common import Shards

    rows = sorted([(hash_of("b"), "aa", b"1"), (hash_of("b"), "b", b"2"), (hash_of("é"), "é", b"")])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["hash", "key", "value"])
    with pa.ipc.new_file(str(tmp_path / "0.arrow"), batch.schema) as out:
        out.write_batch(batch)
    (tmp_path / "0.last").write_bytes(np.array([rows[-1][0]], np.int64).tobytes())
    known = Shards(str(tmp_path), 1)
    assert known.values_of(pa.array(["é", "zz", "b", "a"], pa.large_string())).to_pylist() == [b"", None, b"2", None]
    assert known.values_of(pa.array([], pa.large_string())).to_pylist() == []


def test_encoding_costs_less_than_a_look_up_for_each_word(pieces):
    """Words are made distinct and their ids joined by Arrow, not one Python string for each word."""
    import re
    import time

    texts = [" ".join(f"w{(i * 31 + j * 7) % 900}" for j in range(400)) for i in range(600)]
    ids = {w: pieces.segmented([w])[0] for w in {" " + w for t in texts for w in t.split(" ")}}

    def by_word():
        return [b"".join([pieces.begin, *map(ids.__getitem__, re.findall(" *[^ ]+| +$", " " + t)), pieces.end]) for t in texts]

    def cost(f):
        def once():
            start = time.process_time()
            f()
            return time.process_time() - start

        return min(once() for _ in range(5))

    assert pieces.encode_many(texts) == by_word()
    assert cost(lambda: pieces.encode_many(texts)) < 0.8 * cost(by_word)


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|>. B<|STARTOFTEXT|>", "ª. µ! É; Ω, x. ×, ÷.", "ab́, É.", ",", ".,", "\n\n a\n"])
def test_special_tokens_are_found_before_case_is_folded(words, text):
    assert np.frombuffer(words.encode(text), words.dtype).tolist() == words.inner.encode(text, add_special_tokens=False).ids


def test_words_cost_less_than_a_look_up_for_each(words):
    """Known chunks are made distinct and their ids joined by Arrow, not one Python string for each chunk."""
    import time

    texts = [" ".join(f"w{'abcdefghij'[(i + j) % 10]}{'klmnopqrst'[(i * j) % 10]}" for j in range(400)) for i in range(600)]
    ids = {w: words.encode(w) for w in {w for t in texts for w in t.split(" ")}}

    def by_word():
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        assert not set().union(*chunks).difference(ids)
        return [b"".join(map(ids.__getitem__, c)) for c in chunks]

    def cost(f):
        def once():
            start = time.process_time()
            f()
            return time.process_time() - start

        return min(once() for _ in range(5))

    assert words.encode_many(texts) == by_word()
    assert cost(lambda: words.encode_many(texts)) < 0.8 * cost(by_word)
