import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelsift.llm import media

DOCS = "doc_id long, text string, media string, codec int"


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_rows_equal_brute_force(spark):
    texts = [None, "", "a", "x" * 576, "x" * 577, "é€😀" * 999, "long " * 40_000, "a", "a"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(t)
        assert r.media_bytes > r.payload_bytes
    assert got[2].media_sha256 == got[7].media_sha256 == got[8].media_sha256
    assert got[0].feature == got[1].feature == "raw|1|0.04|" + got[0].feature.split("|")[-1]


def test_empty_table(spark):
    assert media.features(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32))
def test_container_round_trip(n, seed):
    payload = np.random.default_rng(seed).bytes(n * 576)
    stored = media.mux(payload)
    (track,) = media.read_tracks(stored)
    assert media.demux(stored, track) == payload
    assert track.duration / track.timescale == n / 25 and track.codec == "raw "
    for k, (at, size, time) in enumerate(track.keyframes()):
        assert time == k * 12 / 25
        assert stored[at : at + size] == payload[k * 12 * 576 : k * 12 * 576 + 576]


def test_large_boxes_unequal_samples_and_several_runs():
    """A 64-bit box size, samples of their own sizes, two runs of chunks, and chunks out of file order."""
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    data = b"AABBBCCCCD"
    stbl = [
        media.full(b"stsd", u4(1), media.box(b"test", bytes(8))), media.full(b"stsz", u4(0, 4), u4(2, 3, 1, 4)),
        media.full(b"stsc", u4(2), u4(1, 2, 1), u4(2, 1, 1)), media.full(b"stss", u4(2), u4(1, 3)),
    ]
    mdat = b"\0\0\0\1mdat" + np.array([16 + len(data)], ">u8").tobytes() + data
    base = 16
    stbl.append(media.full(b"co64", u4(3), np.array([base, base + 9, base + 5], ">u8").tobytes()))
    mdhd = media.full(b"mdhd", np.array([0, 0], ">u8").tobytes(), u4(1000), np.array([2500], ">u8").tobytes(), u4(0), version=1)
    trak = media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", media.box(b"stbl", *stbl))))
    (track,) = media.read_tracks(mdat + media.box(b"moov", trak))
    assert (track.codec, track.timescale, track.duration) == ("test", 1000, 2500)
    assert track.offsets.tolist() == [16, 18, 25, 21] and [k[:2] for k in track.keyframes()] == [(16, 2), (25, 1)]
    assert media.demux(mdat + media.box(b"moov", trak), track) == b"AABBBDCCCC"


@pytest.mark.parametrize("broken", [b"", None, b"\0\0\0\4moov", b"garbage!" * 9, media.mux(bytes(576))[:400]])
def test_broken_media_have_an_error(broken):
    found = media.describe(broken)
    assert set(found) == {"media_error"} and found["media_error"]


def test_any_changed_byte_is_read_or_an_error():
    """Whatever one byte outside the samples is changed to, nothing but an error row comes of it, and soon."""
    stored = media.mux(np.random.default_rng(1).bytes(576 * 25))
    head = len(stored) - 576 * 25
    for at in range(head):
        for value in (0, 1, 127, 255):
            changed = stored[:at] + bytes([value]) + stored[at + 1 :]
            found = media.describe(changed)
            assert found.get("media_error") or found["n_samples"] * 576 <= len(stored)
            for t in media.read_tracks(changed) if "media_error" not in found else []:
                try:
                    assert len(media.demux(changed, t)) <= 2 * len(stored)
                except ValueError:
                    pass


def _track(number, kind, *tables, scale=1000):
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    mdhd, hdlr = media.full(b"mdhd", u4(0, 0, scale, 9, 0)), media.full(b"hdlr", u4(0), kind, bytes(12))
    return media.box(b"trak", media.full(b"tkhd", u4(0, 0, number, 0, 0)), media.box(b"mdia", mdhd, hdlr, media.box(b"minf", media.box(b"stbl", *tables))))


def test_time_tables_compact_sizes_and_several_tracks():
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    tables = lambda codec, sizes, *more: (
        media.full(b"stsd", u4(1), media.box(codec, bytes(8))), media.full(b"stts", u4(2, 2, 100, 1, 700)), sizes, media.full(b"stsc", u4(1, 1, 3, 1)), media.full(b"stco", u4(1, 64)), *more,
    )
    one = _track(1, b"vide", *tables(b"avc1", media.full(b"stz2", u4(4, 3), bytes([0x12, 0x30])), media.full(b"stss", u4(2, 1, 3))))
    two = _track(2, b"soun", *tables(b"mp4a", media.full(b"stz2", u4(16, 3), bytes([0, 9, 1, 0, 0, 2]))))
    found = media.describe(media.box(b"moov", one, two) + bytes(400))
    assert (found["codec"], found["duration_s"], found["n_samples"]) == ("avc1", 0.9, 3)
    assert [(k["offset"], k["length"], k["time_s"]) for k in found["keyframes"]] == [(64, 1, 0.0), (67, 3, 0.2)]
    assert [(t["kind"], t["codec"], [k["length"] for k in t["keyframes"]]) for t in found["tracks"]] == [("vide", "avc1", [1, 3]), ("soun", "mp4a", [9, 256, 2])]
    assert media.describe(media.box(b"moov", _track(1, b"vide", *tables(b"avc1", media.full(b"stz2", u4(8, 3), b"abc"), media.full(b"stss", u4(1, 0))))))["media_error"]


def test_movie_fragments():
    u4 = lambda *x: np.array(x, ">u4").tobytes()
    empty = [media.full(k, u4(0)) for k in (b"stts", b"stsc", b"stco")] + [media.full(b"stsz", u4(0, 0))]
    trak = _track(7, b"vide", media.full(b"stsd", u4(1), media.box(b"avc1", bytes(8))), *empty)
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", u4(7, 1, 40, 5, 0x10000))))

    def moof(offset):
        runs = [media.full(b"trun", u4(3, offset, 0), flags=5), media.full(b"trun", u4(2, 6, 0, 7, 0x10000), flags=0x600)]
        return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u4(7), flags=0x20000), *runs))

    data = b"aaaaabbbbbcccccddddddeeeeeee"
    whole = moov + moof(len(moof(0)) + 8) + media.box(b"mdat", data)
    (track,) = media.read_tracks(whole)
    assert media.demux(whole, track) == data and track.sizes.tolist() == [5, 5, 5, 6, 7] and track.duration == 200
    assert [(n, t) for _, n, t in track.keyframes()] == [(5, 0.0), (6, 0.12)]


def test_clashing_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", b"b")], "doc_id long, text string, media binary")
    for bad in (lambda: media.media_column(df), lambda: media.probe(df.withColumnRenamed("doc_id", "codec"))):
        with pytest.raises(ValueError, match="columns already"):
            bad()


def test_probe_reads_no_samples(spark):
    stored = media.mux(bytes(576 * 30))
    without = stored[: -576 * 30] + b"\1" * 576 * 30
    df = spark.createDataFrame([(1, bytearray(stored)), (2, bytearray(without)), (3, None)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.probe(df).collect()}
    assert rows[1].keyframes == rows[2].keyframes and len(rows[1].keyframes) == 3 and rows[3].media_error
