"""Operator 1: media columns in ISO base media containers.

``mux`` lays a payload out as 8-bit gray samples of 24 x 24 pixels in a
container whose sample tables describe it; ``probe`` walks the nested boxes of
stored media, decodes the sample tables and gives codec, duration and the byte
ranges of keyframes without touching a sample; ``demux`` reads samples back by
the same tables. All work is by row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsift.llm.common import sliced, table

SIDE = 24
SAMPLE = SIDE * SIDE
#: Samples of a chunk; the first of each is a keyframe.
GROUP = 12
RATE = 25
CODEC = b"raw "
#: Boxes that hold boxes, with the bytes of their own before the first child.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0}
SLICE = 256


def box(kind: bytes, *parts: bytes) -> bytes:
    """A box with a 32-bit size, or a 64-bit one if it needs it."""
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 2**32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return b"".join([head, *parts])


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
HDLR = full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"samples\0")
MINF_HEAD = full(b"vmhd", bytes(8), flags=1) + box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
#: 8-bit gray is depth 40 in this sample entry.
ENTRY = box(CODEC, struct.pack(">6xH16xHHIIIH32xHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, 40, -1))
STSD = full(b"stsd", struct.pack(">I", 1), ENTRY)


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the sample size."""
    return data + b"\xff" * ((-len(data)) % SAMPLE if data else SAMPLE)


def mux(payload: bytes) -> bytes:
    """A container of a payload whose length is a positive multiple of the sample size."""
    n = len(payload) // SAMPLE
    chunks, rest = -(-n // GROUP), n % GROUP
    runs = [(1, GROUP, 1)] if n >= GROUP else []
    if rest:
        runs.append((chunks, rest, 1))
    wide = len(payload) > 2**31
    mdat_head = 16 if len(payload) + 8 >= 2**32 else 8

    def moov(first: int) -> bytes:
        starts = first + np.arange(chunks, dtype=np.int64) * (GROUP * SAMPLE)
        stbl = box(
            b"stbl", STSD,
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", chunks), np.arange(1, n + 1, GROUP).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), HDLR, box(b"minf", MINF_HEAD, stbl))
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    first = len(FTYP) + len(moov(0)) + mdat_head
    return b"".join([FTYP, moov(first), box(b"mdat", payload)])


@dataclass
class Track:
    """What the tables of one track say; ``offsets``, ``sizes`` and ``times`` (in units of the timescale) are by sample."""

    kind: str
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    sync: np.ndarray

    def seconds(self, units: int) -> float | None:
        return units / self.timescale if self.timescale else None

    def keyframes(self) -> list[tuple[int, int, float | None]]:
        """(offset, length, time in seconds) of each keyframe's bytes."""
        return [(o, n, self.seconds(t)) for o, n, t in zip(*(x[self.sync].tolist() for x in (self.offsets, self.sizes, self.times)), strict=True)]


def walk(data: memoryview, at: int = 0, end: int | None = None):
    """(path, start, end) of the boxes' contents, nested ones after their parents."""
    stack = [(at, len(data) if end is None else end, ())]
    while stack:
        at, end, path = stack.pop()
        if at + 8 > end:
            continue
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} at {at} has size {n}")
        stack.append((at + n, end, path))
        yield (*path, kind), at + head, at + n
        if kind in CONTAINERS:
            stack.append((at + head + CONTAINERS[kind], at + n, (*path, kind)))


def _ints(data: memoryview, at: int, end: int, count: int, kind: str = ">u4") -> np.ndarray:
    """``count`` numbers that must lie within their box."""
    if at + count * np.dtype(kind).itemsize > end:
        raise ValueError(f"a table of {count} entries is longer than its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _u4(data: memoryview, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def _sizes(data: memoryview, kind: bytes, at: int, end: int) -> np.ndarray:
    """Sample sizes of an stsz or stz2 box."""
    n = _u4(data, at + 8)
    if kind == b"stz2":
        bits = _u4(data, at + 4) & 255
        if bits == 4:
            pairs = _ints(data, at + 12, end, -(-n // 2), "u1")
            return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n]
        return _ints(data, at + 12, end, n, {8: "u1", 16: ">u2"}[bits])
    if one := _u4(data, at + 4):
        if one * n > len(data):
            raise ValueError(f"{n} samples of {one} bytes are more than there is")
        return np.full(n, one, np.int64)
    return _ints(data, at + 12, end, n)


def read_tracks(media: bytes) -> list[Track]:
    """The tracks of a container, movie fragments included; ``ValueError`` if its boxes or tables don't fit together."""
    data = memoryview(media)
    found: list[dict] = []
    defaults: dict[int, tuple] = {}
    moof, part = 0, None
    try:
        for path, at, end in walk(data):
            kind = path[-1]
            if kind == b"trak":
                found.append({"parts": []})
            elif kind == b"moof":
                moof = at - 8
            elif kind == b"trex":
                defaults[_u4(data, at + 4)] = struct.unpack_from(">III", data, at + 12)
            elif kind == b"tfhd":
                part = _fragment(data, at, moof, defaults)
            elif kind == b"trun" and part:
                owner = next(t for t in found if t.get("id") == part["id"])
                owner["parts"].append(_run(data, at, end, part))
            elif found and b"trak" in path:
                t = found[-1]
                if kind == b"tkhd":
                    t["id"] = _u4(data, at + (20 if data[at] else 12))
                elif kind == b"mdhd":
                    t["time"] = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
                elif kind == b"hdlr":
                    t["kind"] = bytes(data[at + 8 : at + 12]).decode("latin-1")
                elif kind == b"stsd":
                    t["codec"] = bytes(data[at + 12 : at + 16]).decode("latin-1") if _u4(data, at + 4) else ""
                elif kind == b"stts":
                    t["steps"] = _ints(data, at + 8, end, 2 * _u4(data, at + 4)).reshape(-1, 2)
                elif kind == b"stss":
                    t["sync"] = _ints(data, at + 8, end, _u4(data, at + 4)) - 1
                elif kind == b"stsc":
                    t["runs"] = _ints(data, at + 8, end, 3 * _u4(data, at + 4)).reshape(-1, 3)
                elif kind in (b"stsz", b"stz2"):
                    t["sizes"] = _sizes(data, kind, at, end)
                elif kind in (b"stco", b"co64"):
                    t["chunks"] = _ints(data, at + 8, end, _u4(data, at + 4), ">u4" if kind == b"stco" else ">u8")
        return [_track(t) for t in found]
    except (struct.error, KeyError, IndexError, StopIteration, OverflowError) as e:
        raise ValueError(f"not a readable container: {e!r}") from e


def _fragment(data: memoryview, at: int, moof: int, defaults: dict) -> dict:
    """What a track fragment header says: track, where data begins, and duration, size and flags of a sample."""
    flags, track = _u4(data, at) & 0xFFFFFF, _u4(data, at + 4)
    out = {"id": track, "base": moof, "end": None} | dict(zip(("step", "size", "flags"), defaults.get(track, (0, 0, 0)), strict=True))
    at += 8
    if flags & 1:
        out["base"] = struct.unpack_from(">Q", data, at)[0]
        at += 8
    for bit, name in ((2, "description"), (8, "step"), (16, "size"), (32, "flags")):
        if flags & bit:
            out[name] = _u4(data, at)
            at += 4
    return out


def _run(data: memoryview, at: int, end: int, part: dict) -> tuple[np.ndarray, ...]:
    """Offsets, sizes, steps and flags of the samples of a track run."""
    flags, n = _u4(data, at) & 0xFFFFFF, _u4(data, at + 4)
    at += 8
    start = part["base"] if part["end"] is None else part["end"]
    if flags & 1:
        start = part["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 4:
        first = _u4(data, at)
        at += 4
    fields = [name for bit, name in ((256, "step"), (512, "size"), (1024, "flags"), (2048, "shift")) if flags & bit]
    if not fields and n > len(data):
        raise ValueError(f"{n} samples are more than there is")
    rows = _ints(data, at, end, n * len(fields)).reshape(n, len(fields))
    size, step, mark = (rows[:, fields.index(f)] if f in fields else np.full(n, part[f], np.int64) for f in ("size", "step", "flags"))
    if first is not None and n:
        mark = np.concatenate([[first], mark[1:]])
    offsets = start + np.concatenate([[0], np.cumsum(size)])
    part["end"] = int(offsets[-1])
    return offsets[:-1], size, step, mark


def _track(t: dict) -> Track:
    sizes, chunks, runs = t["sizes"], t["chunks"], t["runs"]
    ends = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else np.zeros(0, np.int64)
    if len(runs) and (runs[0, 0] != 1 or (ends < runs[:, 0]).any()):
        raise ValueError("the runs of chunks are out of order")
    per_chunk = np.repeat(runs[:, 1], ends - runs[:, 0])
    if per_chunk.sum() != len(sizes):
        raise ValueError("the chunk table and the size table count different samples")
    # A sample starts where its chunk does, plus the sizes before it in that chunk.
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    filled = per_chunk > 0
    first = np.concatenate([[0], np.cumsum(per_chunk)])[:-1][filled]
    offsets = before + np.repeat(chunks[: len(per_chunk)][filled] - before[first] if len(sizes) else chunks[:0], per_chunk[filled])
    scale, duration = t["time"]
    steps = t.get("steps")
    if steps is not None:
        if steps[:, 0].sum() != len(sizes):
            raise ValueError("the time table and the size table count different samples")
        each = np.repeat(steps[:, 1], steps[:, 0])
    else:
        each = np.zeros(len(sizes), np.int64)
    sync = t.get("sync", np.arange(len(sizes)))
    if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
        raise ValueError("a keyframe is no sample")
    for more, size, step, mark in t["parts"]:
        sync = np.concatenate([sync, len(sizes) + np.flatnonzero(mark >> 16 & 1 == 0)])
        offsets, sizes, each = np.concatenate([offsets, more]), np.concatenate([sizes, size]), np.concatenate([each, step])
    times = np.concatenate([[0], np.cumsum(each)])
    return Track(t.get("kind", ""), t["codec"], scale, int(times[-1]) or duration, offsets, sizes, times[:-1], sync)


def demux(media: bytes, track: Track) -> bytes:
    """The samples' bytes in order; neighbours in the file are read in one go."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    if ends.max() > len(media) or track.offsets.min() < 0 or track.sizes.min() < 0:
        raise ValueError("samples lie beyond the end")
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    view = memoryview(media)
    starts, stops = track.offsets[np.append(0, cuts)], ends[np.append(cuts - 1, len(ends) - 1)]
    return b"".join(view[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True))


MUXED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
_KEYFRAME = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("time_s", T.DoubleType())])
_TRACK = [T.StructField("codec", T.StringType()), T.StructField("duration_s", T.DoubleType()), T.StructField("n_samples", T.LongType()), T.StructField("keyframes", T.ArrayType(_KEYFRAME))]
#: The first track, all of them, and what is wrong with media that can't be read.
PROBED = T.StructType([*_TRACK, T.StructField("tracks", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *_TRACK]))), T.StructField("media_error", T.StringType())])


def media_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces ``text_col`` by ``n_bytes`` (before padding) and ``media``.

    Null counts as empty, and an empty text is one sample of bytes 255. Equal
    texts give equal media. Rows are independent, so repeated rows, very long
    texts and other columns are as they are; a ``ValueError`` if one of those
    has a name that is added. An empty table stays empty.
    """
    rest = [c for c in df.columns if c != text_col]
    _free(rest, MUXED.names)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, SLICE):
                raw = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
                made = [pa.array(map(len, raw), pa.int64()), pa.array([mux(padded(r)) for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + made, [*rest, *MUXED.names])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in rest] + MUXED.fields))


def _free(columns: list[str], added: list[str]) -> None:
    if clash := set(columns) & set(added):
        raise ValueError(f"{sorted(clash)} are columns already")


def _described(t: Track) -> dict:
    keyframes = [dict(zip(_KEYFRAME.names, k, strict=True)) for k in t.keyframes()]
    return {"codec": t.codec, "duration_s": t.seconds(t.duration), "n_samples": len(t.sizes), "keyframes": keyframes}


def describe(media: bytes | None) -> dict:
    """A row of ``PROBED``; unreadable media have an error and nulls."""
    try:
        tracks = read_tracks(media or b"")
        if not tracks:
            raise ValueError("no track")
        return _described(tracks[0]) | {"tracks": [{"kind": t.kind} | _described(t) for t in tracks]}
    except ValueError as e:
        return {"media_error": str(e)}


def probe(df: DataFrame, media_col: str = "media", read_back: bool = False) -> DataFrame:
    """Adds codec, duration, sample count and keyframe ranges of stored media, of the first track and in ``tracks`` of all.

    Null, empty and broken media have nulls and ``media_error``. With
    ``read_back`` the samples of the first track are read as well, for
    ``payload_bytes``, ``payload_sha256`` and ``tail_crc32``; ``media`` is
    dropped then. Rows are independent; a ``ValueError`` if another column has
    a name that is added. An empty table stays empty.
    """
    keep = [c for c in df.columns if not (read_back and c == media_col)]
    fields = [df.schema[c] for c in keep] + PROBED.fields
    if read_back:
        fields += [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType())]
        fields += [T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())]
    schema = T.StructType(fields)
    _free(keep, schema.names[len(keep) :])

    def back(media: bytes | None) -> tuple:
        media = media or b""
        try:
            payload = demux(media, read_tracks(media)[0])
        except (ValueError, IndexError):
            return None, None, None, len(media), hashlib.sha256(media).hexdigest()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for part in sliced(batch, SLICE):
                media = part.column(media_col).to_pylist()
                rows = [describe(m) for m in media]
                made = [pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in PROBED]
                if read_back:
                    found = list(zip(*(back(m) for m in media), strict=True))
                    made += [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(found, fields[len(keep) + len(PROBED) :], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, schema.names)

    return df.mapInArrow(run, schema)


def op1_media(spark, sf_dir):
    return features(table(spark, sf_dir, "documents"))


def features(docs: DataFrame) -> DataFrame:
    """The digest row of every document; ``feature`` is codec, samples, duration and keyframe ranges."""
    read = probe(media_column(docs.select("doc_id", "text")), read_back=True)
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat(k.offset.cast("string"), F.lit("+"), k.length.cast("string"))), ",")
    feature = F.concat_ws("|", F.trim("codec"), F.col("n_samples").cast("string"), F.col("duration_s").cast("string"), ranges)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
