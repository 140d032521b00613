"""Frame sources and sinks: uncompressed video and picture files, rows, and a hook for decoders.

Files are listed on the driver and decoded by tasks, one frame at a time. Each
frame is a row with the id of its file, its number, its time and its pixels.
Formats: Y4M (4:2:0, 4:2:2, 4:4:4 and mono), binary PGM and PPM sequences, and
NPY arrays; ``register_decoder`` adds others.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsift.schema import FRAME, FRAME_SCHEMA, META, NUMBER, PIXELS, TIME, VIDEO, frame_row, pixels_row, to_array
from reelsift.session import file_system, replace_file, shared_dir

#: suffix -> function from a binary file to (frames a second, iterator of arrays)
DECODERS: dict[str, Callable] = {}


def register_decoder(suffix: str, decode: Callable) -> None:
    DECODERS[suffix.lower()] = decode


def _plane(data: bytes, h: int, w: int, to_h: int, to_w: int) -> np.ndarray:
    p = np.frombuffer(data, np.uint8).reshape(h, w).astype(float)
    return p.repeat(-(-to_h // h), axis=0)[:to_h].repeat(-(-to_w // w), axis=1)[:, :to_w]


def decode_y4m(file) -> tuple[float, Iterator[np.ndarray]]:
    """RGB frames of a Y4M stream (full-range BT.601)."""
    head = file.readline().decode("ascii", "replace").split()
    if not head or head[0] != "YUV4MPEG2":
        raise RuntimeError("not a Y4M stream")
    fields = {x[0]: x[1:] for x in head[1:]}
    w, h = int(fields["W"]), int(fields["H"])
    num, _, den = fields.get("F", "0:1").partition(":")
    rate = int(num) / int(den or 1) if int(den or 1) else 0.0
    space = fields.get("C", "420")
    ch, cw = (0, 0) if space.startswith("mono") else (h, w) if space.startswith("444") else (h, -(-w // 2)) if space.startswith("422") else (-(-h // 2), -(-w // 2))

    def frames():
        while file.readline().startswith(b"FRAME"):
            y = np.frombuffer(file.read(h * w), np.uint8).reshape(h, w)
            if not ch:
                yield y
                continue
            u, v = (_plane(file.read(ch * cw), ch, cw, h, w) - 128 for _ in range(2))
            luma = y.astype(float)
            rgb = np.stack([luma + 1.402 * v, luma - 0.344136 * u - 0.714136 * v, luma + 1.772 * u], axis=2)
            yield np.clip(np.rint(rgb), 0, 255).astype(np.uint8)

    return rate, frames()


def _netpbm_numbers(file, n: int) -> list[int]:
    out: list[int] = []
    while len(out) < n:
        token = b""
        while (c := file.read(1)) and not c.isspace():
            if c == b"#":
                file.readline()
                break
            token += c
        if token:
            out.append(int(token))
        elif not c:
            raise RuntimeError("the picture's header ends early")
    return out


def decode_netpbm(file) -> tuple[float, Iterator[np.ndarray]]:
    """Frames of a binary PGM or PPM file, which may hold several pictures."""

    def frames():
        while (magic := file.read(2)) in (b"P5", b"P6"):
            w, h, most = _netpbm_numbers(file, 3)
            if most > 255:
                raise RuntimeError("only 8-bit pictures are read")
            c = 3 if magic == b"P6" else 1
            data = np.frombuffer(file.read(w * h * c), np.uint8)
            yield data.reshape(h, w, 3) if c == 3 else data.reshape(h, w)
        if magic:
            raise RuntimeError("not a binary PGM or PPM picture")

    return 0.0, frames()


def decode_npy(file) -> tuple[float, Iterator[np.ndarray]]:
    """Frames of an array (N, H, W) or (N, H, W, C)."""
    version = np.lib.format.read_magic(file)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if by_column or kind.hasobject:
        raise RuntimeError("only arrays in row order are read")
    size = int(np.prod(shape[1:])) * kind.itemsize

    def frames():
        for _ in range(shape[0]):
            yield np.frombuffer(file.read(size), kind).reshape(shape[1:])

    return 0.0, frames()


for _suffix, _decode in ((".y4m", decode_y4m), (".pgm", decode_netpbm), (".ppm", decode_netpbm), (".npy", decode_npy)):
    register_decoder(_suffix, _decode)


def _decoder(path: str) -> Callable:
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in DECODERS:
        raise RuntimeError(f"no decoder for {suffix or 'a file without suffix'}; see register_decoder")
    return DECODERS[suffix]


class VideoFiles:
    """Video and picture files that a pipeline decodes in its own pass, a task for each; ``frames`` makes a table of them."""

    def __init__(self, spark: SparkSession, path: str | list[str], source_video_id: str | None = None, fps: float | None = None):
        """A missing file is a ``FileNotFoundError``, one without decoder a ``RuntimeError``."""
        paths = [path] if isinstance(path, str) else list(path)
        if len(paths) == 1 and (found := _listed(paths[0])) is not None:
            paths = [p for p in found if os.path.splitext(p)[1].lower() in DECODERS]
        for p in paths:
            files, at = file_system(p)
            if files.get_file_info(at).type == fs.FileType.NotFound:
                raise FileNotFoundError(p)
            _decoder(p)
        self.spark, self.paths, self.source_video_id, self.fps = spark, paths, source_video_id, fps

    def rows(self) -> Callable[[str], Iterator[tuple]]:
        """A function from a path to its rows, with arrays for pixels."""
        own, video, fps = dict(DECODERS), self.source_video_id, self.fps

        def run(path: str) -> Iterator[tuple]:
            files, at = file_system(path)
            with files.open_input_stream(at, compression=None) as raw, io.BufferedReader(raw, 1 << 20) as file:
                rate, frames = own[os.path.splitext(path)[1].lower()](file)
                rate = fps or rate
                for i, a in enumerate(frames):
                    time = dt.timedelta(seconds=i / rate) if rate > 0 else dt.timedelta(0)
                    yield video or os.path.basename(path), i, time, a, {"raw_frame_index_from_loader": str(i)}

        return run

    def frames(self) -> DataFrame:
        """A table of the frames."""
        decode = self.rows()

        def run(batches):
            for batch in batches:
                for p in batch["path"]:
                    for video, i, time, a, meta in decode(p):
                        yield pd.DataFrame([frame_row(a, i, time, video, meta)], columns=FRAME_SCHEMA.names)

        listed = self.spark.createDataFrame([(p,) for p in self.paths], "path string")
        return listed.repartition(max(len(self.paths), 1)).mapInPandas(run, FRAME_SCHEMA)


def _listed(path: str) -> list[str] | None:
    """The files of a folder, in order; None for what is no folder."""
    files, at = file_system(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return None
    return [os.path.join(path, f.base_name) for f in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.base_name) if f.type == fs.FileType.File]


def load_video_frames(spark: SparkSession, path: str | list[str], source_video_id: str | None = None, fps: float | None = None) -> DataFrame:
    """Frames of one file, of a list of files, or of every readable file of a folder; a task decodes a file.

    A missing file is a ``FileNotFoundError``, one without decoder a
    ``RuntimeError``, both when called. The video id is the file's name unless
    given. Time is number / rate, 0 if the rate isn't known. On a cluster paths
    are of a folder or store that all executors reach.
    """
    return VideoFiles(spark, path, source_video_id, fps).frames()


def extract_frames(spark: SparkSession, path: str) -> DataFrame:
    """(frame_number, frame) of a file, channels as BGR; a file that can't be read gives no rows."""
    try:
        frames = load_video_frames(spark, path)
    except (FileNotFoundError, RuntimeError):
        return spark.createDataFrame([], FRAME_SCHEMA).select(NUMBER, FRAME)
    swap = _swapped()
    return frames.select(NUMBER, swap(F.col(FRAME)).alias(FRAME))


def _swapped():
    @F.pandas_udf(PIXELS)
    def swap(frames: pd.DataFrame) -> pd.DataFrame:
        arrays = [to_array(r) for r in frames.to_dict("records")]
        return pd.DataFrame([pixels_row(a[:, :, ::-1] if a.ndim == 3 else a) for a in arrays], columns=PIXELS.names)

    return swap


def frames_from(spark: SparkSession, source) -> DataFrame:
    """Frames of a path, a DataFrame, or any iterable of rows from ``frame_row``; else ``TypeError``.

    An iterator is read a few frames at a time into a table in the shared
    folder. One that doesn't end is for ``FramePipeline.process_iterator``.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str | os.PathLike):
        return load_video_frames(spark, os.fspath(source))
    if hasattr(source, "__next__"):
        return _stored(spark, source)
    if hasattr(source, "__iter__"):
        return spark.createDataFrame(list(source), FRAME_SCHEMA)
    raise TypeError(f"frames can't come from {type(source).__name__}")


def _stored(spark: SparkSession, rows: Iterator, held_bytes: int = 64 << 20) -> DataFrame:
    """The rows of an iterator, written in pieces of bounded size."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = f"{shared_dir(spark)}/reelsift-frames-{uuid.uuid4().hex}"
    files, at = file_system(folder)
    files.create_dir(at, recursive=True)
    pixels = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    # A duration isn't what Spark reads as an interval, so microseconds are stored.
    schema = pa.schema([(VIDEO, pa.string()), (NUMBER, pa.int64()), (TIME, pa.int64()), (FRAME, pixels), (META, pa.map_(pa.string(), pa.string()))])
    held, size, n = [], 0, 0

    def put():
        pq.write_table(pa.Table.from_pylist(held, schema), f"{at}/{n:08d}.parquet", filesystem=files)

    for video, number, time, frame, meta in rows:
        held.append({VIDEO: video, NUMBER: number, TIME: time // dt.timedelta(microseconds=1), FRAME: dict(zip(PIXELS.names, frame, strict=True)), META: list(meta.items())})
        size += len(frame[3]) + 200
        if size > held_bytes:
            put()
            held, size, n = [], 0, n + 1
    if held or not n:
        put()
    stored = spark.read.parquet(folder)
    return stored.select(VIDEO, NUMBER, F.make_dt_interval(secs=(F.col(TIME) / F.lit(1000000)).cast("decimal(18,6)")).alias(TIME), FRAME, META)


def _planes(a: np.ndarray) -> bytes:
    x = a.astype(float)
    r, g, b = (x[:, :, i] for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    return b"".join(np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes() for p in planes)


def write_video(frames: DataFrame, folder: str, fps: int = 30) -> DataFrame:
    """Writes a Y4M file (4:4:4) for each video into ``folder``; rows: video id, path, frames written and skipped.

    Frames are streamed in order, one at a time, by one task for each video,
    under a temporary name until the file is complete, so a task that is run
    again replaces its own file. The first frame sets the size and must have
    three channels; later frames of another size are skipped. No frames at all
    is a ``ValueError``. On a cluster the folder is one that all executors reach.
    """
    if frames.isEmpty():
        raise ValueError("there are no frames to write")
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.select(VIDEO, NUMBER, FRAME).repartition(n, VIDEO).sortWithinPartitions(VIDEO, NUMBER)

    def run(batches):
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        video, file, temp, shape, done = None, None, None, None, {}

        def close():
            if file is not None:
                file.close()
                replace_file(files, temp, f"{root}/{os.path.basename(done[video][0])}")

        for batch in batches:
            for name, frame in zip(batch[VIDEO], batch[FRAME], strict=True):
                a = to_array(frame)
                if name != video:
                    close()
                    if a.ndim != 3 or a.shape[2] != 3:
                        raise ValueError(f"the first frame of {name} must be (H, W, 3), not {a.shape}")
                    base = f"{os.path.splitext(os.path.basename(name))[0]}.y4m"
                    video, shape, done[name] = name, a.shape, [f"{folder.rstrip('/')}/{base}", 0, 0]
                    temp = f"{root}/{base}.{uuid.uuid4().hex}"
                    file = files.open_output_stream(temp, compression=None)
                    file.write(f"YUV4MPEG2 W{shape[1]} H{shape[0]} F{fps}:1 Ip C444\n".encode())
                if a.shape != shape:
                    done[name][2] += 1
                    continue
                file.write(b"FRAME\n" + _planes(a))
                done[name][1] += 1
        close()
        yield pd.DataFrame([(k, *v) for k, v in done.items()], columns=[VIDEO, "path", "written", "skipped"])

    return ordered.mapInPandas(run, f"{VIDEO} string, path string, written long, skipped long")


__all__ = ["META", "TIME", "VideoFiles", "extract_frames", "frames_from", "load_video_frames", "register_decoder", "write_video"]
