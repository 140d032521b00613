"""Python taggers and the predicates between them in one pass over Arrow batches or files.

A frame's pixels go to Python once. Each tagger measures only the frames that
passed the predicates before it, rejected frames don't come back, and pixels
come back only if a later stage reads them. Frames of files are decoded in the
same pass, so pixels of rejected frames never leave the worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from reelsift.operators.filters import StatelessFilter
from reelsift.operators.taggers import Tagger
from reelsift.schema import FRAME, FRAME_SCHEMA, pixels_row

ERRORS, COUNTS = "_errors", "_counts"
#: Bytes of pixels that are decoded before the stages run over them.
HELD_BYTES = 8 << 20


def can_fuse(stage) -> bool:
    """Taggers, and predicates that say what they keep of a batch."""
    return isinstance(stage, Tagger) or isinstance(stage, StatelessFilter) and type(stage).keeps is not StatelessFilter.keeps


class _Pass:
    """The stages of one task, and what they counted."""

    def __init__(self, stages: list, labels: list[str] | None, fields: list[T.StructField], count: bool):
        from pyspark.sql.pandas.types import to_arrow_type

        self.stages, self.labels = stages, labels or [s.name for s in stages]
        self.kinds = {f.name: to_arrow_type(f.dataType) for f in fields}
        self.all = [to_arrow_type(f.dataType) for f in fields]
        self.total, self.counts, self.count = 0, np.zeros((len(stages), 3), np.int64), count

    def run(self, n: int, at: Callable[[int], np.ndarray], given: Callable[[str], list], errors: list[list[str]]) -> tuple[np.ndarray, dict[str, list]]:
        """Which of n frames are kept, and their tags; ``errors`` gets messages."""
        on = np.ones(n, bool)
        values: dict[str, list] = {f.name: [None] * n for s in self.stages if isinstance(s, Tagger) for f in s.fields}
        tags = lambda t: values[t] if t in values else given(t)
        self.total += n
        for s, (stage, name) in enumerate(zip(self.stages, self.labels, strict=True)):
            places = np.flatnonzero(on).tolist()
            if not places:
                break
            self.counts[s, :2] += len(places)
            if isinstance(stage, StatelessFilter):
                on &= np.array(stage.keeps(tags), bool)
                self.counts[s, 1] -= len(places) - int(on.sum())
                continue
            arrays, broken = [], {}
            for i in places:
                try:
                    arrays.append(at(i))
                except ValueError as e:
                    broken[i] = e
            found = iter(stage.compute_batch(arrays))
            for i in places:
                got = broken.get(i) or next(found)
                if isinstance(got, Exception):
                    errors[i].append(f"{name}: {got}")
                    self.counts[s, 2] += 1
                    got = (None,) * len(stage.fields)
                for key, v in zip(stage.tag_keys, got, strict=True):
                    values[key][i] = v
        return on, values

    def columns(self, values: dict[str, list], errors: list[list[str]]) -> list[pa.Array]:
        n = len(errors)
        made = [pa.array(v, self.kinds[name]) for name, v in values.items()] + [pa.array(errors, pa.list_(pa.string()))]
        return made + ([pa.nulls(n, pa.list_(pa.int64()))] if self.count else [])

    def counted(self, names: list[str]):
        """The row of counts, if there is to be one."""
        if self.count:
            empty = [pa.nulls(1, k) for k in self.all[:-1]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([[self.total, *self.counts.ravel().tolist()]], pa.list_(pa.int64()))], names)


def _schema(rest: list[T.StructField], stages: list, count: bool) -> T.StructType:
    made = {f.name: f for s in stages if isinstance(s, Tagger) for f in s.fields}
    fields = [*rest, *made.values(), T.StructField(ERRORS, T.ArrayType(T.StringType()))] + ([T.StructField(COUNTS, T.ArrayType(T.LongType()))] if count else [])
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields] if count else fields)


def _arrays(frames: pa.StructArray):
    """A function from a row to its array, which is a view of the batch."""
    h, w, c, data = (frames.field(i) for i in range(4))

    def at(i: int) -> np.ndarray:
        if not frames[i].is_valid:
            raise ValueError("no frame")
        shape = (h[i].as_py(), w[i].as_py(), c[i].as_py())
        flat = np.frombuffer(data[i].as_buffer(), np.uint8)
        return flat.reshape(shape[:2]) if shape[2] == 1 else flat.reshape(shape)

    return at


def apply_fused(frames: DataFrame, stages: list, keep_frame: bool, labels: list[str] | None = None, count: bool = False) -> DataFrame:
    """``frames`` after the stages, with their tags and ``_errors``, messages of taggers that failed.

    count: each task adds a row that has nothing but ``_counts``: the frames
    that came in and, for each stage, those it saw, passed on and failed at.
    """
    tags = {t for s in stages if isinstance(s, Tagger) for t in s.tag_keys}
    rest = [f for f in frames.schema.fields if f.name not in tags | {ERRORS} and (keep_frame or f.name != FRAME)]
    schema = _schema(rest, stages, count)
    had_errors = ERRORS in frames.columns

    def run(batches):
        one = _Pass(stages, labels, schema.fields, count)
        for batch in batches:
            errors = [list(e or []) for e in batch.column(ERRORS).to_pylist()] if had_errors else [[] for _ in range(batch.num_rows)]
            on, values = one.run(batch.num_rows, _arrays(batch.column(FRAME)), lambda t: batch.column(t).to_pylist(), errors)
            columns = [batch.column(f.name) for f in rest] + one.columns(values, errors)
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(on))
        yield from one.counted(schema.names)

    return frames.mapInArrow(run, schema)


def fused_files(spark: SparkSession, paths: list[str], rows: Callable, stages: list, keep_frame: bool, labels: list[str] | None = None, count: bool = False) -> DataFrame:
    """The frames of files after the stages, as ``apply_fused`` gives them; ``rows`` decodes a path to rows with arrays for pixels."""
    rest = [f for f in FRAME_SCHEMA.fields if keep_frame or f.name != FRAME]
    schema = _schema(rest, stages, count)
    place = FRAME_SCHEMA.names.index(FRAME)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        one = _Pass(stages, labels, schema.fields, count)
        kinds = [to_arrow_type(f.dataType) for f in rest]

        def done(held: list):
            errors = [[] for _ in held]
            on, values = one.run(len(held), lambda i: held[i][place], lambda t: [None] * len(held), errors)
            kept = np.flatnonzero(on).tolist()
            if not kept:
                return
            some = [[(dict(zip(("height", "width", "channels", "data"), pixels_row(held[i][p]), strict=True)) if p == place else held[i][p]) for i in kept] for p in range(len(FRAME_SCHEMA)) if keep_frame or p != place]
            some = [[list(x.items()) for x in c] if pa.types.is_map(k) else c for c, k in zip(some, kinds, strict=True)]
            made = one.columns({k: [v[i] for i in kept] for k, v in values.items()}, [errors[i] for i in kept])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds, strict=True)] + made, schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[place].nbytes
                    if size > HELD_BYTES:
                        yield from done(held)
                        held, size = [], 0
                if held:
                    yield from done(held)
        yield from one.counted(schema.names)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(len(paths), 1)).mapInArrow(run, schema)
