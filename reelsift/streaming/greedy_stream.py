"""The greedy selection over an unbounded stream, with the accepted frames of each video as state.

Rows are taken in order within a micro-batch; rows of equal order are all taken.
A row that is below the last one that its video has seen is late, as the batch
result could not be had any more: it is never accepted, and comes out marked if
asked for. A micro-batch's rows of one video are held to be sorted, so the
trigger should bound micro-batches where files are many and written in order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class GreedyProcessor(StatefulProcessor):
    """State of one key: the buffer of accepted payloads, oldest first, the last order values, and the number of late rows."""

    def __init__(self, order: list[str], payload: str, accepts, buffer_size: int, columns: list[str], late: str | None):
        self.order, self.payload, self.accepts, self.size, self.columns, self.late = order, payload, accepts, buffer_size, columns, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", T.StructType([T.StructField("value", T.DoubleType())]))
        self.seen = handle.getValueState("seen", T.StructType([*(T.StructField(f"last_{c}", T.LongType()) for c in self.order), T.StructField("late", T.LongType())]))

    def handleInputRows(self, key, rows, timer_values):
        held = [v[0] for v in self.buffer.get()] if self.buffer.exists() else []
        *last, late = self.seen.get() if self.seen.exists() else (*[None] * len(self.order), 0)
        last = None if last[0] is None else tuple(last)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        passed, behind = [], []
        for at, value in zip(zip(*(batch[c] for c in self.order), strict=True), batch[self.payload], strict=True):
            at = tuple(map(int, at))
            behind.append(last is not None and at < last)
            ok = False
            if behind[-1]:
                late += 1
            else:
                last = at
                ok = not held or bool(self.accepts(value, held))
                if ok:
                    held = [*held, float(value)][-self.size :]
            passed.append(ok)
        if held:
            self.buffer.put([(v,) for v in held])
        self.seen.update((*last, late))
        out = batch[self.columns]
        if self.late:
            out = out.assign(**{self.late: behind})
            passed = [p or b for p, b in zip(passed, behind, strict=True)]
        yield out.loc[passed] if len(passed) else out

    def close(self) -> None:
        pass


def greedy_stream(stream: DataFrame, key: str, order: str | list[str], payload: str, accepts, buffer_size: int, late: str | None = None) -> DataFrame:
    """Rows of ``stream`` that pass, in append mode.

    order: ascending whole-number columns, most significant first; payload: a
    number; accepts(value, accepted values, oldest first) -> bool. late: a
    boolean column that is added; rows that came too late come out too, with
    true there. The state store must be RocksDB.
    """
    if buffer_size <= 0:
        raise ValueError("buffer_size must be above zero")
    order = [order] if isinstance(order, str) else list(order)
    processor = GreedyProcessor(order, payload, accepts, buffer_size, stream.columns, late)
    schema = T.StructType([*stream.schema.fields, *([T.StructField(late, T.BooleanType())] if late else [])])
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="None")
