"""The ordered greedy selection: a row passes if the rows accepted before it let it.

Whether a row passes depends on which earlier rows passed, so neither a window
function nor a self-join can say it. Rows are dealt out by key, sorted by key
and order, and each task streams them through a bounded buffer of accepted
rows: a key needs memory for its buffer only, however long it is, but it is
worked through in order by one task. ``native_select`` says the same as one
Catalyst expression, for keys of up to a few thousand rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: accepts(row values, buffer of such values, oldest first) -> bool
Accept = Callable[[tuple, "deque[tuple]"], bool]


def greedy_select(
    df: DataFrame,
    key: str | None,
    order: list[str],
    payload: list[str],
    accepts: Accept,
    buffer_size: int,
    flag: str | None = None,
    active: str | None = None,
    ready: Callable[[tuple], tuple] | None = None,
    dealt_out: bool = False,
) -> DataFrame:
    """Rows that pass, or all rows with a boolean column ``flag``.

    key: column by which rows are apart (null is a key of its own); None is one
    stream, worked through by one task. order: columns that order a key's rows;
    ties are broken by the payload's order of arrival and should not happen.
    payload: the columns that ``accepts`` sees. active: a boolean column; rows
    where it isn't true are skipped and have a null flag. ready: makes of a
    payload what ``accepts`` sees and the buffer keeps. dealt_out: ``df`` comes
    from such a selection by the same key and order, with nothing since that
    moves rows, so it needn't be shuffled and sorted again.
    """
    if buffer_size <= 0:
        raise ValueError("buffer_size must be above zero")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [key] if key else []
    dealt = df if dealt_out else df.repartition(n, key) if key else df.repartition(1)
    dealt = dealt if dealt_out else dealt.sortWithinPartitions(*keys, *order)
    schema = T.StructType(dealt.schema.fields + ([T.StructField(flag, T.BooleanType())] if flag else []))

    def run(batches):
        last, buffer = object(), deque(maxlen=buffer_size)
        for batch in batches:
            values = list(zip(*(batch.column(c).to_pylist() for c in payload), strict=True)) if payload else [()] * batch.num_rows
            groups = batch.column(key).to_pylist() if key else [None] * batch.num_rows
            on = batch.column(active).to_pylist() if active else [True] * batch.num_rows
            passed: list[bool | None] = []
            for group, value, use in zip(groups, values, on, strict=True):
                if group != last:
                    last = group
                    buffer.clear()
                if not use:
                    passed.append(None)
                    continue
                value = ready(value) if ready else value
                ok = bool(accepts(value, buffer))
                if ok:
                    buffer.append(value)
                passed.append(ok)
            mask = pa.array(passed, pa.bool_())
            if flag:
                yield pa.RecordBatch.from_arrays([*batch.columns, mask], schema.names)
            else:
                yield batch.filter(mask)

    return dealt.mapInArrow(run, schema)


def native_select(df: DataFrame, key: str, order: list[str], payload: Column, rejects: Callable[[Column, Column], Column], buffer_size: int) -> DataFrame:
    """(key, order..., payload) of rows that pass, by one aggregate expression for each key.

    rejects(candidate, accepted) is true if the accepted row blocks the
    candidate. A key's rows are gathered in one array and the result array is
    copied as it grows, so keys should have a few thousand rows at most.
    """
    if buffer_size <= 0:
        raise ValueError("buffer_size must be above zero")
    row = F.struct(*order, payload.alias("_payload"))
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    kind = df.select(F.array(row).alias("r")).schema["r"].dataType.simpleString()
    empty = F.expr(f"cast(array() as {kind})")

    def step(acc: Column, x: Column) -> Column:
        blocked = F.exists(acc["buf"], lambda h: rejects(x["_payload"], h["_payload"]))
        kept = F.when(F.size(acc["buf"]) >= buffer_size, F.slice(acc["buf"], 2, buffer_size)).otherwise(acc["buf"])
        return F.when(blocked, acc).otherwise(F.struct(F.concat(kept, F.array(x)).alias("buf"), F.concat(acc["out"], F.array(x)).alias("out")))

    chosen = F.aggregate("_rows", F.struct(empty.alias("buf"), empty.alias("out")), step, lambda acc: acc["out"])
    return rows.select(key, F.inline(chosen))


def window_antijoin(df: DataFrame, key: str, order: list[str], rejects: Callable[[Column, Column], Column], value: Column, last: int) -> DataFrame:
    """Rows that none of the ``last`` rows before them rejects, whether those passed or not."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*order).rowsBetween(-last, -1)
    return df.withColumn("_before", F.collect_list(value).over(w)).where(~F.exists("_before", lambda h: rejects(value, h))).drop("_before")


def raw_history(df: DataFrame, key: str, order: list[str], measure: Column, last: int, name: str) -> DataFrame:
    """Adds an aggregate of the ``last`` rows before each one, whether those passed or not."""
    from pyspark.sql import Window as W

    return df.withColumn(name, measure.over(W.partitionBy(key).orderBy(*order).rowsBetween(-last, -1)))


class TemporalBuffer:
    """A bounded buffer of the newest items."""

    def __init__(self, max_size: int):
        if max_size <= 0:
            raise ValueError("max_size must be above zero")
        self._items: deque = deque(maxlen=max_size)

    def add(self, item) -> None:
        self._items.append(item)

    def get_window(self) -> list:
        return list(self._items)

    def find_similar(self, item, similar: Callable) -> object | None:
        """The oldest item for which ``similar(item, it)`` holds."""
        return next((x for x in self._items if similar(item, x)), None)

    def clear(self) -> None:
        self._items.clear()

    def is_full(self) -> bool:
        return len(self._items) == self._items.maxlen

    def __len__(self) -> int:
        return len(self._items)

    def __bool__(self) -> bool:
        return bool(self._items)
