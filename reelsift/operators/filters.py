"""Filters: predicates on tags, and greedy selections that compare with accepted frames."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelsift.functions import images
from reelsift.functions.distance import Distance, EmbeddingDistance, HistogramDistance, default_distance, parse_hex
from reelsift.operators.greedy import greedy_select
from reelsift.operators.taggers import PX
from reelsift.schema import FRAME, INTERNAL, NUMBER, VIDEO, is_diversity_suitable, to_array


class Filter:
    """Keeps some rows. ``required_tags`` must come from earlier taggers."""

    required_tags: list[str] = []

    @property
    def name(self) -> str:
        return type(self).__name__


class StatelessFilter(Filter):
    """A predicate on one row; a missing tag never passes."""

    def condition(self) -> Column:
        raise NotImplementedError

    def passes(self) -> Column:
        return F.coalesce(self.condition(), F.lit(False))

    def keeps(self, tags: Callable[[str], list]) -> list[bool]:
        """The predicate on the values of a batch, where it runs beside Python taggers."""
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.passes())


class ThresholdFilter(StatelessFilter):
    """Compares a tag with a threshold. NaN passes only ``!=``; null never passes."""

    OPS = {
        ">": lambda a, b: a > b,
        "<": lambda a, b: a < b,
        ">=": lambda a, b: a >= b,
        "<=": lambda a, b: a <= b,
        "==": lambda a, b: a == b,
        "!=": lambda a, b: a != b,
    }

    def __init__(self, tag_key: str, threshold: float, operator: str = ">"):
        if operator not in self.OPS:
            raise ValueError(f"operator must be one of {list(self.OPS)}, not {operator!r}")
        self.tag_key, self.threshold, self.operator = tag_key, threshold, operator
        self.required_tags = [tag_key]

    def condition(self) -> Column:
        tag = F.col(self.tag_key)
        nan = F.isnan(tag.cast("double"))
        return F.when(nan, F.lit(self.operator == "!=")).otherwise(self.OPS[self.operator](tag, F.lit(self.threshold)))

    def keeps(self, tags):
        compare = self.OPS[self.operator]
        return [v is not None and bool(compare(v, self.threshold)) for v in tags(self.tag_key)]


class _AtLeast(ThresholdFilter):
    tag: str

    def __init__(self, threshold: float):
        if threshold < 0:
            raise ValueError("threshold must not be negative")
        super().__init__(self.tag, threshold, ">=")


class BlurFilter(_AtLeast):
    """Keeps frames that are sharp enough."""

    tag = "blur_score"

    def __init__(self, threshold: float = 100.0):
        super().__init__(threshold)


class EntropyFilter(_AtLeast):
    """Keeps frames with enough information."""

    tag = "entropy"

    def __init__(self, threshold: float = 4.0):
        super().__init__(threshold)


class RangeFilter(StatelessFilter):
    """Keeps tags within a range, ends included; ``missing`` stands for null."""

    def __init__(self, tag_key: str, low: float, high: float, missing: float | None = None):
        self.tag_key, self.low, self.high, self.missing = tag_key, low, high, missing
        self.required_tags = [tag_key]

    def condition(self) -> Column:
        tag = F.col(self.tag_key)
        if self.missing is not None:
            tag = F.coalesce(tag, F.lit(self.missing))
        return tag.between(self.low, self.high)

    def keeps(self, tags):
        values = (self.missing if v is None else v for v in tags(self.tag_key))
        return [v is not None and self.low <= v <= self.high for v in values]


class QualityFilter(StatelessFilter):
    """Keeps frames of which every tag reaches its least value; null counts as 0, NaN reaches nothing."""

    def __init__(self, least: dict[str, float]):
        self.least, self.required_tags = dict(least), list(least)

    def condition(self) -> Column:
        out = F.lit(True)
        for tag, value in self.least.items():
            out = out & (F.coalesce(F.col(tag), F.lit(0.0)) >= value) & ~F.isnan(F.coalesce(F.col(tag), F.lit(0.0)).cast("double"))
        return out

    def keeps(self, tags):
        columns = [[(0.0 if v is None else v) >= least for v in tags(tag)] for tag, least in self.least.items()]
        return [all(row) for row in zip(*columns, strict=True)]


class ColorSaturationFilter(RangeFilter):
    """Keeps frames whose mean saturation is within a range."""

    def __init__(self, low: float = 0.1, high: float = 0.9):
        super().__init__("saturation", low, high)


class FaceFilter(RangeFilter):
    """Keeps frames with a number of faces within a range; a frame that wasn't looked at has none."""

    def __init__(self, low: int = 1, high: int = 10):
        super().__init__("face_count", low, high, 0)


class StatefulFilter(Filter):
    """A greedy selection: the first frame of a stream passes, others depend on what was accepted.

    ``state_key`` is the column that keeps streams apart, the video id by
    default; None makes one stream of all rows.
    """

    def __init__(self, buffer_size: int, state_key: str | None = VIDEO, order: tuple[str, ...] = (NUMBER,)):
        if buffer_size <= 0:
            raise ValueError("buffer_size must be above zero")
        self.buffer_size, self.state_key, self.order = buffer_size, state_key, list(order)

    def payload(self, df: DataFrame) -> list[str]:
        """The columns that ``accepts`` sees, in order."""
        raise NotImplementedError

    def prepared(self, df: DataFrame) -> DataFrame:
        return df

    def ready(self, value: tuple) -> tuple:
        """A payload in the form in which it is compared and kept."""
        return value

    def accepts(self, value: tuple, buffer: deque) -> bool:
        """Whether a ready payload passes, given those accepted, oldest first."""
        raise NotImplementedError

    def apply(self, df: DataFrame, flag: str | None = None, active: str | None = None, dealt_out: bool = False) -> DataFrame:
        columns = df.columns
        made = self.prepared(df)
        out = greedy_select(made, self.state_key, self.order, self.payload(made), self.accepts, self.buffer_size, flag, active, self.ready, dealt_out)
        return out.select(*columns, *([flag] if flag else []))


class DuplicateFilter(StatefulFilter):
    """Rejects frames whose hash is within ``hash_size ** 2 * threshold`` bits of an accepted one.

    The hash column is made from the pixels if there is none. Accepted frames
    without a hash are passed over; a frame without a hash passes only when the
    buffer is empty.
    """

    def __init__(self, buffer_size=50, threshold=0.05, hash_type="phash", hash_size=8, highfreq_factor=4, **state):
        if not 0 <= threshold <= 1:
            raise ValueError("threshold must be within 0 and 1")
        if hash_type not in images.HASHES:
            raise ValueError(f"hash type must be one of {sorted(images.HASHES)}, not {hash_type!r}")
        super().__init__(buffer_size, **state)
        self.threshold, self.hash_type, self.hash_size = threshold, hash_type, hash_size
        self.most = hash_size**2 * threshold

    def payload(self, df):
        return [self.hash_type]

    def prepared(self, df):
        from reelsift.operators.taggers import HashTagger

        return df if self.hash_type in df.columns else HashTagger(self.hash_type, self.hash_size).apply(df)

    def ready(self, value):
        return (None if value[0] is None else parse_hex(value[0]),)

    def accepts(self, value, buffer):
        own = value[0]
        return not buffer or own is not None and all(h is None or (own ^ h).bit_count() > self.most for (h,) in buffer)


class MotionFilter(StatefulFilter):
    """Keeps frames that moved from what was accepted: its latest, its mean, or the largest difference."""

    def __init__(self, buffer_size=5, threshold=30.0, method="mean_diff", compare_with="latest", shape=(8, 8), **state):
        if method not in ("mean_diff", "mse", "histogram"):
            raise ValueError(f"motion method must be mean_diff, mse or histogram, not {method!r}")
        if compare_with not in ("latest", "mean", "max"):
            raise ValueError(f"compare_with must be latest, mean or max, not {compare_with!r}")
        super().__init__(buffer_size, **state)
        self.threshold, self.method, self.compare_with, self.shape = threshold, method, compare_with, shape

    def payload(self, df):
        return [PX if PX in df.columns and FRAME not in df.columns else FRAME]

    def _array(self, value) -> np.ndarray:
        return np.array(value, np.uint8).reshape(self.shape) if isinstance(value, list) else to_array(value)

    def ready(self, value):
        a = self._array(value[0])
        return a, images.gray_bgr(a)

    def accepts(self, value, buffer):
        if not buffer:
            return True
        own = value[1]
        if self.compare_with == "latest":
            return images.motion(own, buffer[-1][1], self.method) > self.threshold
        if self.compare_with == "mean":
            mean = np.mean([a for a, _ in buffer], axis=0).astype(np.uint8)
            return images.motion(own, images.gray_bgr(mean), self.method) > self.threshold
        return max([0.0, *(images.motion(own, g, self.method) for _, g in buffer)]) > self.threshold


class SceneChangeFilter(MotionFilter):
    """Keeps frames whose mean difference from the last accepted one is above a share of the gray range."""

    def __init__(self, buffer_size=5, threshold=0.3, shape=(8, 8), **state):
        super().__init__(buffer_size, threshold * 255, "mean_diff", "latest", shape, **state)


class TemporalSmoothingFilter(Filter):
    """Keeps frames that end a run of ``min_consecutive`` frames whose tag is above a threshold.

    The run is of raw frames. If only accepted frames counted, the first of a
    run could never be accepted, and so none.
    """

    def __init__(self, tag_key="blur_score", threshold=100.0, min_consecutive=3, state_key: str | None = VIDEO, order: tuple[str, ...] = (NUMBER,)):
        if min_consecutive < 1:
            raise ValueError("min_consecutive must be 1 at least")
        self.tag_key, self.threshold, self.min_consecutive = tag_key, threshold, min_consecutive
        self.state_key, self.order, self.required_tags = state_key, list(order), [tag_key]

    def apply(self, df: DataFrame, flag: str | None = None, active: str | None = None) -> DataFrame:
        w = W.partitionBy(*([self.state_key] if self.state_key else []), *([F.coalesce(F.col(active), F.lit(False))] if active else [])).orderBy(*self.order)
        above = ThresholdFilter(self.tag_key, self.threshold, ">").passes().cast("int")
        passes = F.sum(above).over(w.rowsBetween(1 - self.min_consecutive, 0)) >= self.min_consecutive
        name = flag or "_smooth"
        out = df.withColumn(name, F.when(F.col(active), passes) if active else passes)
        return out if flag else out.where(name).drop(name)


class DiversityFilter(StatefulFilter):
    """Keeps frames at least ``min_distance`` from every accepted one.

    The distance over several tags is their largest, or with
    ``enable_weighted_combination`` the weighted mean of the distances divided
    by the largest of the pair. Without ``diversity_tags`` every suitable tag
    column counts; a plan without such tags lets everything pass.
    """

    def __init__(
        self, buffer_size=100, diversity_tags=None, min_distance=0.1, metric="euclidean", comparison_strategies=None,
        enable_weighted_combination=False, tag_weights=None, **state,
    ):
        if metric not in EmbeddingDistance.METRICS:
            raise ValueError(f"metric must be one of {EmbeddingDistance.METRICS}, not {metric!r}")
        if min_distance < 0:
            raise ValueError("min_distance must not be negative")
        for tag, d in (comparison_strategies or {}).items():
            if not isinstance(d, Distance):
                raise ValueError(f"the strategy of {tag!r} must be a Distance")
        super().__init__(buffer_size, **state)
        self.diversity_tags = list(diversity_tags or [])
        self.required_tags = self.diversity_tags
        self.min_distance, self.metric = min_distance, metric
        self.strategies, self.weighted, self.weights = dict(comparison_strategies or {}), enable_weighted_combination, dict(tag_weights or {})
        self.available: list[str] | None = None

    def tags(self) -> list[str]:
        return self.diversity_tags or [t for t in self.available or [] if is_diversity_suitable(t) and t not in INTERNAL]

    def payload(self, df):
        return [t for t in self.tags() if t in df.columns]

    def distance_of(self, tag: str) -> Distance:
        return self.strategies.get(tag) or default_distance(tag, self.metric)

    def ready(self, value):
        return tuple(None if v is None else self.distance_of(t).ready(v) for t, v in zip(self.tags(), value, strict=True)), None in value

    def distances(self, value: tuple, held: list[tuple]) -> np.ndarray:
        """Combined distances of a ready payload to ready ones; tags that are missing or fail are passed over."""
        each = []
        for i, tag in enumerate(self.tags()):
            found = [k for k, h in enumerate(held) if h[i] is not None]
            d = np.full(len(held), np.nan)
            if value[i] is not None and found:
                d[found] = self.distance_of(tag).many(value[i], [held[k][i] for k in found])
            each.append(d)
        d = np.array(each)
        most = np.fmax.reduce(d, axis=0, initial=0.0)
        if not self.weighted:
            return most
        w = np.array([[self.weights.get(t, 1.0)] for t in self.tags()]) * ~np.isnan(d)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.nansum(w * np.nan_to_num(d), axis=0) / (most * w.sum(axis=0))
        return np.where(most > 0, mean, 0.0)

    def distance(self, a: tuple, b: tuple) -> float:
        """The combined distance of two payloads."""
        return float(self.distances(self.ready(a)[0], [self.ready(b)[0]])[0])

    def accepts(self, value, buffer):
        if not buffer or not self.tags():
            return True
        own, missing = value
        if missing:
            return False
        return bool(np.fmin.reduce(self.distances(own, [h for h, _ in buffer]), initial=np.inf) >= self.min_distance)


__all__ = [
    "BlurFilter", "ColorSaturationFilter", "DiversityFilter", "DuplicateFilter", "EntropyFilter", "FaceFilter", "Filter", "HistogramDistance", "MotionFilter",
    "QualityFilter", "RangeFilter", "SceneChangeFilter", "StatefulFilter", "StatelessFilter", "TemporalSmoothingFilter", "ThresholdFilter",
]
