"""Distances between two tag values, as Catalyst expressions and as numpy twins.

Expressions serve joins and native plans; the twins serve the ordered greedy
operator, which compares a frame with a buffer.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from reelsift.functions.pixels import bind

EPS = 1e-10


def _zipped(a: Column, b: Column, f) -> Column:
    """Element by element; the shorter array is filled up with zeros."""
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x.cast("double"), F.lit(0.0)), F.coalesce(y.cast("double"), F.lit(0.0))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _padded(a, b) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.asarray(x, float).ravel() for x in (a, b))
    n = max(len(a), len(b))
    return np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))


class Distance:
    """A named distance: ``expr`` on columns, ``compute`` on values."""

    name: str

    def expr(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def compute(self, a, b) -> float:
        raise NotImplementedError

    def ready(self, value):
        """A value in the form in which ``many`` compares it, made once for each frame."""
        return value

    def many(self, value, held: list) -> np.ndarray:
        """Distances of a ready value to ready ones; NaN where there is none."""
        out = np.full(len(held), np.nan)
        for i, h in enumerate(held):
            try:
                out[i] = self.compute(value, h)
            except (TypeError, ValueError):
                pass
        return out


def parse_hex(value) -> int:
    """A hash's bits as a number; ``ValueError`` for other text, ``TypeError`` for other values."""
    if not isinstance(value, str):
        raise TypeError(f"Cannot convert {type(value).__name__} to a hash")
    if not re.fullmatch("[0-9a-fA-F]+", value):
        raise ValueError(f"Cannot parse hex string {value!r}")
    return int(value, 16)


class HammingDistance(Distance):
    """Differing bits of two hex hashes as a share of their bits."""

    name = "hamming"

    def expr(self, a: Column, b: Column) -> Column:
        def bits(h: Column) -> Column:
            ok = h.rlike("^[0-9a-fA-F]+$")
            return F.when(ok, h).otherwise(F.raise_error(F.concat(F.lit("Cannot parse hex string "), h)))

        return hamming_bits(bits(a), bits(b)) / (4 * F.greatest(F.length(a), F.length(b))).cast("double")

    def compute(self, a, b) -> float:
        return (parse_hex(a) ^ parse_hex(b)).bit_count() / (4 * max(len(a), len(b)))

    def ready(self, value):
        try:
            return parse_hex(value), 4 * len(value)
        except (TypeError, ValueError):
            return None

    def many(self, value, held):
        if value is None:
            return np.full(len(held), np.nan)
        bits, n = value
        return np.array([np.nan if h is None else (bits ^ h[0]).bit_count() / max(n, h[1]) for h in held])


def hamming_bits(a: Column, b: Column) -> Column:
    """Number of differing bits of two hex strings of any equal length, 15 digits at a time."""
    starts = F.sequence(F.lit(1), F.length(a), F.lit(15))
    part = lambda h, i: F.conv(F.substr(h, i, F.lit(15)), 16, 10).cast("long")
    return F.aggregate(starts, F.lit(0), lambda acc, i: acc + F.bit_count(part(a, i).bitwiseXOR(part(b, i))))


class EmbeddingDistance(Distance):
    """Euclidean, Manhattan or cosine distance; shorter vectors are filled up with zeros."""

    METRICS = ("euclidean", "manhattan", "cosine")

    def __init__(self, metric: str = "cosine"):
        if metric not in self.METRICS:
            raise ValueError(f"metric must be one of {self.METRICS}, not {metric!r}")
        self.metric = metric

    @property
    def name(self) -> str:
        return f"embedding_{self.metric}"

    def expr(self, a: Column, b: Column) -> Column:
        if self.metric == "euclidean":
            return F.sqrt(_sum(_zipped(a, b, lambda x, y: (x - y) * (x - y))))
        if self.metric == "manhattan":
            return _sum(_zipped(a, b, lambda x, y: F.abs(x - y)))
        norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
        na, nb = norm(a), norm(b)
        cos = _sum(_zipped(a, b, lambda x, y: x * y)) / (na * nb)
        return F.when((na == 0) | (nb == 0), 1.0).otherwise(F.least(F.greatest(1 - cos, F.lit(0.0)), F.lit(2.0)))

    def compute(self, a, b) -> float:
        a, b = _padded(a, b)
        if self.metric == "euclidean":
            return float(np.sqrt(((a - b) ** 2).sum()))
        if self.metric == "manhattan":
            return float(np.abs(a - b).sum())
        na, nb = np.sqrt((a * a).sum()), np.sqrt((b * b).sum())
        if na == 0 or nb == 0:
            return 1.0
        return float(np.clip(1 - (a * b).sum() / (na * nb), 0.0, 2.0))

    def ready(self, value):
        try:
            return np.asarray(value, float).ravel()
        except (TypeError, ValueError):
            return None

    def many(self, value, held):
        if value is None or any(h is None for h in held) or any(h.shape != value.shape for h in held):
            return super().many(value, held)
        rows = np.array(held)
        if self.metric == "euclidean":
            return np.sqrt(((rows - value) ** 2).sum(axis=1))
        if self.metric == "manhattan":
            return np.abs(rows - value).sum(axis=1)
        norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((value * value).sum())
        cosines = np.divide((rows * value).sum(axis=1), norms, out=np.zeros(len(rows)), where=norms != 0)
        return np.clip(1 - cosines, 0.0, 2.0)


class ScalarDistance(Distance):
    """Absolute difference of two numbers: every embedding metric but cosine in one dimension."""

    name = "scalar"

    def expr(self, a: Column, b: Column) -> Column:
        return F.abs(a.cast("double") - b.cast("double"))

    def compute(self, a, b) -> float:
        return abs(float(a) - float(b))


class HistogramDistance(Distance):
    """Intersection, chi-square or Bhattacharyya distance of histograms scaled to a sum of 1."""

    METRICS = ("intersection", "chi_square", "bhattacharyya")

    def __init__(self, metric: str = "intersection"):
        if metric not in self.METRICS:
            raise ValueError(f"metric must be one of {self.METRICS}, not {metric!r}")
        self.metric = metric

    @property
    def name(self) -> str:
        return f"histogram_{self.metric}"

    def expr(self, a: Column, b: Column) -> Column:
        def scaled(h: Column) -> Column:
            total = _sum(F.transform(h, lambda x: x.cast("double"))) + EPS
            return bind(total, lambda t: F.transform(h, lambda x: x.cast("double") / t))

        a, b = scaled(a), scaled(b)
        if self.metric == "intersection":
            return 1 - _sum(_zipped(a, b, F.least))
        if self.metric == "chi_square":
            return _sum(_zipped(a, b, lambda x, y: (x - y) * (x - y) / (x + y + EPS)))
        shared = _sum(_zipped(a, b, lambda x, y: F.sqrt(x * y)))
        return -F.log(F.least(F.greatest(shared, F.lit(EPS)), F.lit(1.0)))

    def compute(self, a, b) -> float:
        a, b = (np.asarray(x, float).ravel() for x in (a, b))
        a, b = _padded(a / (a.sum() + EPS), b / (b.sum() + EPS))
        if self.metric == "intersection":
            return float(1 - np.minimum(a, b).sum())
        if self.metric == "chi_square":
            return float(((a - b) ** 2 / (a + b + EPS)).sum())
        return float(-np.log(np.clip(np.sqrt(a * b).sum(), EPS, 1.0)))


def default_distance(tag: str, metric: str = "euclidean") -> Distance:
    """The distance a tag has if none is named: Hamming for hashes, intersection for histograms, else ``metric``."""
    if tag in {"dhash", "phash", "ahash", "whash", "colorhash"}:
        return HammingDistance()
    if tag in {"color_hist", "color_histogram"}:
        return HistogramDistance("intersection")
    return EmbeddingDistance(metric)
