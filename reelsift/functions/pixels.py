"""Pixel measures as Catalyst expressions, for small gray frames in an integer array.

They are interpreted element by element, so they suit frames of up to about a
thousand pixels; ``images`` has the numpy forms for larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def bind(value: Column, f) -> Column:
    """``f`` of ``value``, which is evaluated once, however often ``f``'s lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scaled_gray(vector: Column) -> Column:
    """Gray values 0 to 255 of a vector's components, from its least to its greatest."""
    ends = F.struct(F.array_min(vector).cast("double").alias("lo"), F.array_max(vector).cast("double").alias("hi"))

    def scaled(e: Column) -> Column:
        return F.transform(vector, lambda x: F.when(e["hi"] > e["lo"], F.floor((x.cast("double") - e["lo"]) / (e["hi"] - e["lo"]) * 255.0)).otherwise(0).cast("int"))

    return bind(ends, scaled)


def _at(px: Column, row: Column, col: Column, width: int) -> Column:
    return F.element_at(px, (row * width + col + 1).cast("int")).cast("long")


def _mirrored(i: Column, n: int) -> Column:
    """Index i reflected at the borders, which aren't repeated."""
    if n == 1:
        return F.lit(0)
    i = F.abs(i)
    return F.when(i >= n, 2 * (n - 1) - i).otherwise(i)


def laplacian(px: Column, height: int, width: int) -> Column:
    """The 4-neighbour Laplacian of a gray frame, in whole numbers."""

    def at(i: Column) -> Column:
        r, c = F.floor(i / width), i % width
        around = [
            _at(px, _mirrored(r - 1, height), c, width), _at(px, _mirrored(r + 1, height), c, width),
            _at(px, r, _mirrored(c - 1, width), width), _at(px, r, _mirrored(c + 1, width), width),
        ]
        return sum(around[1:], around[0]) - 4 * _at(px, r, c, width)

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def blur_score(px: Column, height: int, width: int) -> Column:
    """Population variance of the Laplacian; 0 for empty frames. Exact up to its last division."""
    n = height * width
    if not n:
        return F.lit(0.0)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(laplacian(px, height, width), start, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: a["q"] * n - a["s"] * a["s"])
    return sums.cast("double") / float(n * n)


def entropy(px: Column) -> Column:
    """Shannon entropy in bits of 256 equal bins over 0 to 255; 0 for empty frames."""
    bins = F.transform(px, lambda v: F.least(F.floor(v * 256 / 255.0), F.lit(255)).cast("int"))
    total = F.size(px).cast("double") + EPS

    def of(b: Column) -> Column:
        shares = F.transform(F.array_distinct(b), lambda k: F.size(F.filter(b, lambda x: x == k)).cast("double") / total)
        return -_total(F.transform(shares, lambda p: p * F.log2(p + EPS)))

    return F.when(F.size(px) > 0, bind(bins, of)).otherwise(0.0)


def hex_of_bits(bits: Column) -> Column:
    """Hex digits of an array of booleans whose size is a multiple of four."""

    def joined(b: Column) -> Column:
        one = lambda i, k: F.element_at(b, (i * 4 + k + 1).cast("int")).cast("int") * (8 >> k)
        places = F.sequence(F.lit(0), (F.size(b) / 4 - 1).cast("int"))
        return F.array_join(F.transform(places, lambda i: F.lower(F.hex(one(i, 0) + one(i, 1) + one(i, 2) + one(i, 3)))), "")

    return bind(bits, joined)


def average_hash(px: Column) -> Column:
    """Hex of the pixels above the mean, for frames that have the hash's size already."""
    total = F.aggregate(px, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return hex_of_bits(bind(total, lambda t: F.transform(px, lambda v: v * F.size(px) > t)))


def difference_hash(px: Column, height: int, width: int) -> Column:
    """Hex of the pixels above their left neighbours, for frames of ``width`` = hash size + 1."""
    places = F.transform(F.sequence(F.lit(0), F.lit(height * (width - 1) - 1)), lambda i: F.floor(i / (width - 1)) * width + i % (width - 1))
    return hex_of_bits(F.transform(places, lambda i: F.element_at(px, (i + 2).cast("int")) > F.element_at(px, (i + 1).cast("int"))))


def histogram(px: Column, bins: int) -> Column:
    """Counts of equal ranges of gray values."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(px, lambda v: F.floor(v * bins / 256) == b)).cast("double"))
