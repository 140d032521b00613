"""The distances as SQL functions, for queries over temporary views.

They are functions in SQL, so Catalyst sees through them as through expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"
_EACH = "zip_with(a, b, (x, y) -> {0})"
_X, _Y = "coalesce(x, 0D)", "coalesce(y, 0D)"
_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
_SHARES = "zip_with(transform(a, x -> x / (aggregate(a, 0D, (s, x) -> s + x) + 1e-10D)), transform(b, x -> x / (aggregate(b, 0D, (s, x) -> s + x) + 1e-10D)), (x, y) -> {0})"
_VECTORS = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"

#: name -> (parameters, type, expression)
FUNCTIONS = {
    "hamming_bits": ("a STRING, b STRING", "INT", "aggregate(sequence(1, length(a), 15), 0, (s, i) -> s + bit_count(cast(conv(substr(a, i, 15), 16, 10) AS BIGINT) ^ cast(conv(substr(b, i, 15), 16, 10) AS BIGINT)))"),
    "euclidean_distance": (_VECTORS, "DOUBLE", "sqrt(" + _SUM.format(_EACH.format(f"({_X} - {_Y}) * ({_X} - {_Y})")) + ")"),
    "manhattan_distance": (_VECTORS, "DOUBLE", _SUM.format(_EACH.format(f"abs({_X} - {_Y})"))),
    "cosine_distance": (
        _VECTORS, "DOUBLE",
        f"CASE WHEN {_NORM.format('a')} = 0 OR {_NORM.format('b')} = 0 THEN 1D "
        f"ELSE least(greatest(1 - {_SUM.format(_EACH.format(f'{_X} * {_Y}'))} / ({_NORM.format('a')} * {_NORM.format('b')}), 0D), 2D) END",
    ),
    "intersection_distance": (_VECTORS, "DOUBLE", "1 - " + _SUM.format(_SHARES.format(f"least({_X}, {_Y})"))),
    "chi_square_distance": (_VECTORS, "DOUBLE", _SUM.format(_SHARES.format(f"({_X} - {_Y}) * ({_X} - {_Y}) / ({_X} + {_Y} + 1e-10D)"))),
    "bhattacharyya_distance": (_VECTORS, "DOUBLE", "-ln(least(greatest(" + _SUM.format(_SHARES.format(f"sqrt({_X} * {_Y})")) + ", 1e-10D), 1D))"),
}


def register(spark: SparkSession) -> SparkSession:
    """Adds the functions to the session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return spark
