"""SQL building blocks of the oracles: frames, measures, distances and the greedy recursion."""

from __future__ import annotations

EMBEDDED = """
e AS MATERIALIZED (
  SELECT CAST(label AS VARCHAR) AS source_video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_number, vec_id, embedding,
         list_transform(embedding, lambda x: CASE WHEN hi > lo THEN CAST(floor((CAST(x AS DOUBLE) - lo) / (hi - lo) * 255.0) AS INTEGER) ELSE 0 END) AS px
  FROM (SELECT *, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings)
)"""

PIXELS = EMBEDDED + """, l AS MATERIALIZED (
  SELECT *, list_transform(range(0, 64), lambda i:
      px[(abs(i // 8 - 1)) * 8 + i % 8 + 1] + px[(CASE WHEN i // 8 = 7 THEN 6 ELSE i // 8 + 1 END) * 8 + i % 8 + 1]
    + px[(i // 8) * 8 + abs(i % 8 - 1) + 1] + px[(i // 8) * 8 + (CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END) + 1] - 4 * px[i + 1]) AS lap,
    list_transform(px, lambda v: least(v * 256 // 255, 255)) AS bins,
    list_transform(px, lambda v: v > list_sum(px) / 64.0) AS bits
  FROM e
), t AS MATERIALIZED (
  SELECT source_video_id, frame_number, vec_id, embedding, px, bits,
    CAST(list_sum(list_transform(lap, lambda x: x * x)) * 64 - list_sum(lap) * list_sum(lap) AS DOUBLE) / 4096.0 AS blur_score,
    -list_sum(list_transform(list_distinct(bins), lambda b: len(list_filter(bins, lambda x: x = b)) / 64.0 * log2(len(list_filter(bins, lambda x: x = b)) / 64.0))) AS entropy,
    array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef',
      CAST(bits[4 * i + 1] AS INTEGER) * 8 + CAST(bits[4 * i + 2] AS INTEGER) * 4 + CAST(bits[4 * i + 3] AS INTEGER) * 2 + CAST(bits[4 * i + 4] AS INTEGER) + 1, 1)), '') AS ahash
  FROM l
)"""

EVENTS = """
t AS MATERIALIZED (
  SELECT CAST(user_id AS VARCHAR) AS source_video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number, event_id, value FROM events
)"""

EUCLIDEAN = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)))))"
MANHATTAN = "list_sum(list_transform(range(1, 65), lambda i: abs(CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))"
_NORM = "sqrt(list_sum(list_transform({x}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))"
COSINE = (
    "CASE WHEN " + _NORM.format(x="{a}") + " = 0 OR " + _NORM.format(x="{b}") + " = 0 THEN 1.0 ELSE least(greatest(1 - "
    "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE))) / (" + _NORM.format(x="{a}") + " * " + _NORM.format(x="{b}") + "), 0.0), 2.0) END"
)
HAMMING = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] <> {b}[i] AS INTEGER)))"
INTERSECTION = "1 - list_sum(list_transform(range(1, 17), lambda i: least({a}[i] / (list_sum({a}) + 1e-10), {b}[i] / (list_sum({b}) + 1e-10))))"
_SHARE = "({x}[i] / (list_sum({x}) + 1e-10))"
CHI_SQUARE = (
    "list_sum(list_transform(range(1, 17), lambda i: power(" + _SHARE.format(x="{a}") + " - " + _SHARE.format(x="{b}") + ", 2) / (" + _SHARE.format(x="{a}") + " + " + _SHARE.format(x="{b}") + " + 1e-10)))"
)
BHATTACHARYYA = "-ln(least(greatest(list_sum(list_transform(range(1, 17), lambda i: sqrt(" + _SHARE.format(x="{a}") + " * " + _SHARE.format(x="{b}") + "))), 1e-10), 1.0))"
MEAN_DIFF = "list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i]))) / 64.0"
MSE = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) / 64.0"
_PAIRS = "list_sum(list_transform({a}, lambda x: len(list_filter({b}, lambda y: x = y))))"
# Both histograms have 64 counts in 256 bins, so their mean is 1/4 and 256 * (1/4)^2 = 16.
HISTOGRAM = "1 - (" + _PAIRS + " - 16) / sqrt((" + _PAIRS.format(a="{a}", b="{a}") + " - 16) * (" + _PAIRS.format(a="{b}", b="{b}") + " - 16) * 1.0::DOUBLE)"
#: 16 ranges of gray values.
HIST16 = "list_transform(range(0, 16), lambda k: CAST(len(list_filter(px, lambda v: v // 16 = k)) AS DOUBLE))"


def greedy(name: str, source: str, payload: str, accepts: str, size: int, columns: str) -> str:
    """CTEs ``<name>`` (accepted rows of ``source``). ``accepts`` sees ``g.buf`` and ``f.v``."""
    listed = ", ".join(f"f.{c.strip()}" for c in columns.split(","))
    return f"""
{name}_f AS MATERIALIZED (
  SELECT {columns}, row_number() OVER (PARTITION BY source_video_id ORDER BY frame_number) AS n, {payload} AS v FROM {source}
), {name}_g AS (
  SELECT {columns}, n, true AS pass, [v] AS buf FROM {name}_f WHERE n = 1
  UNION ALL
  SELECT {listed}, f.n, p.pass, CASE WHEN p.pass THEN list_slice(list_append(g.buf, f.v), greatest(1, len(g.buf) + 2 - {size}), len(g.buf) + 1) ELSE g.buf END
  FROM {name}_g g JOIN {name}_f f ON f.source_video_id = g.source_video_id AND f.n = g.n + 1, LATERAL (SELECT {accepts} AS pass) p
), {name} AS MATERIALIZED (SELECT {columns} FROM {name}_g WHERE pass)"""


def none_rejects(rejects: str) -> str:
    """No accepted ``h`` rejects ``f.v``."""
    return f"len(list_filter(g.buf, lambda h: {rejects})) = 0"
