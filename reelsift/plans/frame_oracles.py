"""SQL of measures over RGB frames: a row for each pixel, then aggregates."""

from __future__ import annotations

from reelsift.plans import oracles as O

LUMA = "(9798 * {0} + 19235 * {1} + 3735 * {2} + 16384) >> 15"
HASH_LUMA = "(19595 * blue + 38470 * green + 7471 * red + 32768) >> 16"


def frames(height: int, width: int) -> str:
    """CTE ``f``: the pixels of the frames that ``rgb_frames`` makes."""
    return f"""{O.EMBEDDED}, f AS MATERIALIZED (
  SELECT source_video_id, frame_number, vec_id, y, x, (p * 2 + 5 * y + 3 * x) % 256 AS red, (p * 3 + 5 * y + 3 * x + 40) % 256 AS green, (p * 4 + 5 * y + 3 * x + 80) % 256 AS blue
  FROM (SELECT e.*, y, x, px[y * 8 // {height} * 8 + x * 8 // {width} + 1] AS p FROM e, range({height}) a(y), range({width}) b(x))
), g AS MATERIALIZED (
  SELECT vec_id, y, x, {LUMA.format("red", "green", "blue")} AS v, {HASH_LUMA} AS h FROM f
)"""


def blur(height: int, width: int) -> str:
    """CTE ``blur`` (vec_id, blur_score)."""
    n, h, w = height * width, height, width
    return f"""blur AS MATERIALIZED (
  SELECT vec_id, CAST(list_sum(list_transform(l, lambda v: v * v)) * {n} - list_sum(l) * list_sum(l) AS DOUBLE) / {n * n}.0 AS blur_score
  FROM (SELECT vec_id, list_transform(range(0, {n}), lambda i:
      px[abs(i // {w} - 1) * {w} + i % {w} + 1] + px[(CASE WHEN i // {w} = {h - 1} THEN {h - 2} ELSE i // {w} + 1 END) * {w} + i % {w} + 1]
    + px[i // {w} * {w} + abs(i % {w} - 1) + 1] + px[i // {w} * {w} + (CASE WHEN i % {w} = {w - 1} THEN {w - 2} ELSE i % {w} + 1 END) + 1] - 4 * px[i + 1]) AS l
    FROM (SELECT vec_id, list(v ORDER BY y, x) AS px FROM g GROUP BY vec_id))
)"""


def entropy(height: int, width: int) -> str:
    """CTE ``entropies`` (vec_id, entropy)."""
    n = f"{height * width}.0"
    return f"""entropies AS MATERIALIZED (
  SELECT vec_id, -sum(c / {n} * log2(c / {n})) AS entropy
  FROM (SELECT vec_id, least((2989 * red + 5870 * green + 1140 * blue) * 256 // 2550000, 255) AS b, count(*) AS c FROM f GROUP BY ALL) GROUP BY vec_id
)"""


def bits(name: str, rows: str) -> str:
    """CTEs of a hash from ``rows`` (vec_id, k, bit): ``bits`` as a list of booleans, and its hex digits."""
    return f"""{name}_b AS MATERIALIZED (SELECT vec_id, list(bit ORDER BY k) AS bits FROM ({rows}) GROUP BY vec_id
), {name} AS MATERIALIZED (
  SELECT vec_id, bits, array_to_string(list_transform(range(0, len(bits) // 4), lambda i: substr('0123456789abcdef',
    CAST(bits[4 * i + 1] AS INTEGER) * 8 + CAST(bits[4 * i + 2] AS INTEGER) * 4 + CAST(bits[4 * i + 3] AS INTEGER) * 2 + CAST(bits[4 * i + 4] AS INTEGER) + 1, 1)), '') AS hex FROM {name}_b
)"""


AVERAGE = "SELECT vec_id, y * 8 + x AS k, h > avg(h) OVER (PARTITION BY vec_id) AS bit FROM g"
DIFFERENCE = "SELECT a.vec_id, a.y * 8 + a.x AS k, b.h > a.h AS bit FROM g a JOIN g b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 1"
WAVELET = "SELECT vec_id, k, s > median(s) OVER (PARTITION BY vec_id) AS bit FROM (SELECT vec_id, y // 2 * 8 + x // 2 AS k, sum(h) AS s FROM g GROUP BY ALL)"
COSINE = """SELECT vec_id, k, d > median(d) OVER (PARTITION BY vec_id) AS bit FROM (
  SELECT vec_id, a * 8 + b AS k, sum(t * 2 * cos(pi() * b * (2 * x + 1) / 64)) AS d
  FROM (SELECT vec_id, a, x, sum(h * 2 * cos(pi() * a * (2 * y + 1) / 64)) AS t FROM g, range(8) r(a) GROUP BY ALL), range(8) c(b) GROUP BY ALL)"""

#: Hue, saturation and value, each 0 to 255, of channels c1, c2, c3 in the order of RGB.
HSV = """
hsv AS MATERIALIZED (
  SELECT vec_id, h, CAST(floor(CASE WHEN span = 0 THEN 0.0::DOUBLE
      WHEN hi = c1 THEN CASE WHEN (c2 - c3) / span < 0 THEN (c2 - c3) / span + 6 ELSE (c2 - c3) / span END
      WHEN hi = c2 THEN (c3 - c1) / span + 2 ELSE (c1 - c2) / span + 4 END / 6 * 255) AS BIGINT) AS hue,
    CAST(floor(CASE WHEN hi = 0 THEN 0.0::DOUBLE ELSE span / hi END * 255) AS BIGINT) AS sat, CAST(hi AS BIGINT) AS val
  FROM (SELECT *, hi - lo AS span FROM (SELECT *, greatest(c1, c2, c3) AS hi, least(c1, c2, c3) AS lo
    FROM (SELECT f.vec_id, g.h, CAST({0} AS DOUBLE) AS c1, CAST(green AS DOUBLE) AS c2, CAST({1} AS DOUBLE) AS c3 FROM f JOIN g USING (vec_id, y, x))))
)"""


def color_bits(n: int, bits_each: int) -> str:
    """Rows of the colour hash of frames of ``n`` pixels, whose channels are swapped."""
    most = 2**bits_each
    part = lambda i, cond: f"SELECT vec_id, {i} AS i, least({most - 1}, CAST(floor(count(*) FILTER ({cond}) / {n}.0::DOUBLE * {most}) AS BIGINT)) AS v FROM hsv GROUP BY vec_id"
    colored = "h >= 32 AND sat >= 85"
    hues = " UNION ALL ".join(
        f"SELECT vec_id, {2 + 6 * j} + b AS i, least({most - 1}, CAST(floor(count(*) FILTER ({colored} AND {cond} AND least(floor(hue / 42.5::DOUBLE), 5) = b) * {most} / CAST(greatest(1, count(*) FILTER ({colored})) AS DOUBLE)) AS BIGINT)) AS v FROM hsv, range(6) r(b) GROUP BY vec_id, b"
        for j, cond in enumerate(("sat < 170", "sat > 170"))
    )
    return f"""SELECT vec_id, i * {bits_each} + j AS k, (v >> ({bits_each - 1} - j)) & 1 = 1 AS bit FROM (
  {part(0, "h < 32")} UNION ALL {part(1, "sat < 85 AND h >= 32")} UNION ALL {hues}), range({bits_each}) r(j)"""


def edges(height: int, width: int) -> str:
    """CTE ``edge`` (vec_id, edge_count) by Sobel gradients with repeated borders."""
    return f"""sobel AS MATERIALIZED (
  SELECT a.vec_id, a.y, a.x, abs(sum(dx * (2 - abs(dy)) * b.v)) + abs(sum(dy * (2 - abs(dx)) * b.v)) AS s
  FROM g a, range(-1, 2) p(dy), range(-1, 2) q(dx), g b
  WHERE b.vec_id = a.vec_id AND b.y = least(greatest(a.y + dy, 0), {height - 1}) AND b.x = least(greatest(a.x + dx, 0), {width - 1}) GROUP BY ALL
), strong AS MATERIALIZED (
  SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM sobel, range(-1, 2) p(dy), range(-1, 2) q(dx) WHERE s >= 150
), edge AS MATERIALIZED (
  SELECT a.vec_id, count(*) FILTER (a.s >= 50 AND b.vec_id IS NOT NULL) AS edge_count FROM sobel a LEFT JOIN strong b USING (vec_id, y, x) GROUP BY a.vec_id
)"""


def gray_lists() -> str:
    """CTE ``t``: frames with the list of their gray values as motion sees them."""
    return f"t AS MATERIALIZED (SELECT source_video_id, frame_number, vec_id, list({LUMA.format('blue', 'green', 'red')} ORDER BY y, x) AS px FROM f GROUP BY ALL)"
