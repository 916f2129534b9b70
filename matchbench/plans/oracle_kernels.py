"""DuckDB SQL for the image and point kernels on 8 x 8 images, written from their definitions over pixels in long form."""

from math import cos, pi, sin

_PX = """
s AS (SELECT vec_id AS sample_id, 'S' || lpad((label + 1)::VARCHAR, 3, '0') AS subject_id, embedding AS e FROM embeddings),
px AS MATERIALIZED (SELECT sample_id, subject_id, (k // 8)::INT AS y, (k % 8)::INT AS x, e[k + 1]::DOUBLE AS z FROM s, range(0, 64) t(k))"""
_OUT = "SELECT sample_id, subject_id, i::BIGINT AS i, round(value, 6) AS value FROM"


def _patterns() -> str:
    """Each of 8 neighbours as a cell and a fraction; corners of the cell outside the block count 0."""
    ring = [(round(-sin(2 * pi * k / 8), 5), round(cos(2 * pi * k / 8), 5)) for k in range(8)]
    rows = ", ".join(f"({k}, {dy // 1:.0f}, {dx // 1:.0f}, {dy - dy // 1!r}::DOUBLE, {dx - dx // 1!r}::DOUBLE)" for k, (dy, dx) in enumerate(ring))
    return f"""WITH {_PX},
ring(k, iy, ix, fy, fx) AS (VALUES {rows}),
corner(a, b) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
v AS (
  SELECT p.sample_id, p.y, p.x, k, any_value(p.z) AS z, sum((CASE a WHEN 0 THEN 1 - fy ELSE fy END) * (CASE b WHEN 0 THEN 1 - fx ELSE fx END) * coalesce(q.z, 0)) AS v
  FROM px p CROSS JOIN ring CROSS JOIN corner
  LEFT JOIN px q ON q.sample_id = p.sample_id AND q.y = p.y + iy + a AND q.x = p.x + ix + b AND q.y // 4 = p.y // 4 AND q.x // 4 = p.x // 4
  GROUP BY p.sample_id, p.y, p.x, k),
b AS (SELECT sample_id, y, x, k, (v - z >= -1e-12)::INT AS bit, lag((v - z >= -1e-12)::INT) OVER (PARTITION BY sample_id, y, x ORDER BY k) AS before FROM v),
w AS (SELECT sample_id, y, x, sum(bit) AS bits, sum((bit <> before)::INT) + (arg_min(bit, k) <> arg_max(bit, k))::INT AS changes FROM b GROUP BY sample_id, y, x),
h AS (SELECT sample_id, ((y // 4) * 2 + x // 4) * 10 + CASE WHEN changes <= 2 THEN bits ELSE 9 END AS i, count(*) / 16.0 AS value FROM w GROUP BY 1, 2)
{_OUT} (SELECT s.sample_id, subject_id, t.i, coalesce(value, 0.0) AS value FROM s CROSS JOIN range(0, 40) t(i) LEFT JOIN h ON h.sample_id = s.sample_id AND h.i = t.i)"""


_HOG = f"""WITH {_PX},
d AS (
  SELECT p.sample_id, p.y, p.x, coalesce(a.z - b.z, 0) AS gy, coalesce(r.z - l.z, 0) AS gx FROM px p
  LEFT JOIN px a ON a.sample_id = p.sample_id AND a.x = p.x AND a.y = p.y + 1 LEFT JOIN px b ON b.sample_id = p.sample_id AND b.x = p.x AND b.y = p.y - 1
  LEFT JOIN px r ON r.sample_id = p.sample_id AND r.y = p.y AND r.x = p.x + 1 LEFT JOIN px l ON l.sample_id = p.sample_id AND l.y = p.y AND l.x = p.x - 1),
a AS (SELECT sample_id, y // 2 AS cy, x // 2 AS cx, sqrt(gx * gx + gy * gy) AS size, degrees(atan2(gy, gx)) AS deg FROM d),
o AS (SELECT sample_id, cy, cx, least(floor((deg - 180 * floor(deg / 180)) / 20), 8)::INT AS o, sum(size) / 4 AS v FROM a GROUP BY 1, 2, 3, 4),
f AS (
  SELECT s.sample_id, s.subject_id, b.k AS b, c.k AS c, o.k AS o, coalesce(v, 0.0) AS v FROM s CROSS JOIN range(0, 9) b(k) CROSS JOIN range(0, 4) c(k) CROSS JOIN range(0, 9) o(k)
  LEFT JOIN o h ON h.sample_id = s.sample_id AND h.cy = b.k // 3 + c.k // 2 AND h.cx = b.k % 3 + c.k % 2 AND h.o = o.k),
c AS (SELECT *, least(v / sqrt(sum(v * v) OVER w + 1e-10), 0.2) AS u FROM f WINDOW w AS (PARTITION BY sample_id, b))
{_OUT} (SELECT sample_id, subject_id, (b * 4 + c) * 9 + o AS i, u / sqrt(sum(u * u) OVER (PARTITION BY sample_id, b) + 1e-10) AS value FROM c)"""

#: The filters as weights from each pixel to each output pixel: mirrored borders, periodic ones if the kernel is larger than the image.
_GABOR = f"""WITH {_PX},
f AS (SELECT f, k, 0.2 * (f + 1) AS freq, pi() * k / 4 AS theta, sqrt(ln(2) / 2) / pi() * 3 / (0.2 * (f + 1)) AS sigma FROM range(0, 2) a(f), range(0, 4) b(k)),
n AS (SELECT *, ceil(greatest(abs(3 * sigma * cos(theta)), abs(3 * sigma * sin(theta)), 1))::INT AS n FROM f),
t AS (SELECT *, dx * cos(theta) + dy * sin(theta) AS turned FROM n, range(-9, 10) a(dy), range(-9, 10) b(dx) WHERE abs(dy) <= n AND abs(dx) <= n),
w AS (SELECT f, k, n, -dy AS dy, -dx AS dx, exp(-0.5 * (dx * dx + dy * dy) / (sigma * sigma)) / (2 * pi() * sigma * sigma) AS g, 2 * pi() * freq * turned AS phase FROM t),
m AS (
  SELECT f, k, y, x, CASE WHEN n > 8 THEN (y + dy + 16) % 8 WHEN y + dy < 0 THEN -1 - y - dy WHEN y + dy > 7 THEN 15 - y - dy ELSE y + dy END AS u,
         CASE WHEN n > 8 THEN (x + dx + 16) % 8 WHEN x + dx < 0 THEN -1 - x - dx WHEN x + dx > 7 THEN 15 - x - dx ELSE x + dx END AS v, sum(g * cos(phase)) AS re, sum(g * sin(phase)) AS im
  FROM w, range(0, 8) a(y), range(0, 8) b(x) GROUP BY ALL),
r AS (SELECT sample_id, any_value(subject_id) AS subject_id, f, k, m.y, m.x, sqrt(sum(z * re) ** 2 + sum(z * im) ** 2) AS size FROM m JOIN px ON px.y = m.u AND px.x = m.v GROUP BY sample_id, f, k, m.y, m.x)
{_OUT} (SELECT sample_id, any_value(subject_id) AS subject_id, ((f * 4 + k) * 2 + y // 4) * 2 + x // 4 AS i, avg(size) AS value FROM r GROUP BY sample_id, f, k, y // 4, x // 4)"""

_LEVELS = f"""{_PX},
lv AS MATERIALIZED (SELECT sample_id, subject_id, y, x, round_even(least(greatest(abs(z), 0), 1) * 255, 0)::INT AS l FROM px)"""
_TAN = f"""WITH {_LEVELS},
n AS (SELECT sample_id, l, count(*) AS n FROM lv GROUP BY 1, 2),
c AS (SELECT sample_id, l, sum(n) OVER (PARTITION BY sample_id ORDER BY l) - first_value(n) OVER (PARTITION BY sample_id ORDER BY l) AS cdf, 64 - first_value(n) OVER (PARTITION BY sample_id ORDER BY l) AS rest FROM n),
g AS MATERIALIZED (SELECT sample_id, subject_id, y, x, power((CASE WHEN rest = 0 THEN l ELSE least(greatest(round_even(cdf * (255.0::DOUBLE / rest), 0), 0), 255) END) / 255.0::DOUBLE, 0.2) AS g FROM lv JOIN c USING (sample_id, l)),
k AS (SELECT s, k, exp(-0.5 * (k / s) ** 2) / sum(exp(-0.5 * (k / s) ** 2)) OVER (PARTITION BY s) AS w FROM (SELECT s::DOUBLE AS s FROM range(1, 3) t(s)), range(-8, 9) u(k) WHERE abs(k) <= 4 * s),
m AS MATERIALIZED (SELECT s, y, CASE WHEN s = 2 THEN least(greatest(y + k, 0), 7) WHEN y + k < 0 THEN -y - k WHEN y + k > 7 THEN 14 - y - k ELSE y + k END AS u, sum(w) AS w FROM k, range(0, 8) t(y) GROUP BY ALL),
b AS (
  SELECT sample_id, any_value(subject_id) AS subject_id, a.y, b.y AS x, sum(CASE a.s WHEN 1 THEN 1 ELSE -1 END * a.w * b.w * g) AS d
  FROM m a JOIN m b ON a.s = b.s JOIN g ON g.y = a.u AND g.x = b.u GROUP BY sample_id, a.y, b.y),
t AS (SELECT *, max(abs(d)) OVER (PARTITION BY sample_id) AS top FROM b),
a AS (SELECT *, atan(CASE WHEN top > 1e-9 THEN d / top ELSE d END / 10) AS q FROM t),
v AS (SELECT *, avg(power(abs(q), 0.1)) OVER (PARTITION BY sample_id) AS mean FROM a)
{_OUT} (SELECT sample_id, subject_id, y * 8 + x AS i, 0.1 * tanh(CASE WHEN mean > 1e-9 THEN q / power(mean, 10) ELSE q END) AS value FROM v)"""

_CLAHE = f"""WITH {_LEVELS},
n AS (SELECT sample_id, y // 4 AS ty, x // 4 AS tx, l, count(*) AS n FROM lv GROUP BY 1, 2, 3, 4),
o AS (SELECT sample_id, ty, tx, sum(n - 1) AS rest FROM n GROUP BY 1, 2, 3),
h AS (
  SELECT o.sample_id, o.ty, o.tx, t.l, (n IS NOT NULL)::INT + (rest > 0 AND t.l % greatest(1, 256 // greatest(rest, 1)) = 0 AND t.l // greatest(1, 256 // greatest(rest, 1)) < rest)::INT AS n
  FROM o CROSS JOIN range(0, 256) t(l) LEFT JOIN n ON n.sample_id = o.sample_id AND n.ty = o.ty AND n.tx = o.tx AND n.l = t.l),
c AS MATERIALIZED (SELECT sample_id, ty, tx, l, least(greatest(round_even(sum(n) OVER (PARTITION BY sample_id, ty, tx ORDER BY l) * (255.0::DOUBLE / 16), 0), 0), 255) AS v FROM h),
f AS (SELECT *, y / 4.0::DOUBLE - 0.5 AS fy, x / 4.0::DOUBLE - 0.5 AS fx FROM lv),
w AS (
  SELECT f.sample_id, subject_id, y, x, sum(v * (CASE a WHEN 0 THEN 1 - fy + floor(fy) ELSE fy - floor(fy) END) * (CASE b WHEN 0 THEN 1 - fx + floor(fx) ELSE fx - floor(fx) END)) AS v
  FROM f CROSS JOIN range(0, 2) p(a) CROSS JOIN range(0, 2) q(b)
  JOIN c ON c.sample_id = f.sample_id AND c.l = f.l AND c.ty = least(greatest(floor(fy) + a, 0), 1) AND c.tx = least(greatest(floor(fx) + b, 0), 1) GROUP BY 1, 2, 3, 4)
{_OUT} (SELECT sample_id, subject_id, y * 8 + x AS i, round_even(v, 0) / 255 AS value FROM w)"""

#: In the plane, rotation and scale are one complex factor.
_UMEYAMA = f"""WITH {_PX},
p AS (SELECT sample_id, any_value(subject_id) AS subject_id, y, max(z) FILTER (x = 0) AS a, max(z) FILTER (x = 1) AS b, max(z) FILTER (x = 2) AS c, max(z) FILTER (x = 3) AS d FROM px WHERE y < 5 GROUP BY sample_id, y),
m AS (SELECT *, a - avg(a) OVER w AS p, b - avg(b) OVER w AS q, avg(c) OVER w AS mc, avg(d) OVER w AS md FROM p WINDOW w AS (PARTITION BY sample_id)),
f AS (SELECT sample_id, sum(p * (c - mc) + q * (d - md)) / sum(p * p + q * q) AS re, sum(p * (d - md) - q * (c - mc)) / sum(p * p + q * q) AS im FROM m GROUP BY sample_id),
r AS (SELECT sample_id, subject_id, y, re * p - im * q + mc AS u, im * p + re * q + md AS v FROM m JOIN f USING (sample_id))
{_OUT} (SELECT sample_id, subject_id, 2 * y AS i, u AS value FROM r UNION ALL SELECT sample_id, subject_id, 2 * y + 1, v FROM r)"""

_RASTER = f"""WITH {_PX},
v AS (SELECT sample_id, y, max(z) FILTER (x = 0) * 8 + 4 AS vx, max(z) FILTER (x = 1) * 8 + 4 AS vy, max(z) FILTER (x = 2) AS vz FROM px WHERE y < 6 GROUP BY sample_id, y),
t AS (
  SELECT a.sample_id, a.y // 3 AS t, a.vx AS ax, a.vy AS ay, a.vz AS az, b.vx AS bx, b.vy AS yb, b.vz AS bz, c.vx AS cx, c.vy AS cy, c.vz AS cz
  FROM v a JOIN v b ON b.sample_id = a.sample_id AND b.y = a.y + 1 JOIN v c ON c.sample_id = a.sample_id AND c.y = a.y + 2 WHERE a.y % 3 = 0),
w AS (SELECT *, (yb - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS area FROM t),
q AS (SELECT w.*, gy, gx, ((yb - cy) * (gx - cx) + (cx - bx) * (gy - cy)) / area AS wa, ((cy - ay) * (gx - cx) + (ax - cx) * (gy - cy)) / area AS wb FROM w, range(0, 8) p(gy), range(0, 8) q(gx) WHERE abs(area) >= 1e-12),
i AS (SELECT sample_id, gy, gx, arg_max(wa * az + wb * bz + (1 - wa - wb) * cz, t) AS z FROM q WHERE wa >= -1e-9 AND wb >= -1e-9 AND wa + wb <= 1 + 1e-9 GROUP BY 1, 2, 3)
{_OUT} (SELECT px.sample_id, subject_id, y * 8 + x AS i, coalesce(i.z, 0.0) AS value FROM px LEFT JOIN i ON i.sample_id = px.sample_id AND gy = y AND gx = x)"""

_RANGE = f"""WITH {_PX},
g AS (SELECT k, k * 7.0::DOUBLE / 15 AS at, least(floor(k * 7.0::DOUBLE / 15), 6)::INT AS lo FROM range(0, 16) t(k)),
r AS (
  SELECT px.sample_id, any_value(subject_id) AS subject_id, a.k AS y, b.k AS x,
         sum(z * (CASE WHEN px.y = a.lo THEN 1 - a.at + a.lo ELSE a.at - a.lo END) * (CASE WHEN px.x = b.lo THEN 1 - b.at + b.lo ELSE b.at - b.lo END)) AS z
  FROM g a, g b, px WHERE px.y IN (a.lo, a.lo + 1) AND px.x IN (b.lo, b.lo + 1) GROUP BY px.sample_id, a.k, b.k),
m AS (SELECT sample_id, quantile_cont(z, 0.5) AS mid, stddev_pop(z) AS sd FROM r GROUP BY sample_id)
{_OUT} (SELECT sample_id, subject_id, y * 16 + x AS i, (z - mid) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS value FROM r JOIN m USING (sample_id))"""

_CLOUD = f"""WITH {_PX},
p AS (SELECT sample_id, subject_id, e[3 * k + 1]::DOUBLE AS a, e[3 * k + 2]::DOUBLE AS b, e[3 * k + 3]::DOUBLE AS c FROM s, range(0, 21) t(k)),
m AS (
  SELECT sample_id, quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb,
         0.85 * greatest(1e-4, quantile_cont(a, 0.95) - quantile_cont(a, 0.05), quantile_cont(b, 0.95) - quantile_cont(b, 0.05)) AS reach FROM p GROUP BY sample_id),
k AS (
  SELECT sample_id, least(greatest(round_even((b - mb + reach) / (2 * reach) * 7, 0), 0), 7)::INT AS ky, least(greatest(round_even((a - ma + reach) / (2 * reach) * 7, 0), 0), 7)::INT AS kx, avg(c) AS z
  FROM p JOIN m USING (sample_id) GROUP BY 1, 2, 3)
{_OUT} (
  SELECT px.sample_id, any_value(subject_id) AS subject_id, y * 8 + x AS i, arg_min(k.z, ((y - ky) * (y - ky) + (x - kx) * (x - kx)) * 64 + ky * 8 + kx) AS value
  FROM px JOIN k ON k.sample_id = px.sample_id GROUP BY px.sample_id, y, x)"""


def deviate(p: str) -> str:
    """Normal quantile by the same published approximation: fixed values."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
    poly = lambda k, x: " + ".join(f"{v!r}::DOUBLE * power({x}, {len(k) - 1 - i})" for i, v in enumerate(k))
    p = f"least(greatest({p}, 1e-5::DOUBLE), 1 - 1e-5::DOUBLE)"
    t, u, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    tail = lambda x: f"({poly(c, x)}) / ({poly(d, x)})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(t)} WHEN {p} > 1 - 0.02425 THEN -({tail(u)}) ELSE {q} * ({poly(a, f'({q} * {q})')}) / ({poly(b, f'({q} * {q})')}) END"


KERNELS = {
    "lbp": _patterns(), "hog": _HOG, "gabor": _GABOR, "tantriggs": _TAN, "clahe": _CLAHE, "umeyama": _UMEYAMA, "rasterize": _RASTER, "range_image": _RANGE, "cloud_to_depth": _CLOUD,
}
