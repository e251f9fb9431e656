"""Boxes, lines, quadrilaterals and fitted plane transforms as column expressions.

A box is [left, top, right, bottom] with its edges included; a line is a pair of points of plain numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import signed_distance
from tessera.plans.session import table

Box = list[Column]
Point = tuple[float, float]


def centred(x: Column, y: Column, width: Column, height: Column) -> Box:
    """The box of a size around a point; the odd place goes right and down."""
    left, top = x - (width / 2).cast("long"), y - (height / 2).cast("long")
    return [left, top, left + width - 1, top + height - 1]


def middle(box: Box) -> list[Column]:
    """The centre on whole places, rounded up at halves."""
    return [F.floor((box[0] + box[2] + 1) / 2), F.floor((box[1] + box[3] + 1) / 2)]


def grown(box: Box, across: int, down: int) -> Box:
    """Wider and higher at every edge; negative numbers shrink."""
    return [box[0] - across, box[1] - down, box[2] + across, box[3] + down]


def scaled(box: Box, factor: float) -> Box:
    """All edges times a factor, to the nearest place, halves away from zero."""
    return [F.round(c * F.lit(float(factor))).cast("long") for c in box]


def moved(box: Box, across: Column | int, down: Column | int) -> Box:
    return [box[0] + across, box[1] + down, box[2] + across, box[3] + down]


def area(box: Box) -> Column:
    """Places in a box; 0 for an empty one."""
    return F.greatest(box[2] - box[0] + 1, F.lit(0)) * F.greatest(box[3] - box[1] + 1, F.lit(0))


def with_aspect(box: Box, ratio: float) -> Box:
    """The box of about the same area and centre whose width is `ratio` times its height; the shorter side is rounded first."""
    if ratio <= 0:
        raise ValueError("the ratio is positive")
    long_side = max(ratio, 1 / ratio)
    short = F.floor(F.sqrt(area(box) / F.lit(long_side)) + 0.5)
    other = F.floor(short * F.lit(long_side) + 0.5)
    size = (other, short) if ratio >= 1 else (short, other)
    return centred(((box[0] + box[2]) / 2).cast("long"), ((box[1] + box[3]) / 2).cast("long"), *size)


def nearest_point(box: Box, x: Column, y: Column) -> list[Column]:
    """The place of a box nearest to a point, the point itself inside."""
    return [F.greatest(F.least(x, box[2]), box[0]), F.greatest(F.least(y, box[3]), box[1])]


def edge_distance(box: Box, x: Column, y: Column) -> Column:
    """Steps along the axes from a point to the edge of a box."""
    dx, dy = F.least(F.abs(x - box[0]), F.abs(x - box[2])), F.least(F.abs(y - box[1]), F.abs(y - box[3]))
    across, down = x.between(box[0], box[2]), y.between(box[1], box[3])
    return F.when(across & down, F.least(dx, dy)).when(across, dy).when(down, dx).otherwise(dx + dy)


def nearest_box(boxes: list[tuple[int, int, int, int]], x: Column, y: Column) -> Column:
    """Number of the listed box nearest to a point, the first at ties; boxes that hold the point are at distance 0."""

    def away(box: tuple[int, int, int, int]) -> Column:
        px, py = nearest_point([F.lit(v) for v in box], x, y)
        return ((px - x) * (px - x) + (py - y) * (py - y)).cast("double")

    return F.array_min(F.array(*[F.struct(away(b).alias("d"), F.lit(i).alias("i")) for i, b in enumerate(boxes)]))["i"]


def crossing(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> list[Column]:
    """Where the line through a and b meets that through c and d; infinite for parallel lines."""
    ab, cd = [b[0] - a[0], b[1] - a[1]], [d[0] - c[0], d[1] - c[1]]
    along = F.try_divide((c[0] - a[0]) * cd[1] - (c[1] - a[1]) * cd[0], ab[0] * cd[1] - ab[1] * cd[0])
    return [F.coalesce(a[k] + along * ab[k], F.lit(float("inf"))) for k in (0, 1)]


def convex(corners: list[list[Column]]) -> Column:
    """Whether four corners in order turn the same way at each; infinite corners never do."""

    def turn(i: int) -> Column:
        at, to, back = corners[i], corners[(i + 1) % 4], corners[(i + 3) % 4]
        return F.signum((to[0] - at[0]) * (back[1] - at[1]) - (to[1] - at[1]) * (back[0] - at[0]))

    total = turn(0) + turn(1) + turn(2) + turn(3)
    finite = [F.abs(v) < float("inf") for c in corners for v in c]
    whole = finite[0]
    for f in finite[1:]:
        whole = whole & f
    return whole & (F.abs(total) == 4)


def beyond(line: tuple[Point, Point], reference: Point, x: Column, y: Column) -> Column:
    """Distance of a point to a line, positive on the reference point's side."""
    (ax, ay), (bx, by) = line
    left = (bx - ax) * (reference[1] - ay) - (by - ay) * (reference[0] - ax)
    away = signed_distance(F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by), x, y)
    return -away if left < 0 else away


def side_counts(points: DataFrame, by: list[str], x: str, y: str, lines: list[tuple[Point, Point]], reference: Point, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Points whose distance from the first line lies in [low, high] on the reference's side, and those strictly on its side of all lines."""
    away = [beyond(line, reference, F.col(x), F.col(y)) for line in lines]
    between = away[0] > 0
    for a in away[1:]:
        between = between & (a > 0)
    return points.groupBy(*by).agg(F.count_if((away[0] >= low) & (away[0] <= high)).alias("on_side"), F.count_if(between).alias("between"))


def _moments(df: DataFrame, by: list[str], x: str, y: str, u: str, v: str) -> DataFrame:
    """Means and covariances that plane fits need: one mergeable aggregation."""
    pairs = [(x, x), (x, y), (y, y), (u, x), (u, y), (v, x), (v, y)]
    names = ["xx", "xy", "yy", "ux", "uy", "vx", "vy"]
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"m{k}") for k, c in zip("xyuv", (x, y, u, v), strict=True)], *[F.covar_pop(a, b).alias(n) for (a, b), n in zip(pairs, names, strict=True)])


def affine_fit(df: DataFrame, by: list[str], x: str, y: str, u: str, v: str, digits: int = 5) -> DataFrame:
    """(a, b, c, d, tx, ty) with u = a x + b y + tx and v = c x + d y + ty by least squares a group; null where the points lie on a line."""
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")

    def solved(p: str) -> tuple[Column, Column]:
        px, py = F.col(f"{p}x"), F.col(f"{p}y")
        return F.try_divide(px * F.col("yy") - py * F.col("xy"), det), F.try_divide(py * F.col("xx") - px * F.col("xy"), det)

    (a, b), (c, d) = solved("u"), solved("v")
    tx, ty = F.col("mu") - a * F.col("mx") - b * F.col("my"), F.col("mv") - c * F.col("mx") - d * F.col("my")
    return _moments(df, by, x, y, u, v).select(*by, *[(F.round(e, digits) + 0.0).alias(n) for e, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"), (tx, "tx"), (ty, "ty"))])


def similarity_fit(df: DataFrame, by: list[str], x: str, y: str, u: str, v: str, digits: int = 5) -> DataFrame:
    """(a, b, tx, ty) with u = a x - b y + tx and v = b x + a y + ty by least squares a group: a turn, a scale and a shift."""
    size = F.col("xx") + F.col("yy")
    a, b = F.try_divide(F.col("ux") + F.col("vy"), size), F.try_divide(F.col("vx") - F.col("uy"), size)
    tx, ty = F.col("mu") - a * F.col("mx") + b * F.col("my"), F.col("mv") - b * F.col("mx") - a * F.col("my")
    return _moments(df, by, x, y, u, v).select(*by, *[(F.round(e, digits) + 0.0).alias(n) for e, n in ((a, "a"), (b, "b"), (tx, "tx"), (ty, "ty"))])


_THREE = [(0, 0, 9, 9), (5, 5, 30, 20), (25, 0, 45, 60)]


def _parts(s, d):
    """A box a part."""
    k = (F.col("p_partkey") % 40).cast("long")
    return table(s, d, "part").select("p_partkey", k.alias("k"), F.col("p_size").cast("long").alias("z"))


def _box() -> Box:
    k, z = F.col("k"), F.col("z")
    return [k, k + 1, k + z, k + 20]


def _edits(s, d):
    box = _box()
    made = {"grown": grown(box, 2, 3), "scaled": scaled(box, 1.5), "moved": moved(box, F.col("z"), -4), "wide": with_aspect(box, 2.0), "tall": with_aspect(box, 0.5)}
    mid = middle(box)
    return _parts(s, d).select("p_partkey", mid[0].alias("mid_x"), mid[1].alias("mid_y"), *[c.alias(f"{n}_{e}") for n, b in made.items() for c, e in zip(b, "ltrb", strict=True)])


def _near(s, d):
    x, y = F.col("z"), F.col("k")
    px, py = nearest_point([F.lit(10), F.lit(12), F.lit(30), F.lit(22)], x, y)
    return _parts(s, d).select("p_partkey", px.cast("long").alias("px"), py.cast("long").alias("py"), edge_distance([F.lit(10), F.lit(12), F.lit(30), F.lit(22)], x, y).cast("long").alias("steps"), nearest_box(_THREE, x, y).cast("long").alias("box"))


def _crossings(s, d):
    k, z = F.col("k").cast("double"), F.col("z").cast("double")
    at = crossing([k, z], [k + 3, z + 1], [F.lit(0.0), F.lit(1.0)], [z, k + 2])
    corners = [[F.lit(0.0), F.lit(0.0)], [k, F.lit(1.0)], [z, k], [F.lit(2.0), z]]
    return _parts(s, d).select("p_partkey", (F.round(at[0], 5) + 0.0).alias("x"), (F.round(at[1], 5) + 0.0).alias("y"), convex(corners).alias("convex"))


def _plane(s, d):
    return table(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("u"), (F.col("l_tax") * 100).alias("v"))


QUERIES = {
    "box_edits": _edits,
    "box_points": _near,
    "line_crossings": _crossings,
    "line_sides": lambda s, d: side_counts(_plane(s, d), ["l_returnflag"], "x", "u", [((0.0, 0.5), (50.0, 40.5)), ((0.0, 60.5), (50.0, 80.5))], (20.0, 45.0), 2.0, 30.0),
    "affine_fit": lambda s, d: affine_fit(_plane(s, d), ["l_returnflag"], "x", "y", "u", "v", 4),
    "similarity_fit": lambda s, d: similarity_fit(_plane(s, d), ["l_returnflag"], "x", "y", "u", "v", 4),
}

_PART = "b AS (SELECT p_partkey, (p_partkey % 40)::BIGINT AS k, p_size::BIGINT AS z FROM part)"
_PLANE = "p AS (SELECT l_returnflag, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS u, l_tax * 100 AS v FROM lineitem)"
_FIT = f"""{_PLANE}, m AS (SELECT l_returnflag, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy,
  covar_pop(u, x) AS ux, covar_pop(u, y) AS uy, covar_pop(v, x) AS vx, covar_pop(v, y) AS vy FROM p GROUP BY 1)"""


def _away(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"(({x1 - x0}::DOUBLE) * (u - {y0}::DOUBLE) - ({y1 - y0}::DOUBLE) * (x - {x0}::DOUBLE)) / sqrt({x1 - x0}::DOUBLE * {x1 - x0} + {y1 - y0}::DOUBLE * {y1 - y0})"


ORACLES = {
    "box_edits": f"""WITH {_PART}, a AS (SELECT *, (z + 1) * 20 AS area, trunc((k + k + z) / 2)::BIGINT AS cx, trunc((k + 1 + k + 20) / 2)::BIGINT AS cy FROM b),
c AS (SELECT *, floor(sqrt(area / 2.0::DOUBLE) + 0.5)::BIGINT AS h, floor(floor(sqrt(area / 2.0::DOUBLE) + 0.5) * 2 + 0.5)::BIGINT AS w FROM a)
SELECT p_partkey, floor((k + k + z + 1) / 2)::BIGINT AS mid_x, floor((k + 1 + k + 20 + 1) / 2)::BIGINT AS mid_y,
  k - 2 AS grown_l, k + 1 - 3 AS grown_t, k + z + 2 AS grown_r, k + 20 + 3 AS grown_b,
  round(k * 1.5::DOUBLE)::BIGINT AS scaled_l, round((k + 1) * 1.5::DOUBLE)::BIGINT AS scaled_t, round((k + z) * 1.5::DOUBLE)::BIGINT AS scaled_r, round((k + 20) * 1.5::DOUBLE)::BIGINT AS scaled_b,
  k + z AS moved_l, k + 1 - 4 AS moved_t, k + z + z AS moved_r, k + 20 - 4 AS moved_b,
  cx - w // 2 AS wide_l, cy - h // 2 AS wide_t, cx - w // 2 + w - 1 AS wide_r, cy - h // 2 + h - 1 AS wide_b,
  cx - h // 2 AS tall_l, cy - w // 2 AS tall_t, cx - h // 2 + h - 1 AS tall_r, cy - w // 2 + w - 1 AS tall_b FROM c""",
    "box_points": f"""WITH {_PART}, q AS (SELECT p_partkey, z AS x, k AS y FROM b),
e AS (SELECT *, greatest(10 - x, x - 30, 0) AS ox, greatest(12 - y, y - 22, 0) AS oy, least(abs(x - 10), abs(x - 30)) AS dx, least(abs(y - 12), abs(y - 22)) AS dy,
  pow(greatest(x - 9, 0 - x, 0), 2) + pow(greatest(y - 9, 0 - y, 0), 2) AS d0, pow(greatest(x - 30, 5 - x, 0), 2) + pow(greatest(y - 20, 5 - y, 0), 2) AS d1, pow(greatest(x - 45, 25 - x, 0), 2) + pow(greatest(y - 60, 0 - y, 0), 2) AS d2 FROM q)
SELECT p_partkey, greatest(least(x, 30), 10)::BIGINT AS px, greatest(least(y, 22), 12)::BIGINT AS py,
  (CASE WHEN ox = 0 AND oy = 0 THEN least(dx, dy) WHEN ox = 0 THEN dy WHEN oy = 0 THEN dx ELSE dx + dy END)::BIGINT AS steps,
  (CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END)::BIGINT AS box FROM e""",
    "line_crossings": f"""WITH {_PART}, l AS (SELECT p_partkey, k::DOUBLE AS k, z::DOUBLE AS z FROM b),
n AS (SELECT *, 3 * (k + 1) - z AS det, (0 - k) * (k + 1) - (1 - z) * z AS num FROM l),
t AS (SELECT *, sign(k * z - 1 * 2) AS t0, sign((z - k) * (0 - 1) - (k - 1) * (0 - k)) AS t1, sign((2 - z) * (1 - k) - (z - k) * (k - z)) AS t2, sign((0 - 2) * (k - z) - (0 - z) * (z - 2)) AS t3 FROM n)
SELECT p_partkey, CASE WHEN det = 0 THEN 'inf'::DOUBLE ELSE round(k + 3 * num / det, 5) + 0.0::DOUBLE END AS x, CASE WHEN det = 0 THEN 'inf'::DOUBLE ELSE round(z + num / det, 5) + 0.0::DOUBLE END AS y, abs(t0 + t1 + t2 + t3) = 4 AS convex FROM t""",
    "line_sides": f"""WITH {_PLANE}, e AS (SELECT l_returnflag, {_away(0.0, 0.5, 50.0, 40.5)} AS a, -({_away(0.0, 60.5, 50.0, 80.5)}) AS b FROM p)
SELECT l_returnflag, count(*) FILTER (a BETWEEN 2 AND 30) AS on_side, count(*) FILTER (a > 0 AND b > 0) AS between FROM e GROUP BY 1""",
    "affine_fit": f"""WITH {_FIT}, f AS (SELECT *, (ux * yy - uy * xy) / (xx * yy - xy * xy) AS a, (uy * xx - ux * xy) / (xx * yy - xy * xy) AS b, (vx * yy - vy * xy) / (xx * yy - xy * xy) AS c, (vy * xx - vx * xy) / (xx * yy - xy * xy) AS d FROM m)
SELECT l_returnflag, round(a, 4) + 0.0::DOUBLE AS a, round(b, 4) + 0.0::DOUBLE AS b, round(c, 4) + 0.0::DOUBLE AS c, round(d, 4) + 0.0::DOUBLE AS d, round(mu - a * mx - b * my, 4) + 0.0::DOUBLE AS tx, round(mv - c * mx - d * my, 4) + 0.0::DOUBLE AS ty FROM f""",
    "similarity_fit": f"""WITH {_FIT}, f AS (SELECT *, (ux + vy) / (xx + yy) AS a, (vx - uy) / (xx + yy) AS b FROM m)
SELECT l_returnflag, round(a, 4) + 0.0::DOUBLE AS a, round(b, 4) + 0.0::DOUBLE AS b, round(mu - a * mx + b * my, 4) + 0.0::DOUBLE AS tx, round(mv - b * mx - a * my, 4) + 0.0::DOUBLE AS ty FROM f""",
}
