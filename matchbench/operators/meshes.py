"""Meshes and depth maps with gaps as pixel tables (sample_id, y, x, z): interpolation inside faces, resampling and nearest
fill. Everything is column expressions; a task holds one line of one picture at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fields

#: Share of a corner below which a cell is outside a face; area below which a face has no plane; known share of a cell below which it is a gap.
OUTSIDE, FLAT, KNOWN = -1e-9, 1e-12, 1e-3


def _cells(lo: Column, hi: Column, size: int) -> Column:
    first, last = F.greatest(F.ceil(lo), F.lit(0)).cast("int"), F.least(F.floor(hi), F.lit(size - 1)).cast("int")
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def interpolate(vertices: DataFrame, faces: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """Depths on a size x size grid over [low, high] in both directions, from vertices (sample_id, vertex, px, py, pz) and
    faces (sample_id, face, a, b, c): linear inside faces, null outside of all. Of faces over a cell the last one counts.
    Faces without an area and those with an unknown vertex are left out; a sample without vertices has no grid.

    A face makes rows only for cells within its bounds, so rows grow with the faces' areas in cells and no face meets another.
    """
    scale = (size - 1) / (high - low)
    at = lambda c: (F.col(c) - F.lit(low)) * F.lit(scale)
    v = vertices.select("sample_id", "vertex", at("px").alias("u"), at("py").alias("v"), F.col("pz").cast("double").alias("w"))
    corners = faces.select("sample_id", "face", F.posexplode(F.array("a", "b", "c")).alias("corner", "vertex")).join(v, ["sample_id", "vertex"])
    pick = lambda c, k: F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}")
    t = corners.groupBy("sample_id", "face").agg(*[pick(c, k) for c in "uvw" for k in range(3)])
    u, q, w = ([F.col(f"{c}{k}") for k in range(3)] for c in "uvw")
    area = (q[1] - q[2]) * (u[0] - u[2]) + (u[2] - u[1]) * (q[0] - q[2])
    t = t.withColumn("area", area).where(F.abs("area") >= FLAT)  # a null area (unknown vertex) goes as well
    t = t.withColumn("y", _cells(F.least(*q), F.greatest(*q), size)).withColumn("x", _cells(F.least(*u), F.greatest(*u), size))
    a = ((q[1] - q[2]) * (F.col("x") - u[2]) + (u[2] - u[1]) * (F.col("y") - q[2])) / F.col("area")
    b = ((q[2] - q[0]) * (F.col("x") - u[2]) + (u[0] - u[2]) * (F.col("y") - q[2])) / F.col("area")
    t = t.select("sample_id", "face", "y", "x", a.alias("sa"), b.alias("sb"), *[f"w{k}" for k in range(3)])
    c = 1 - F.col("sa") - F.col("sb")
    t = t.where((F.col("sa") >= OUTSIDE) & (F.col("sb") >= OUTSIDE) & (c >= OUTSIDE))
    z = F.col("sa") * w[0] + F.col("sb") * w[1] + c * w[2]
    z = t.groupBy("sample_id", "y", "x").agg(F.max_by(z, "face").alias("z"))
    line = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = vertices.select("sample_id").distinct().withColumn("y", line).withColumn("x", line)
    return grid.join(z, ["sample_id", "y", "x"], "left")


def fill_nearest(grid: DataFrame) -> DataFrame:
    """Gaps (null or NaN) get the value of the nearest known cell of their picture; of equally near ones the first in order
    of y, then x. A picture without a known cell stays as it is (null).

    Each column tells its nearest known cells above and below; the nearest of all is among the columns' nearest, so a gap
    looks at one cell for each column of its picture instead of all known cells.
    """
    z = F.when(~F.isnan("z"), F.col("z"))
    down = Window.partitionBy("sample_id", "x").orderBy("y")
    known = F.when(z.isNotNull(), F.struct(F.col("y").alias("sy"), z.alias("sz")))
    g = grid.withColumn("_k", known)
    g = g.withColumn("_a", F.last("_k", True).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_k", True).over(down.rowsBetween(0, Window.unboundedFollowing)))
    above = F.col("_b").isNull() | (F.col("y") - F.col("_a.sy") <= F.col("_b.sy") - F.col("y"))
    own = F.when(F.col("_a").isNotNull() & above, F.col("_a")).otherwise(F.col("_b"))
    g = g.withColumn("_n", own)
    far = F.col("y") - F.col("_n.sy")
    candidate = F.when(F.col("_n").isNotNull(), F.struct((far * far).alias("d"), F.col("_n.sy").alias("sy"), F.col("x").alias("sx"), F.col("_n.sz").alias("sz")))
    g = g.withColumn("_c", F.collect_list(candidate).over(Window.partitionBy("sample_id", "y")))

    def seen(c: Column) -> Column:
        off = c["sx"] - F.col("x")
        return F.struct((c["d"] + off * off).alias("d"), c["sy"].alias("sy"), c["sx"].alias("sx"), c["sz"].alias("sz"))

    nearest = F.array_min(F.transform("_c", seen))["sz"]
    return g.select("sample_id", "y", "x", F.when(F.col("_k").isNotNull(), F.col("_k.sz")).otherwise(nearest).alias("z"))


def _targets(at: str, n: int, size: int) -> tuple[Column, Column]:
    """The places of a line of ``size`` cells that a cell of a line of ``n`` adds to, and the weight there."""
    if n == 1 or size == 1:
        only = F.sequence(F.lit(0), F.lit(size - 1))
        return F.explode(only if n == 1 else F.when(F.col(at) == 0, only)), F.lit(1.0)
    step = (n - 1) / (size - 1)
    lo = F.greatest(F.floor((F.col(at) - 1) / F.lit(step)), F.lit(0)).cast("int")
    hi = F.least(F.ceil((F.col(at) + 1) / F.lit(step)), F.lit(size - 1)).cast("int")
    return F.explode(F.sequence(lo, hi)), F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"t{at}") * F.lit(step) - F.col(at)))


def resample(grid: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Whole grids (every pixel a row, gaps null or NaN) at size x size, linearly between pixels; gaps don't count, and a
    cell of which under a thousandth is known is a gap (null). A pixel is sent to the cells that it touches; there is no join."""
    z = F.when(~F.isnan("z"), F.col("z"))
    rows, wy = _targets("y", height, size)
    columns, wx = _targets("x", width, size)
    t = grid.select("sample_id", "y", "x", z.alias("z")).withColumn("ty", rows).withColumn("wy", wy).where("wy > 0").withColumn("tx", columns).withColumn("wx", wx).where("wx > 0")
    w = F.col("wy") * F.col("wx")
    s = t.groupBy("sample_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.when(F.col("z").isNotNull(), w).otherwise(0.0)).alias("w"), F.sum(w * F.col("z")).alias("s"))
    return s.select("sample_id", "y", "x", F.when(F.col("w") > KNOWN, F.col("s") / F.col("w")).alias("z"))


def range_image(grid: DataFrame, height: int, width: int, size: int = 64, kind: str = "std") -> DataFrame:
    """Depth maps resampled, filled, centred and scaled; zeros for one without a known pixel."""
    z = fields.normalise_range(fill_nearest(resample(grid, height, width, size)), kind)
    return z.select("sample_id", "y", "x", F.coalesce("z", F.lit(0.0)).alias("z"))


def mesh_to_depth(vertices: DataFrame, faces: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """``interpolate``, cells outside the mesh filled with the nearest one inside."""
    return fill_nearest(interpolate(vertices, faces, size, low, high))
