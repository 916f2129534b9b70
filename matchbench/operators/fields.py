"""Pixel-grid operators in long form (sample_id, y, x, z): gradients, normals, curvature, equalisation,
normalisation, occlusion, block means, histograms. A grid is a partition, so windows never cross images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BROADCAST_ROWS
from . import numbering


def to_grid(images: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """Row-major arrays as pixels."""
    x = images.select("sample_id", F.posexplode(F.col(vector).cast("array<double>")).alias("i", "z"))
    return x.select("sample_id", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "z")


def derivative(z: str, along: str) -> Column:
    """Central differences, one-sided at the borders."""
    other = "y" if along == "x" else "x"
    w = Window.partitionBy("sample_id", other).orderBy(along)
    last, next_ = F.lag(z).over(w), F.lead(z).over(w)
    return F.when(last.isNull(), next_ - F.col(z)).when(next_.isNull(), F.col(z) - last).otherwise((next_ - last) / 2)


def gradient(grid: DataFrame) -> DataFrame:
    return grid.withColumn("zx", derivative("z", "x")).withColumn("zy", derivative("z", "y"))


def normals(grid: DataFrame) -> DataFrame:
    g = gradient(grid)
    n = F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy") + 1)
    return g.select("sample_id", "y", "x", (-F.col("zx") / n).alias("nx"), (-F.col("zy") / n).alias("ny"), (1 / n).alias("nz"))


def curvature(grid: DataFrame) -> DataFrame:
    """Mean and Gaussian curvature of the surface z(x, y), and the shape index: 2/pi times the angle of the
    principal curvatures' sum over their difference."""
    g = gradient(grid)
    g = g.withColumn("zxx", derivative("zx", "x")).withColumn("zxy", derivative("zx", "y")).withColumn("zyy", derivative("zy", "y"))
    zx, zy, zxx, zxy, zyy = (F.col(c) for c in ("zx", "zy", "zxx", "zxy", "zyy"))
    q = 1 + zx * zx + zy * zy
    h = ((1 + zx * zx) * zyy - 2 * zx * zy * zxy + (1 + zy * zy) * zxx) / (2 * q * F.sqrt(q))
    k = (zxx * zyy - zxy * zxy) / (q * q)
    g = g.withColumn("h", h).withColumn("k", k)
    root = F.sqrt(F.greatest(F.col("h") * F.col("h") - F.col("k"), F.lit(0.0)))
    return g.select("sample_id", "y", "x", "h", "k", (F.atan2(2 * F.col("h"), 2 * root + 1e-12) * F.lit(2 / 3.141592653589793)).alias("shape_index"))


def curvature_histogram(values: DataFrame, bins: int = 16) -> DataFrame:
    """Rows (sample_id, bin, share): the sample's values within its own 1st to 99th percentile (a range of
    1 from there if the two are equal)."""
    ends = values.groupBy("sample_id").agg(F.percentile("z", F.lit(0.01)).alias("lo"), F.percentile("z", F.lit(0.99)).alias("hi"))
    ends = ends.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    x = values.join(ends, "sample_id").where("z >= lo and z <= hi")
    b = F.least(F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    c = x.groupBy("sample_id", b.alias("bin")).agg(F.count("*").alias("n"))
    return c.select("sample_id", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))).alias("share"))


def normalise_range(grid: DataFrame, kind: str = "std") -> DataFrame:
    """Depth less its median, over the population deviation (``std``) or the 5 to 95 percentile span."""
    a = grid.groupBy("sample_id").agg(
        F.percentile("z", F.lit(0.5)).alias("mid"), F.stddev_pop("z").alias("sd"), (F.percentile("z", F.lit(0.95)) - F.percentile("z", F.lit(0.05))).alias("span")
    )
    by = {"std": F.col("sd"), "p5p95": F.col("span")}[kind]
    return grid.join(a, "sample_id").select("sample_id", "y", "x", F.coalesce((F.col("z") - F.col("mid")) / F.nullif(by, F.lit(0.0)), F.lit(0.0)).alias("z"))


def equalise(grid: DataFrame, levels: int = 256) -> DataFrame:
    """Histogram equalisation of brightness in [0, 1]: the cumulative share of levels, counted from the
    least level's pixels on and rounded to a level."""
    q = grid.withColumn("level", F.least(F.greatest(F.bround(F.col("z") * (levels - 1)), F.lit(0)), F.lit(levels - 1)).cast("int"))
    n = q.groupBy("sample_id", "level").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample_id").orderBy("level")
    n = n.withColumn("cdf", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("sample_id"))).withColumn("lo", F.first("n").over(w))
    n = n.select("sample_id", "level", F.coalesce(F.bround((F.col("cdf") - F.col("lo")) * ((levels - 1) / F.nullif(F.col("all") - F.col("lo"), F.lit(0)))) / (levels - 1), F.col("level") / (levels - 1)).alias("z"))
    return q.drop("z").join(n, ["sample_id", "level"]).select("sample_id", "y", "x", "z")


def occlude(grid: DataFrame, top: Column, left: Column, height: int, width: int) -> DataFrame:
    """A box of each image set to the image's median."""
    m = grid.groupBy("sample_id").agg(F.percentile("z", F.lit(0.5)).alias("mid"))
    inside = (F.col("y") >= top) & (F.col("y") < top + height) & (F.col("x") >= left) & (F.col("x") < left + width)
    return grid.join(m, "sample_id").select("sample_id", "y", "x", F.when(inside, F.col("mid")).otherwise(F.col("z")).alias("z"))


def sunglasses(height: int, width: int) -> tuple[int, int, int, int]:
    """Top, left, height and width of the eye region, at fixed fractions of the image."""
    top, left = int(height * 0.28), int(width * 0.08)
    return top, left, int(height * 0.48) - top, int(width * 0.92) - left


def block_size(height: int, width: int, share: float) -> tuple[int, int]:
    """Height and width of a block that covers a share of the image."""
    area = max(1, int(height * width * min(max(share, 0.01), 0.95)))
    h = max(1, int(area**0.5))
    return h, max(1, area // h)


def block_mean(grid: DataFrame, factor: int) -> DataFrame:
    return grid.groupBy("sample_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("z").alias("z"))


def landmark_distances(points: DataFrame) -> DataFrame:
    """Rows (sample_id, i, j, d), i before j, from (sample_id, i, px, py, pz): distances over that of points
    0 and 1 (1 if it is 0)."""
    a = points.select("sample_id", "i", *[F.col(c).alias(f"a{c}") for c in ("px", "py", "pz")])
    b = points.select("sample_id", F.col("i").alias("j"), *[F.col(c).alias(f"b{c}") for c in ("px", "py", "pz")])
    d = sum((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in ("px", "py", "pz"))
    x = a.join(b, "sample_id").where("i < j").withColumn("d", F.sqrt(d))
    unit = F.max(F.when((F.col("i") == 0) & (F.col("j") == 1), F.col("d"))).over(Window.partitionBy("sample_id"))
    return x.withColumn("u", unit).select("sample_id", "i", "j", (F.col("d") / F.when(F.col("u") > 0, F.col("u")).otherwise(1.0)).alias("d"))


def landmark_box(points: DataFrame, margin: float = 0.35) -> DataFrame:
    """A square box around (sample_id, px, py): the larger extent widened by ``margin`` in all, whole pixels."""
    a = points.groupBy("sample_id").agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 * (1 + margin)
    a = a.withColumn("half", half)
    corner = lambda lo, hi: ((F.col(lo) + F.col(hi)) / 2 - F.col("half")).cast("int")
    return a.select("sample_id", corner("x0", "x1").alias("x"), corner("y0", "y1").alias("y"), (F.col("half") * 2).cast("int").alias("side"))


#: Five landmarks as fractions of a box, fixed values.
BOX_LANDMARKS = ((0.32, 0.38), (0.68, 0.38), (0.50, 0.55), (0.36, 0.73), (0.64, 0.73))


def box_landmarks(boxes: DataFrame) -> DataFrame:
    """Rows (sample_id, i, px, py) from boxes (sample_id, x, y, w, h)."""
    at = F.posexplode(F.array(*[F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in BOX_LANDMARKS])).alias("i", "f")
    return boxes.select("*", at).select("sample_id", "i", (F.col("x") + F.col("f.u") * F.col("w")).alias("px"), (F.col("y") + F.col("f.v") * F.col("h")).alias("py"))


def crop_cloud(points: DataFrame, keys: list[str], ratio: float = 0.85, least: int = 100, huge: bool = False) -> DataFrame:
    """Clouds (keys, px, py, pz) centred on the medians of px and py, without points farther off in
    either than ``ratio`` times the larger 5 to 95 percentile span; a cloud that would keep fewer than
    ``least`` points stays whole. ``huge`` is for few clouds of any size: their percentiles come from counts
    (``numbering.quantiles``), so no task holds a cloud's values; else a cloud's distinct values meet in one."""
    if huge:
        shares = {0.05: "l", 0.5: "m", 0.95: "h"}
        q = numbering.quantiles(points, keys, ["px", "py"], list(shares))
        pick = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("share") == p), F.col("value")))
        q = q.groupBy(*keys).agg(*[pick(c, p).alias(c[1] + n) for c in ("px", "py") for p, n in shares.items()])
        b = F.broadcast(q).select(*keys, F.col("xm").alias("mx"), F.col("ym").alias("my"), (F.greatest(F.col("xh") - F.col("xl"), F.col("yh") - F.col("yl"), F.lit(1e-4)) * ratio).alias("reach"))
    else:
        q = lambda c, p: F.percentile(c, F.lit(p))
        b = points.groupBy(*keys).agg(
            q("px", 0.5).alias("mx"), q("py", 0.5).alias("my"),
            (F.greatest(q("px", 0.95) - q("px", 0.05), q("py", 0.95) - q("py", 0.05), F.lit(1e-4)) * ratio).alias("reach"),
        )
    # A join on the cloud puts a cloud in one task; so clouds' bounds go to the points unless they are many.
    few = huge or points.select(*keys).distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = F.broadcast if few else lambda df: df
    x = points.join(held(b), keys).withColumn("px", F.col("px") - F.col("mx")).withColumn("py", F.col("py") - F.col("my"))
    x = x.withColumn("inside", (F.abs("px") <= F.col("reach")) & (F.abs("py") <= F.col("reach")))
    kept = x.groupBy(*keys).agg(F.count_if("inside").alias("kept"))
    return x.join(held(kept), keys).where(F.col("inside") | (F.col("kept") < least)).drop("mx", "my", "reach", "inside", "kept")


def depth_to_cloud(grid: DataFrame, size: int, scene_mm: float = 160.0) -> DataFrame:
    """Pixels with a depth as points in millimetres, y upwards."""
    s = scene_mm / size
    ok = F.col("z").isNotNull() & ~F.isnan("z")
    return grid.where(ok).select("sample_id", ((F.col("x") + 0.5) * s - scene_mm / 2).alias("px"), (scene_mm / 2 - (F.col("y") + 0.5) * s).alias("py"), F.col("z").alias("pz"))
