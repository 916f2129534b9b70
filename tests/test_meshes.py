"""Pixel plans against brute force in numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from matchbench.functions import kernels as K
from matchbench.operators import fields, meshes


def table(spark, pictures):
    rows = [(n, y, x, None if np.isnan(v) else float(v)) for n, p in pictures.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "sample_id string, y int, x int, z double")


def pictures(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["sample_id"], {})[r["y"], r["x"]] = math.nan if r["z"] is None else r["z"]
    return {n: np.array([[c[y, x] for x in range(max(k[1] for k in c) + 1)] for y in range(max(k[0] for k in c) + 1)]) for n, c in out.items()}


def holed(height, width, share, seed):
    r = np.random.default_rng(seed)
    return np.where(r.random((height, width)) < share, np.nan, r.normal(0, 1, (height, width)))


def test_nearest_fill_equals_brute_force(spark):
    p = {"few": holed(9, 13, 0.2, 0), "most": holed(40, 30, 0.99, 1), "whole": holed(5, 5, 0, 2), "none": np.full((4, 4), np.nan), "line": holed(1, 20, 0.7, 3)}
    got = pictures(meshes.fill_nearest(table(spark, p)))
    for n in p:
        assert np.allclose(got[n], K.fill_nearest(p[n]), equal_nan=True), n


def test_nan_is_a_gap(spark):
    t = table(spark, {"a": holed(6, 6, 0.5, 4)})
    same = [pictures(meshes.fill_nearest(x))["a"] for x in (t, t.withColumn("z", F.coalesce("z", F.lit(float("nan")))))]
    assert np.array_equal(*same)


def test_range_image_equals_the_array_kernel(spark):
    for n, (height, width, size, share) in enumerate([(12, 9, 16, 0.3), (20, 20, 7, 0.6), (1, 5, 4, 0.0), (6, 6, 1, 0.2)]):
        p = holed(height, width, share, n)
        got = pictures(meshes.range_image(table(spark, {"a": p}), height, width, size))["a"]
        assert np.allclose(got, K.range_image(p, size)[0], atol=1e-9)
    assert not pictures(meshes.range_image(table(spark, {"a": np.full((3, 3), np.nan)}), 3, 3, 4))["a"].any()


def mesh(spark, seed=0, n=40, m=25):
    r = np.random.default_rng(seed)
    v, f = r.uniform(0, 11, (n, 3)), r.integers(0, n, (m, 3))
    vertices = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(v)], "sample_id string, vertex int, px double, py double, pz double")
    faces = spark.createDataFrame([("a", i, *map(int, t)) for i, t in enumerate(f)], "sample_id string, face int, a int, b int, c int")
    return v, f, vertices, faces


def test_interpolation_equals_the_array_kernel(spark):
    for seed in range(2):
        v, f, vertices, faces = mesh(spark, seed)
        got = pictures(meshes.interpolate(vertices, faces, 12, 0.0, 11.0))["a"]
        want = K.rasterise(v, f, 12)
        assert np.isnan(want).any() and not np.isnan(want).all() and np.allclose(got, want, equal_nan=True, atol=1e-9)
        filled = pictures(meshes.mesh_to_depth(vertices, faces, 12, 0.0, 11.0))["a"]
        assert np.allclose(filled, K.fill_nearest(want), atol=1e-9)


def test_a_plane_stays_a_plane(spark):
    """Linear inside faces, at any resolution, where cell means would make steps."""
    at = [(x, y) for y in (0.0, 3.0, 10.0) for x in (0.0, 7.0, 10.0)]
    vertices = spark.createDataFrame([("p", i, x, y, 2 * x - y + 1) for i, (x, y) in enumerate(at)], "sample_id string, vertex int, px double, py double, pz double")
    faces = spark.createDataFrame([("p", 2 * k + n, *[k + d for d in of]) for k in (0, 1, 3, 4) for n, of in enumerate(((0, 1, 3), (1, 4, 3)))], "sample_id string, face int, a int, b int, c int")
    got = pictures(meshes.interpolate(vertices, faces, 21, 0.0, 10.0))["p"]
    y, x = np.mgrid[0:21, 0:21] / 2
    assert np.allclose(got, 2 * x - y + 1)


def test_faces_out_of_bounds_flat_or_unknown(spark):
    _, _, vertices, faces = mesh(spark)
    odd = spark.createDataFrame([("a", 900, 1, 1, 2), ("a", 901, 1, 2, 777), ("b", 902, 0, 1, 2)], faces.schema)
    far = spark.createDataFrame([("far", i, 100.0 + i % 2, 100.0 + i // 2, 1.0) for i in range(3)], vertices.schema)
    out = spark.createDataFrame([("far", 1, 0, 1, 2)], faces.schema)
    a, b = (pictures(meshes.interpolate(*t, 12, 0.0, 11.0)) for t in ((vertices, faces), (vertices.union(far), faces.union(odd).union(out))))
    assert set(b) == {"a", "far"} and np.allclose(a["a"], b["a"], equal_nan=True) and np.isnan(b["far"]).all()
    assert meshes.mesh_to_depth(vertices.limit(0), faces, 4, 0.0, 1.0).count() == 0


def test_huge_clouds_are_cropped_alike(spark):
    r = np.random.default_rng(6)
    rows = [("ab"[int(i < 40)], *map(float, r.normal(0, 1, 3).round(2))) for i in range(400)]
    p = spark.createDataFrame(rows, "cloud string, px double, py double, pz double")
    key = lambda d: sorted((x["cloud"], round(x["px"], 9), round(x["py"], 9), x["pz"]) for x in d.collect())
    assert key(fields.crop_cloud(p, ["cloud"])) == key(fields.crop_cloud(p, ["cloud"], huge=True))
