"""Closed-form anchors and numpy checks of the core operators."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbench.functions import columns as C
from matchbench.functions import kernels as K
from matchbench.operators import estimators, fields, identification, manifest, reporting, sampling, scoring, splits, verification
from matchbench.plans import experiments
from matchbench.registry import FEATURES, MATCHERS, Registry
from matchbench.sources import files, toy
from matchbench.streaming import scores as streaming


def scores_of(spark, genuine, impostor):
    return spark.createDataFrame([(float(x), 1) for x in genuine] + [(float(x), 0) for x in impostor], "score double, y int")


def test_eer_anchor(spark):
    r = verification.eer(scores_of(spark, [0.863, 0.541, 0.300, 0.423], [0.028, 0.124, 0.671, 0.647])).first()
    assert r["eer"] == pytest.approx(0.5)
    assert r["eer_threshold"] == pytest.approx(0.5313333333)


def test_separable_scores(spark):
    s = scores_of(spark, [0.9, 0.8], [0.1, 0.2, 0.3])
    assert verification.auc(s).first()["auc"] == 1.0
    assert verification.eer(s).first()["eer"] == 0.0
    t = {r["far"]: r["tar"] for r in verification.tar_at_far(s).collect()}
    assert t[0.1] == 1.0 and 0.999 < t[0.001] < 1.0


def test_auc_is_symmetric_and_any_number_of_ranges_agrees(spark):
    rng = np.random.default_rng(1)
    g, i = np.round(rng.normal(0.3, 1, 200), 1), np.round(rng.normal(0, 1, 300), 1)
    a = verification.auc(scores_of(spark, g, i)).first()["auc"]
    b = verification.auc(scores_of(spark, i, g)).first()["auc"]
    want = np.mean((g[:, None] > i) + 0.5 * (g[:, None] == i))
    assert a == pytest.approx(want) and a + b == pytest.approx(1)
    s = scores_of(spark, g, i)
    one, many = (sorted(verification.running_counts(s, n).collect()) for n in (1, 7))
    assert one == many


def ranked(spark, m, truth, gallery):
    s = spark.createDataFrame([(f"p{i}", f"g{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "probe_id string, gallery_id string, score double")
    names = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(truth)] + [(f"g{j}", t) for j, t in enumerate(gallery)], "sample_id string, subject_id string")
    return s, names, identification.decisions(s, names)


def test_perfect_identification(spark):
    m = np.full((3, 5), 0.1) + np.eye(3, 5)
    s, names, d = ranked(spark, m, "ABC", "ABCDE")
    r = identification.metrics(d, 5).first()
    assert r["rank1"] == r["mrr"] == 1.0 and r["chance"] == 0.2
    universe = spark.createDataFrame([(x,) for x in "ABCDE"], "subject_id string")
    assert identification.averages(identification.per_class(d, universe)).first()["f1_macro"] == pytest.approx(0.6)
    identification.check(s, d)


def test_one_probe_at_rank_two(spark):
    m = np.full((3, 5), 0.1) + np.eye(3, 5)
    m[2, 4] = 2
    _, _, d = ranked(spark, m, "ABC", "ABCDE")
    assert identification.metrics(d, 5).first()["rank1"] == pytest.approx(2 / 3)
    rates = [r["rate"] for r in identification.cmc(d).orderBy("k").collect()]
    assert len(rates) == 20 and rates[1] == 1.0 and rates == sorted(rates)


def test_decisions_inside_batches_equal_those_of_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, f"S{i % 5:03d}", np.round(rng.normal(size=4), 1).tolist()) for i in range(60)] + [(90, "S999", [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "sample_id long, subject_id string, embedding array<double>")
    g, p = df.where("sample_id < 12"), df.where("sample_id >= 12")
    by_scores = sorted(tuple(r) for r in identification.decisions(scoring.score_blocks(p, g), df.select("sample_id", "subject_id")).collect())
    assert sorted(tuple(r) for r in identification.decide(p, g).collect()) == by_scores and (90, "S999") in {r[:2] for r in by_scores if r[3] is None}
    pairs = sorted(tuple(r) for r in scoring.all_pairs(df).collect())
    monkeypatch.setattr(scoring, "held_gallery", lambda *a: None)
    assert sorted(tuple(r) for r in identification.decide(p, g).collect()) == by_scores
    assert sorted(tuple(r) for r in scoring.all_pairs(df).collect()) == pairs and len(pairs) == 61 * 60 // 2


def test_identification_errors(spark):
    s, _, d = ranked(spark, np.ones((1, 2)), "Z", "AB")
    with pytest.raises(ValueError, match="gallery"):
        identification.check(s, d)
    with pytest.raises(ValueError, match="no probes"):
        identification.check(s, d.limit(0))


@pytest.mark.parametrize("kind", ["cosine", "l2", "chi2"])
def test_blocks_equal_columns(spark, kind):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.random(8).tolist()) for i in range(23)], "sample_id long, embedding array<double>")
    p, g = rows.where("sample_id < 15"), rows.where("sample_id >= 10")
    a = sorted(tuple(r) for r in scoring.score_columns(p, g, kind).collect())
    b = sorted(tuple(r) for r in scoring.score_blocks(p, g, kind).collect())
    c = sorted(tuple(r) for r in scoring.score_blocks(p, g, kind, limit=2, block=5).collect())
    assert np.allclose(np.array(a), np.array(b), atol=2e-8) and np.allclose(np.array(a), np.array(c), atol=2e-8)
    assert scoring.score_blocks(p, g, kind, top=2).count() == 30


def test_matchers(spark):
    assert MATCHERS.names() == ["knn3", "nn_chi2", "nn_cosine", "nn_l2", "svm_linear", "svm_rbf"]
    assert len(FEATURES.names()) == 11
    r = Registry("x")
    r.add("a", 1)
    with pytest.raises(ValueError):
        r.add("a", 2)
    with pytest.raises(KeyError, match="known: a"):
        r.get("b")


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 0.5)], "probe_id long, gallery_id long, score double")
    b = spark.createDataFrame([(1, 1, 0.25)], "probe_id long, gallery_id long, score double")
    assert scoring.fuse(a, b, "product").first()["score"] == 0.125
    assert sorted(tuple(r) for r in scoring.weight_sweep(a, b).collect()) == [(round(k / 20, 2), 1, 1) for k in range(21)]
    with pytest.raises(ValueError):
        scoring.fuse(a, b, "weighted_sum", 2)
    assert scoring.fit_normaliser(a) == {"mean": 0.5, "std": 1.0, "lo": 0.5, "hi": 1.5}


def test_default_collection_counts(spark):
    plan = toy.schedule(spark)
    gallery = splits.select_gallery(splits.frontal_neutral(plan), [])
    roles = {r["role"]: r["count"] for r in splits.closed(plan, gallery).groupBy("role").count().collect()}
    assert roles == {"gallery": 12, "probe": 168}
    assert splits.genuine_pairs(plan).count() == 12 * 105
    assert splits.impostor_pairs(plan, 20 * 1260, 0).count() == 14850
    parts = {r["part"]: r["count"] for r in splits.disjoint_subjects(plan, 0).groupBy("part").count().collect()}
    assert parts == {"background": 4, "evaluation": 8}


def test_leakage(spark):
    plan = toy.schedule(spark, 4, 12)
    _, split = experiments.roles(plan, "P2_disjoint", 1)
    ids = splits.disjoint_subjects(plan, 1).where("part = 'background'").select("subject_id")
    clean = splits.leakage(split, splits.genuine_pairs(plan.join(split.select("sample_id"), "sample_id", "left_semi")), ids)
    assert all(r["n"] == 0 for r in clean.collect())
    with pytest.raises(ValueError):
        experiments.roles(plan, "P9", 0)


def test_manifest_round_trip_and_rules(spark, tmp_path):
    m = manifest.project(toy.schedule(spark, 3, 4))
    files.write_manifest(m, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m"))
    assert back.count() == 12 and back.where("data_modality = 'synthetic_toy' and path_2d is null").count() == 12
    bad = m.withColumn("subject_id", F.lit("alice")).select([F.col(c).cast("string").alias(c) for c in m.columns])
    with pytest.raises(ValueError, match="subject_id"):
        files.typed_manifest(bad)
    assert manifest.audit(m).first()["min_per_subject"] == 4


def test_grid_operators_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.random((2, 6, 6))
    rows = spark.createDataFrame([(i, a[i].ravel().tolist()) for i in range(2)], "sample_id long, embedding array<double>")
    g = fields.curvature(fields.to_grid(rows, 6)).orderBy("sample_id", "y", "x").toPandas()
    zy, zx = np.gradient(a[0])
    (zyy, _), (zxy, zxx) = np.gradient(zy), np.gradient(zx)
    q = 1 + zx**2 + zy**2
    k = (zxx * zyy - zxy**2) / q**2
    assert np.allclose(g["k"][:36], k.ravel())
    e = fields.equalise(fields.to_grid(rows, 6)).orderBy("sample_id", "y", "x").toPandas()["z"][:36]
    assert np.allclose(e, (K.equalise(K.to_levels(a[0])) / 255.0).ravel(), atol=1e-9)


def test_kernels():
    rng = np.random.default_rng(0)
    a = rng.random((64, 64))
    assert K.lbp(a).shape == (640,) and np.allclose(K.lbp(a).reshape(64, 10).sum(1), 1)
    assert K.hog(a).shape == (1764,) and np.isfinite(K.hog(a)).all()
    assert K.gabor(a, (0.1, 0.3), 2, 4).shape == (1024,)
    p = rng.random((9, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    r, s, t = K.similarity(p, 2.5 * p @ turn.T + 1)
    assert np.allclose(r, turn) and s == pytest.approx(2.5) and np.allclose(t, 1)
    assert np.allclose(K.procrustes(p, p), p)
    q = rng.random((9, 3))
    moved = K.procrustes(p, q)
    worse = [np.linalg.norm(K.move(p, r, s * f, t) - q) for f in (0.98, 1.02) for r, s, t in [K.similarity(p, q)]]
    assert all(np.linalg.norm(moved - q) < w for w in worse)
    for k in range(3):  # no small turn brings the points closer
        for e in (-0.01, 0.01):
            g = np.eye(3)
            i, j = (k + 1) % 3, (k + 2) % 3
            g[i, i] = g[j, j] = np.cos(e)
            g[i, j], g[j, i] = np.sin(e), -np.sin(e)
            assert np.linalg.norm((moved - q.mean(0)) @ g - q + q.mean(0)) > np.linalg.norm(moved - q)
    z = K.rasterise(np.array([[0.0, 0, 1], [7, 0, 1], [0, 7, 1]]), np.array([[0, 1, 2]]), 8)
    assert z[0, 0] == 1 and np.isnan(z[7, 7])
    flat, holes = K.range_image(np.full((32, 32), np.nan))
    assert holes == 1.0 and not flat.any()
    for m in ("none", "histeq", "clahe", "tantriggs"):
        out = K.normalise_light(a, m)
        assert out.shape == a.shape and np.isfinite(out).all() and out.std() > 0
    image = rng.random((20, 20))
    assert np.allclose(K.warp(image, np.eye(2), 1.0, np.zeros(2), 20), image)
    cloud = rng.normal(size=(2500, 3))
    assert K.cloud_to_depth(cloud, 16).shape == (16, 16) and np.isfinite(K.cloud_to_depth(cloud, 16)).all()


def test_uniform_patterns_of_flat_and_spot():
    assert (K.uniform_patterns(np.ones((5, 5)))[1:-1, 1:-1] == 8).all()
    spot = np.zeros((5, 5))
    spot[2, 2] = 1
    assert K.uniform_patterns(spot)[2, 2] == 0


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) @ np.diag([5, 3, 2, 1, 0.1, 0.1])
    rows = spark.createDataFrame([(i, f"S{i % 4:03d}", x[i].tolist()) for i in range(40)], "sample_id long, subject_id string, embedding array<double>")
    p = estimators.fit_pca(rows)
    u, s, v = np.linalg.svd(x - x.mean(0))
    assert np.allclose(p.explained, (s**2 / (s**2).sum())[: len(p.explained)])
    got = np.array([r["template"] for r in p.transform(rows).orderBy("sample_id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ v[: got.shape[1]].T))
    lda, y = estimators.fit_lda(rows), np.arange(40) % 4
    means = np.array([x[y == k].mean(0) for k in range(4)])
    within = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in range(4)) / 36
    between = sum(10 * np.outer(m - x.mean(0), m - x.mean(0)) for m in means) / 40
    w, v = np.linalg.eigh(within)
    power = np.linalg.eigvalsh((v / np.sqrt(w)).T @ between @ (v / np.sqrt(w)))[::-1][:3]
    assert lda.axes.shape[1] == 3 and np.allclose(lda.explained, power / power.sum())
    assert np.allclose(lda.axes.T @ within @ lda.axes, np.eye(3)) and np.allclose(lda.axes.T @ between @ lda.axes, np.diag(power))
    with pytest.raises(ValueError):
        estimators.fit_lda(rows.limit(4))


def wide(rows, columns, rank, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(rows, rank)) * 0.8 ** np.arange(rank) @ np.linalg.qr(r.normal(size=(columns, rank)))[0].T + r.normal(size=columns)


@pytest.mark.parametrize("rows, columns, way", [(38, 10_240, "_gram"), (300, 64, "moments"), (400, 90, "_iterated")])
def test_pca_of_any_shape_equals_svd(spark, monkeypatch, rows, columns, way):
    """Each way where it applies, and no other; the first without a matrix of columns by columns."""
    x = wide(rows, columns, 25, rows)
    if way == "_iterated":
        monkeypatch.setattr(estimators, "WIDE", 64)
    for other in {"_gram", "moments", "_iterated"} - {way}:
        monkeypatch.setattr(estimators, other, None)
    df = spark.createDataFrame([(f"{i:04d}", "S", x[i].tolist()) for i in range(rows)], "sample_id string, subject_id string, embedding array<double>").repartition(3)
    p = estimators.fit_pca(df, most=12, keep=0.999)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert p.axes.shape == (columns, 12) and np.allclose(p.mean, x.mean(0)) and np.allclose(p.explained, (s**2 / (s**2).sum())[:12])
    assert np.allclose(np.abs(np.einsum("ij,ji->i", p.axes.T, v[:12].T)), 1, atol=1e-6)
    got = np.array([r["template"] for r in p.transform(df).orderBy("sample_id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ v[:12].T), atol=1e-5)


def test_projection_is_saved(spark, tmp_path):
    p = estimators.Projection(np.zeros(2), np.eye(2), np.ones(2))
    p.save(str(tmp_path / "p"))
    assert np.array_equal(estimators.Projection.load(str(tmp_path / "p")).axes, p.axes)


def test_end_to_end(spark, tmp_path):
    plan = toy.schedule(spark, 5, 12)
    c = plan.select("sample_id", "subject_id", "pose_yaw", "pose_pitch", "illumination", "expression").join(toy.captures(plan).drop("subject_id"), "sample_id").persist()
    e = experiments.Experiment("E00", "toy", ("P1_closed", "P2_disjoint"), (0,), (experiments.Arm("2D", "hog", "nn_cosine"),))
    runs = experiments.run(c, e, replicates=20).persist()
    assert len(runs._jdf.queryExecution().toString()) < 1_000_000
    assert runs.count() == 2 and runs.where("identification.rank1 > 0.4 and verification.auc > 0.45").count() == 2  # chance: 0.2 and 0.33
    files.write_runs(runs, str(tmp_path / "runs"))
    back = files.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(r[0] for r in back.select("protocol").collect()) == ["P1_closed", "P2_disjoint"]
    with pytest.raises(RuntimeError):
        experiments.run_arm(c, experiments.Arm("x", "arcface", "nn_cosine"), "P1_closed", 0).count()
    c = c.where("sample_id rlike '_0[0-3]'")
    for feature in ("curv_hist", "lmk3d", "normal_hog"):
        assert experiments.run_arm(c, experiments.Arm("x", feature, "nn_cosine"), "P1_closed", 0, verify=False).count() == 1


def test_rendering_is_deterministic(spark):
    plan = toy.schedule(spark, 2, 2)
    a, b = (sorted(tuple(r) for r in toy.captures(plan, 40, 16).collect()) for _ in range(2))
    assert repr(a) == repr(b)


PLY = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar diffuse_red\nproperty uchar diffuse_green\nproperty uchar diffuse_blue\nend_header\n1 2 3 4 5 6\n7 8 9 10 11 12\n"


def test_meshes():
    p, c = files.parse_ply(PLY)
    assert p.tolist() == [[1, 2, 3], [7, 8, 9]] and c.tolist() == [[4, 5, 6], [10, 11, 12]]
    for bad in (b"plx\n", b"ply\nformat ascii 1.0\n", PLY.replace(b"ascii", b"binary_little_endian"), PLY.replace(b"7 8 9 10 11 12\n", b"")):
        with pytest.raises(ValueError):
            files.parse_ply(bad)


def test_collections(spark):
    f = spark.createDataFrame([(p, PLY) for p in ("/d/yaleB01/yaleB01_P00A+000E+00.pgm", "/d/yaleB02/yaleB02_P00A-010E+20.pgm", "/d/yaleB01/yaleB01_P00_Ambient.pgm", "/d/x.txt")], "path string, content binary")
    got = {(r["subject_id"], r["illumination"]) for r in files.light_photos(f).collect()}
    assert got == {("S001", "normal"), ("S002", "yale:A-010E+20")}
    f = spark.createDataFrame([(p, PLY) for p in ("/t/TD_3D_3.ply", "/t/3/TD_RGB_E_2.jpg", "/t/4/TD_RGB_E_2.jpg")], "path string, content binary")
    assert {(r["subject_id"], r["expression"]) for r in files.meshes_and_photos(f).collect()} == {("S003", "neutral"), ("S003", "smile")}
    assert files.clouds(f.where("path like '%ply'")).count() == 2


def test_report(spark):
    rows = spark.createDataFrame([("a", 23.0, 0.5), ("b", 10.0, None)], "arm string, gallery_size double, rank1 double")
    r = reporting.with_chance(rows).where("arm = 'a'").first()
    assert r["ratio"] == pytest.approx(11.5)
    t = reporting.render(rows, ["arm"], ["rank1"])
    assert [tuple(x) for x in t.collect()] == [("a", "0.5000±0.0000")] and "| a |" in reporting.to_markdown(t)


def test_deviates_and_draws(spark):
    x = spark.createDataFrame([(0.5,), (0.975,), (0.01,)], "p double").select(C.normal_deviate(F.col("p")).alias("z"))
    assert np.allclose([r["z"] for r in x.collect()], [0, 1.959963985, -2.326347874], atol=1e-8)
    w = spark.range(20000).select(sampling.poisson_draw(1, F.lit("0"), F.col("id").cast("string")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.06


def test_stream_equals_batch(spark, tmp_path):
    s = scores_of(spark, [0.9, 0.5, 0.5], [0.1, 0.5])
    s.repartition(2).write.json(str(tmp_path / "in"))
    q = streaming.accumulate(spark.readStream.schema("score double, y int").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    c = streaming.as_scores(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(tuple(r) for r in c.collect()) == sorted([(0.9, 1, 1), (0.5, 1, 2), (0.5, 0, 1), (0.1, 0, 1)])
