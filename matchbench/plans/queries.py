"""Queries over the driver's tables, one for each operator. ``embeddings`` plays the template table: the label
is the subject, and pose and light follow the id's remainders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import classifiers, estimators, fields, identification, manifest, meshes, pairs, reporting, sampling, scoring, splits, verification

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an embedding, as a capture of a subject."""
    e, i = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    return e.select(
        i.alias("sample_id"), F.concat(F.lit("S"), F.lpad((F.col("label") + 1).cast("string"), 3, "0")).alias("subject_id"),
        F.element_at(F.array(F.lit(0.0), F.lit(15.0), F.lit(-15.0)), (i % 3 + 1).cast("int")).alias("pose_yaw"), F.lit(0.0).alias("pose_pitch"),
        F.element_at(F.array(*[F.lit(x) for x in ("normal", "strong", "dark", "side")]), (i % 4 + 1).cast("int")).alias("illumination"),
        F.lit("neutral").alias("expression"), F.lit("toy").alias("dataset"), "embedding",
    )


def gallery(c: DataFrame) -> DataFrame:
    return splits.select_gallery(splits.frontal_neutral(c), [])


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures, gallery, probes."""
    c = captures(spark, sf_dir)
    g = gallery(c)
    return c, g, c.join(F.broadcast(g.select("sample_id")), "sample_id", "left_anti")


def identified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, captures, gallery."""
    c, g, p = sides(spark, sf_dir)
    return identification.decide(p, g), c, g


def verified(spark: SparkSession, sf_dir: str) -> verification.Curve:
    """Counts by score of all pairs of captures."""
    return pairs.curve(captures(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with many ties: text length against quality."""
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select(F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores of both halves of the vectors, as two modalities."""
    _, g, p = sides(spark, sf_dir)
    cut = lambda d, at: d.withColumn("embedding", F.slice("embedding", at, 32))
    return scoring.score_blocks(cut(p, 1), cut(g, 1)), scoring.score_blocks(cut(p, 33), cut(g, 33))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.to_grid(captures(spark, sf_dir), 8)


# --- manifest ------------------------------------------------------------------------------------------


@query
def manifest_project(spark, sf_dir):
    c = captures(spark, sf_dir).withColumn("path_2d", F.when(F.col("sample_id") % 5 != 0, F.concat(F.lit("img/"), F.col("sample_id").cast("string"), F.lit(".png"))))
    m = manifest.project(c.withColumn("orig_w", F.when(F.col("sample_id") % 7 == 0, "NA").otherwise("64")))
    return m.select("dataset", "subject_id", "sample_id", "path_2d", "pose_yaw", "illumination", "orig_w", "has_2d", "has_3d", "detect_ok", "quality_flag", "data_modality")


def _raw_manifest(spark, sf_dir):
    """Captures of which some break each rule."""
    i = F.col("sample_id")
    return captures(spark, sf_dir).select(
        F.when(i % 50 == 1, " ").otherwise(i.cast("string")).alias("sample_id"), F.when(i % 60 == 2, "alice").otherwise(F.col("subject_id")).alias("subject_id"),
        F.when(i % 70 == 3, "moon").when(i % 70 == 4, "yale:3").otherwise(F.col("illumination")).alias("illumination"), F.when(i % 80 == 5, "fake").otherwise("real").alias("data_modality"),
        F.when(i % 90 == 6, "x").when(i % 90 == 7, "NA").otherwise(F.col("pose_yaw").cast("string")).alias("pose_yaw"), F.lit("64").alias("orig_w"),
    )


@query
def manifest_validate(spark, sf_dir):
    return manifest.violations(_raw_manifest(spark, sf_dir))


@query
def manifest_audit(spark, sf_dir):
    c = captures(spark, sf_dir)
    return manifest.audit(c.withColumn("has_2d", F.col("sample_id") % 5 != 0).withColumn("has_3d", F.col("sample_id") % 3 != 0))


@query
def audit_pivot(spark, sf_dir):
    return manifest.audit_pivot(captures(spark, sf_dir), "pose_yaw", "illumination", ["normal", "strong", "dark", "side"])


@query
def id_regex_extract(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([a-z-]+)\.", 1).alias("host"), F.regexp_extract("url", r"/(\d+)", 1).try_cast("long").alias("number"))


@query
def condition_label(spark, sf_dir):
    return captures(spark, sf_dir).select("sample_id", C.condition(F.col("pose_yaw"), F.col("illumination")).alias("condition"))


@query
def anonymize_subject(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", C.anonymous(F.col("c_name")).alias("subject_id"))


@query
def duplicate_content(spark, sf_dir):
    return manifest.duplicate_groups(read(spark, sf_dir, "documents"), "text")


@query
def quality_flags(spark, sf_dir):
    i = F.col("sample_id")
    c = captures(spark, sf_dir).select("sample_id", (i % 5 != 0).alias("has_2d"), (i % 3 != 0).alias("has_3d"), (i % 7 != 0).alias("detect_ok"), (i % 11 != 0).alias("nosetip_ok"))
    return c.select("sample_id", *[manifest.quality_flag(m).alias(f"flag_{m}") for m in ("2d", "3d", "both")])


@query
def cache_antijoin(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return manifest.stale(d, d.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")).alias("digest")), ["doc_id", "digest"]).select("doc_id")


@query
def mesh_photo_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("participant"), F.col("o_orderkey").alias("mesh"))
    c = read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("participant"), F.col("c_name").alias("photo"))
    joined = o.join(c, "participant", "left").select("participant", F.col("mesh").cast("string").alias("capture"), F.lit("3d").alias("kind"), F.col("photo").isNotNull().alias("paired"))
    return joined.unionByName(c.select("participant", F.col("photo").alias("capture"), F.lit("2d").alias("kind"), F.lit(True).alias("paired")))


# --- splits --------------------------------------------------------------------------------------------


@query
def gallery_select(spark, sf_dir):
    return gallery(captures(spark, sf_dir)).select("subject_id", "sample_id")


@query
def gallery_fallback(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    c = e.select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_id").alias("sample_id"), F.concat(F.lit("yale:"), F.when(F.col("event_id") % 4 == 0, "A+010E+05").otherwise((F.col("event_id") * 7 % 64).cast("string"))).alias("illumination"))
    return splits.select_gallery(c, splits.fallback_order(F.col("illumination"))).select("subject_id", "sample_id", "illumination")


@query
def split_p1(spark, sf_dir):
    c = captures(spark, sf_dir)
    return splits.closed(c, gallery(c))


@query
def split_p2(spark, sf_dir):
    return splits.disjoint_subjects(captures(spark, sf_dir), 0)


@query
def pairs_genuine(spark, sf_dir):
    return splits.genuine_pairs(captures(spark, sf_dir))


@query
def pairs_impostor(spark, sf_dir):
    c = captures(spark, sf_dir).select("sample_id", "subject_id")
    n = c.groupBy("subject_id").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    return splits.impostor_pairs(c, 3 * n, 0)


@query
def pairs_impostor_20(spark, sf_dir):
    """The reference's ratio of impostor to genuine pairs."""
    c = captures(spark, sf_dir).select("sample_id", "subject_id")
    n = c.groupBy("subject_id").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    return splits.impostor_pairs(c, 20 * n, 0)


@query
def leakage_audit(spark, sf_dir):
    c = captures(spark, sf_dir)
    s = splits.closed(c, gallery(c)).select("sample_id", "subject_id", "role")
    s = s.unionByName(s.where("role = 'gallery' and sample_id % 24 = 0").withColumn("role", F.lit("probe")))
    pairs = splits.genuine_pairs(c).unionByName(c.where("sample_id < 7").select(F.col("sample_id").alias("a"), F.col("sample_id").alias("b")))
    pairs = pairs.unionByName(spark.range(0, 3, 1, 1).select((-F.col("id") - 1).alias("a"), F.col("id").alias("b")))
    background = c.select("subject_id").distinct().where("subject_id in ('S001', 'S004')")
    return splits.leakage(s, pairs, background)


@query
def run_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return splits.dedupe_latest(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


# --- scores --------------------------------------------------------------------------------------------


def _score(spark, sf_dir, kind, blocks=True):
    _, g, p = sides(spark, sf_dir)
    if kind == "chi2":
        g, p = (d.withColumn("embedding", F.transform("embedding", lambda x: F.abs(x))) for d in (g, p))
    return (scoring.score_blocks if blocks else scoring.score_columns)(p, g, kind)


@query
def score_cosine(spark, sf_dir):
    return _score(spark, sf_dir, "cosine")


@query
def score_cosine_columns(spark, sf_dir):
    return _score(spark, sf_dir, "cosine", False)


@query
def score_l2(spark, sf_dir):
    return _score(spark, sf_dir, "l2")


@query
def score_chi2(spark, sf_dir):
    return _score(spark, sf_dir, "chi2")


@query
def score_pairs(spark, sf_dir):
    return scoring.score_genuine(captures(spark, sf_dir))


@query
def score_pairs_all(spark, sf_dir):
    """``score_pairs`` under the name it had while that one bounded ids."""
    return scoring.score_genuine(captures(spark, sf_dir))


@query
def rank_matrix_topk(spark, sf_dir):
    _, g, p = sides(spark, sf_dir)
    return identification.rank(scoring.score_blocks(p, g, top=5)).where("rank <= 5").select("probe_id", "gallery_id", "rank", "score")


def _normalised(spark, sf_dir, kind):
    _, g, p = sides(spark, sf_dir)
    s = scoring.score_blocks(p, g)
    return s.select("probe_id", "gallery_id", r6(scoring.normalise(F.col("score"), scoring.fit_normaliser(s), kind), "score"))


@query
def norm_zscore(spark, sf_dir):
    return _normalised(spark, sf_dir, "zscore")


@query
def norm_minmax(spark, sf_dir):
    return _normalised(spark, sf_dir, "minmax")


@query
def norm_tanh(spark, sf_dir):
    return _normalised(spark, sf_dir, "tanh")


@query
def fuse_sum(spark, sf_dir):
    return scoring.fuse(*halves(spark, sf_dir), "sum").select("probe_id", "gallery_id", r6("score", "score"))


@query
def fuse_product(spark, sf_dir):
    return scoring.fuse(*halves(spark, sf_dir), "product").select("probe_id", "gallery_id", r6("score", "score"))


@query
def fuse_weighted(spark, sf_dir):
    return scoring.fuse(*halves(spark, sf_dir), "weighted_sum", 0.3).select("probe_id", "gallery_id", r6("score", "score"))


@query
def weight_sweep(spark, sf_dir):
    """Rank-1 rate of each weight, in one plan."""
    c = captures(spark, sf_dir).select("sample_id", "subject_id")
    best = scoring.weight_sweep(*halves(spark, sf_dir))
    x = best.join(c.select(F.col("sample_id").alias("probe_id"), F.col("subject_id").alias("t")), "probe_id").join(c.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").alias("u")), "gallery_id")
    return x.groupBy("weight").agg(r6(F.avg((F.col("t") == F.col("u")).cast("double")), "rank1"))


def _classified(spark, sf_dir, name):
    """Frontal captures in normal light are the training rows, all others the probes."""
    c = captures(spark, sf_dir)
    train = splits.frontal_neutral(c)
    return classifiers.classify(name, c.join(train.select("sample_id"), "sample_id", "left_anti"), train)


@query
def classify_knn(spark, sf_dir):
    return _classified(spark, sf_dir, "knn3")


@query
def classify_svm_linear(spark, sf_dir):
    return _classified(spark, sf_dir, "svm_linear")


@query
def classify_svm_rbf(spark, sf_dir):
    return _classified(spark, sf_dir, "svm_rbf")


@query
def concat_features(spark, sf_dir):
    v = C.doubles(F.col("embedding"))
    x = captures(spark, sf_dir).select("sample_id", C.concat_features(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("v"))
    return x.select("sample_id", F.posexplode("v").alias("i", "value")).select("sample_id", F.col("i").cast("long").alias("i"), r6("value", "value"))


# --- identification ------------------------------------------------------------------------------------


@query
def ident_metrics(spark, sf_dir):
    d, _, g = identified(spark, sf_dir)
    m = identification.metrics(d, g.select("subject_id").distinct().count())
    return m.select("n_probe", "n_gallery", *[r6(c, c) for c in ("rank1", "rank5", "rank10", "mrr", "accuracy", "chance", "ratio")])


@query
def cmc(spark, sf_dir):
    return identification.cmc(identified(spark, sf_dir)[0]).select("k", r6("rate", "rate"))


@query
def prf_per_class(spark, sf_dir):
    d, _, g = identified(spark, sf_dir)
    return identification.per_class(d, g).select("subject_id", *[r6(c, c) for c in ("precision", "recall", "f1")], "support")


@query
def prf_macro(spark, sf_dir):
    d, _, g = identified(spark, sf_dir)
    a = identification.averages(identification.per_class(d, g))
    return a.select([r6(c, c) for c in a.columns])


@query
def confusion(spark, sf_dir):
    return identification.confusion(identified(spark, sf_dir)[0]).select("truth", "predicted", "n")


@query
def confusion_norm(spark, sf_dir):
    return identification.confusion(identified(spark, sf_dir)[0]).select("truth", "predicted", r6("share", "share"))


@query
def ident_per_condition(spark, sf_dir):
    d, c, _ = identified(spark, sf_dir)
    cond = c.select(F.col("sample_id").alias("probe_id"), C.condition(F.col("pose_yaw"), F.col("illumination")).alias("condition"))
    return identification.per_condition(d, cond).select("condition", r6("rank1", "rank1"), "n")


# --- verification --------------------------------------------------------------------------------------


@query
def roc_points(spark, sf_dir):
    return verification.roc(labelled(spark, sf_dir)).select(r6("threshold", "threshold"), r6("fpr", "fpr"), r6("tpr", "tpr"))


@query
def roc_points_pairs(spark, sf_dir):
    return verification.roc(verified(spark, sf_dir)).select("threshold", *[F.round(c, 8).alias(c) for c in ("fpr", "tpr")])


@query
def eer(spark, sf_dir):
    return verification.eer(verified(spark, sf_dir)).select(r6("eer", "eer"), r6("eer_threshold", "eer_threshold"))


@query
def eer_ties(spark, sf_dir):
    return verification.eer(labelled(spark, sf_dir)).select(r6("eer", "eer"), r6("eer_threshold", "eer_threshold"))


@query
def auc(spark, sf_dir):
    return verification.auc(verified(spark, sf_dir)).select(r6("auc", "auc"))


@query
def auc_ties(spark, sf_dir):
    return verification.auc(labelled(spark, sf_dir)).select(r6("auc", "auc"))


@query
def tar_at_far(spark, sf_dir):
    return verification.tar_at_far(verified(spark, sf_dir)).select("far", r6("threshold", "threshold"), r6("tar", "tar"))


@query
def score_moments(spark, sf_dir):
    m = pairs.moments(captures(spark, sf_dir))
    return m.select([r6(c, c) if not c.startswith("n_") else F.col(c) for c in m.columns])


@query
def det_far_frr(spark, sf_dir):
    d = verification.det(labelled(spark, sf_dir))
    return d.select([r6(c, c) for c in ("threshold", "far", "frr")])


@query
def pr_curve(spark, sf_dir):
    return verification.precision_recall(labelled(spark, sf_dir)).select([r6(c, c) for c in ("threshold", "precision", "recall")])


@query
def avg_precision(spark, sf_dir):
    return verification.average_precision(labelled(spark, sf_dir)).select(r6("average_precision", "average_precision"))


@query
def score_hist(spark, sf_dir):
    return pairs.histogram(captures(spark, sf_dir)).select("y", "bin", "n")


@query
def bootstrap_ci(spark, sf_dir):
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))
    draw = sampling.poisson_draw(0, F.col("replicate").cast("string"), F.col("doc_id").cast("string"))
    return verification.bootstrap_auc(s, draw, 50).select(r6("lo", "lo"), r6("hi", "hi"))


@query
def bootstrap_ci_1000(spark, sf_dir):
    """The reference's number of replicates, and both of its metrics."""
    s = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))
    draw = sampling.poisson_draw(0, F.col("replicate").cast("string"), F.col("doc_id").cast("string"))
    return verification.bootstrap_ci(s, draw).select("metric", r6("lo", "lo"), r6("hi", "hi"))


# --- pixel grids ---------------------------------------------------------------------------------------


def _grid6(df, *cols):
    return df.select("sample_id", "y", "x", *[r6(c, c) for c in cols])


@query
def field_gradient(spark, sf_dir):
    return _grid6(fields.gradient(grid(spark, sf_dir)), "zx", "zy")


@query
def normals(spark, sf_dir):
    return _grid6(fields.normals(grid(spark, sf_dir)), "nx", "ny", "nz")


@query
def curvature(spark, sf_dir):
    return _grid6(fields.curvature(grid(spark, sf_dir)), "h", "k", "shape_index")


@query
def curv_hist(spark, sf_dir):
    return fields.curvature_histogram(grid(spark, sf_dir)).select("sample_id", "bin", r6("share", "share"))


@query
def range_normalize_std(spark, sf_dir):
    return _grid6(fields.normalise_range(grid(spark, sf_dir), "std"), "z")


@query
def range_normalize_p5p95(spark, sf_dir):
    return _grid6(fields.normalise_range(grid(spark, sf_dir), "p5p95"), "z")


@query
def histeq(spark, sf_dir):
    return _grid6(fields.equalise(grid(spark, sf_dir).withColumn("z", F.round(F.abs("z"), 6))), "z")


@query
def occlude_block(spark, sf_dir):
    h, w = fields.block_size(8, 8, 0.3)
    at = lambda what, n: (C.hash32(F.concat(F.lit(what), F.col("sample_id").cast("string"))) % (8 - n + 1)).cast("int")
    return _grid6(fields.occlude(grid(spark, sf_dir), at("y", h), at("x", w), h, w), "z")


@query
def occlude_sunglasses(spark, sf_dir):
    t, left, h, w = fields.sunglasses(8, 8)
    return _grid6(fields.occlude(grid(spark, sf_dir), F.lit(t), F.lit(left), h, w), "z")


@query
def block_mean(spark, sf_dir):
    return _grid6(fields.block_mean(grid(spark, sf_dir), 4), "z")


def _points(spark, sf_dir):
    v = C.doubles(F.col("embedding"))
    x = captures(spark, sf_dir).select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), v.alias("v"))
    at = lambda k: F.element_at("v", (F.col("i") * 3 + k).cast("int"))
    return x.select("sample_id", F.col("i").cast("long").alias("i"), at(1).alias("px"), at(2).alias("py"), at(3).alias("pz"))


@query
def lmk_distances(spark, sf_dir):
    return fields.landmark_distances(_points(spark, sf_dir)).select("sample_id", "i", "j", r6("d", "d"))


@query
def bbox_landmarks(spark, sf_dir):
    p = _points(spark, sf_dir).select("sample_id", (F.col("px") * 1000).alias("px"), (F.col("py") * 1000).alias("py"))
    return fields.landmark_box(p)


@query
def box_landmarks(spark, sf_dir):
    b = captures(spark, sf_dir).select("sample_id", *[(F.col("sample_id") % k).cast("double").alias(n) for n, k in (("x", 7), ("y", 5), ("w", 11), ("h", 13))])
    return fields.box_landmarks(b).select("sample_id", F.col("i").cast("long").alias("i"), r6("px", "px"), r6("py", "py"))


def _cropped(spark, sf_dir, huge):
    p = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("px"), (F.col("l_discount") * 100).cast("double").alias("py"), F.col("l_tax").cast("double").alias("pz"))
    return fields.crop_cloud(p, ["l_returnflag"], huge=huge).select("l_returnflag", "l_orderkey", "l_linenumber", r6("px", "px"), r6("py", "py"), r6("pz", "pz"))


# --- reports -------------------------------------------------------------------------------------------


def _runs(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), (F.col("user_id") % 5).alias("seed"), F.col("value").cast("double").alias("rank1"))


@query
def cloud_crop(spark, sf_dir):
    return _cropped(spark, sf_dir, False)


@query
def cloud_crop_huge(spark, sf_dir):
    """``cloud_crop`` by counts, for few clouds of any size."""
    return _cropped(spark, sf_dir, True)


@query
def fill_nearest(spark, sf_dir):
    """Grids whose negative cells are gaps."""
    g = grid(spark, sf_dir).withColumn("z", F.when(F.col("z") >= 0, F.col("z")))
    return meshes.fill_nearest(g).select("sample_id", "y", "x", r6("z", "z"))


@query
def range_image_pixels(spark, sf_dir):
    """``range_image`` as column expressions."""
    z = meshes.range_image(grid(spark, sf_dir), 8, 8, 16)
    return z.select("sample_id", (F.col("y") * 16 + F.col("x")).cast("long").alias("i"), r6("z", "value"))


def _mesh(spark, sf_dir):
    """Each capture's values as heights of 8 x 8 vertices, moved sideways by their heights; two faces a cell."""
    v = grid(spark, sf_dir).select("sample_id", (F.col("y") * 8 + F.col("x")).alias("vertex"), (F.col("x") + 0.25 * F.col("z")).alias("px"), F.col("y").cast("double").alias("py"), F.col("z").alias("pz"))
    cell = v.where("vertex % 8 < 7 and vertex < 56").select("sample_id", F.col("vertex").alias("k"))
    face = F.explode(F.array(*[F.struct((F.col("k") * 2 + n).alias("face"), *[(F.col("k") + d).alias(c) for c, d in zip("abc", of, strict=True)]) for n, of in enumerate(((0, 1, 8), (1, 9, 8)))]))
    return v, cell.select("sample_id", face.alias("f")).select("sample_id", "f.*")


@query
def mesh_interpolate(spark, sf_dir):
    return meshes.interpolate(*_mesh(spark, sf_dir), 16, 0.0, 7.0).select("sample_id", "y", "x", r6("z", "z"))


@query
def mesh_to_depth(spark, sf_dir):
    return meshes.mesh_to_depth(*_mesh(spark, sf_dir), 16, 0.0, 7.0).select("sample_id", "y", "x", r6("z", "z"))


@query
def seed_mean_std(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.avg("rank1").alias("rank1"))
    return reporting.mean_std(by, ["arm"], "rank1").select("arm", "n", r6("mean", "mean"), r6("std", "std"))


@query
def seed_summary(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.avg("rank1").alias("rank1"), F.max("rank1").alias("top"))
    s = reporting.summarized(by, ["arm"], ["rank1", "top"])
    return s.select("arm", *[r6(c, c) for c in s.columns[1:]])


@query
def render_t1(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.avg("rank1").alias("rank1"))
    return reporting.render(by, ["arm"], ["rank1"], 2)


@query
def chance_ratio(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("arm").agg(F.avg("rank1").alias("rank1"), F.countDistinct("seed").alias("gallery_size"))
    return reporting.with_chance(by).select("arm", "gallery_size", r6("rank1", "rank1"), r6("chance", "chance"), r6("ratio", "ratio"))


@query
def robustness_rollup(spark, sf_dir):
    by = _runs(spark, sf_dir).groupBy("arm", "seed").agg(F.avg("rank1").alias("m"), F.count("*").alias("n"))
    runs = by.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("arm", F.struct(F.col("m").alias("rank1"), "n")))).alias("c"))
    return reporting.rollup_conditions(runs, ["seed"], "c").select("seed", "condition", r6("rank1", "rank1"), "n")


@query
def timing_table(spark, sf_dir):
    t = reporting.timing(_runs(spark, sf_dir).withColumnRenamed("rank1", "ms"), ["arm"], "ms")
    return t.select("arm", *[r6(c, c) for c in ("median_ms", "mean_ms", "std_ms")], "n")


@query
def json_metrics(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), r6(F.avg("p.k"), "mean"))


@query
def pareto_frontier(spark, sf_dir):
    return reporting.pareto(read(spark, sf_dir, "part").select(F.col("p_size").alias("accuracy"), F.col("p_retailprice").cast("double").alias("cost")), "accuracy", "cost")


# --- fitted templates and kernels: those without SQL (PCA, LDA, Procrustes in space) are held against numpy in tests ---


def _flat(df):
    return df.select("sample_id", "subject_id", F.posexplode("template").alias("i", "value")).select("sample_id", "subject_id", F.col("i").cast("long").alias("i"), r6("value", "value"))


@query
def pca_project(spark, sf_dir):
    c, g, _ = sides(spark, sf_dir)
    return _flat(estimators.fit_pca(c).transform(c))


@query
def lda_project(spark, sf_dir):
    c = captures(spark, sf_dir)
    return _flat(estimators.fit_lda(c).transform(c))


def _kernel(spark, sf_dir, f, batched=False):
    return _flat(K.apply(captures(spark, sf_dir), "embedding", f, (8, 8), batched=batched))


@query
def lbp(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.lbp(a, blocks=2), True)


@query
def hog(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.hog(a, cell=2))


@query
def gabor(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.gabor(a, (0.2, 0.4), 4, 4))


@query
def tantriggs(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.normalise_light(abs(a), "tantriggs"))


@query
def clahe(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.normalise_light(abs(a), "clahe", grid=2))


@query
def umeyama(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.move(a[:5, :2], *K.similarity(a[:5, :2], a[:5, 2:4])))


@query
def procrustes(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.procrustes(a[:5, :3], a[:5, 3:6]))


@query
def rasterize(spark, sf_dir):
    def draw(a):
        import numpy as np

        v = np.column_stack((a[:6, 0] * 8 + 4, a[:6, 1] * 8 + 4, a[:6, 2]))
        return np.nan_to_num(K.rasterise(v, np.array([[0, 1, 2], [3, 4, 5]]), 8))

    return _kernel(spark, sf_dir, draw)


@query
def range_image(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.range_image(a, 16)[0])


@query
def cloud_to_depth(spark, sf_dir):
    return _kernel(spark, sf_dir, lambda a: K.cloud_to_depth(a.reshape(-1)[:63].reshape(21, 3), 8))


@query
def det_deviates(spark, sf_dir):
    return verification.det(labelled(spark, sf_dir)).select([r6(c, c) for c in ("far", "frr", "far_deviate", "frr_deviate")])
