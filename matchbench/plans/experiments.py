"""Experiments: arms of a feature and a matcher, over protocols and seeds, to run records."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import estimators, fields, identification, scoring, splits, verification
from ..registry import FEATURES, MATCHERS
from ..sources.files import IDENTIFICATION, VERIFICATION
from ..storage import Scratch, keep


@dataclass(frozen=True)
class Arm:
    key: str
    feature: str
    matcher: str
    #: As files name them (``PARAMETERS``, ``MATCHER_PARAMETERS``).
    feature_params: dict = field(default_factory=dict)
    matcher_params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Experiment:
    id: str
    dataset: str
    protocols: tuple[str, ...]
    seeds: tuple[int, ...]
    arms: tuple[Arm, ...]
    #: Occlusions (name, kind, share) of probes, besides the clean run.
    conditions: tuple[tuple[str, str, float], ...] = ()
    verification: bool = True
    settings: dict = field(default_factory=dict)


_BOTH, _SEEDS = ("P1_closed", "P2_disjoint"), (0, 1, 2, 3, 4)
_FLAT = (Arm("PCA", "pca", "nn_cosine"), Arm("HOG", "hog", "nn_cosine"), Arm("Gabor", "gabor", "nn_cosine"), Arm("LBP", "lbp", "nn_chi2"))
_DEEP = (Arm("DepthPCA", "depth_pca", "nn_cosine"), Arm("NormalHOG", "normal_hog", "nn_cosine"), Arm("DepthLBP", "depth_lbp", "nn_chi2"), Arm("CurvHist", "curv_hist", "nn_chi2"))
_PAIR = (Arm("2D-PCA", "pca", "nn_cosine"), Arm("3D-DepthPCA", "depth_pca", "nn_cosine"))
_BEST = (Arm("best-2D", "pca", "nn_cosine"),)
#: The standard workload.
EXPERIMENTS = {
    e.id: e
    for e in (
        Experiment("E00", "toy", _BOTH, _SEEDS, _PAIR),
        Experiment("E01", "yaleb", _BOTH, _SEEDS, _FLAT),
        Experiment("E02", "toy", _BOTH, _SEEDS, (*_DEEP, Arm("Lmk3D", "lmk3d", "nn_l2"))),
        Experiment("E03", "toy", _BOTH, _SEEDS, _PAIR),
        Experiment("E04", "toy", ("P2_disjoint",), _SEEDS, _BEST),
        Experiment("E05", "yaleb", ("P2_disjoint",), _SEEDS, _BEST),
        Experiment("E08", "yaleb", ("P2_disjoint",), _SEEDS, _BEST, (("sunglasses_20", "sunglasses", 0.2), ("block_20", "block", 0.2), ("block_30", "block", 0.3), ("block_40", "block", 0.4))),
        Experiment("E10", "yaleb", ("P2_disjoint",), _SEEDS, _BEST, verification=False),
        Experiment("E11", "tufts3d", _BOTH, _SEEDS, _FLAT),
        Experiment("E12", "tufts3d", _BOTH, _SEEDS, _DEEP),
        Experiment("E13", "tufts3d", _BOTH, _SEEDS, (*_FLAT[:3], *_DEEP[:2], _DEEP[3])),
    )
}


def _side(name: str) -> str:
    return "landmarks" if name == "lmk3d" else "depth" if name.startswith("depth") or name in ("normal_hog", "curv_hist") else "image"


def kinds(experiment: Experiment) -> tuple[str, ...]:
    """The kinds of arrays that an experiment's arms read."""
    return tuple(sorted({_side(a.feature) for a in experiment.arms}))


def _fixed(kernel):
    """A feature without a fit."""
    return lambda train, rows, column, size, **how: K.apply(rows, column, partial(kernel, **how), (size, size))


def _pca(train: DataFrame, rows: DataFrame, column: str, size: int, keep: float = 0.95, most: int = 150, drop: int = 0) -> DataFrame:
    p = estimators.fit_pca(train, column, keep, most)
    if drop >= p.axes.shape[1]:
        raise ValueError(f"all {p.axes.shape[1]} components would be dropped")
    return estimators.Projection(p.mean, p.axes[:, drop:], p.explained[drop:]).transform(rows, column)


def _lda(train: DataFrame, rows: DataFrame, column: str, size: int, most: int = 50) -> DataFrame:
    return estimators.fit_lda(train, column, most).transform(rows, column)


def _gabor(train: DataFrame, rows: DataFrame, column: str, size: int, most: int = 200, **how) -> DataFrame:
    raw = lambda d: K.apply(d, column, partial(K.gabor, **how), (size, size))
    return estimators.fit_pca(raw(train), "template", keep=1.0, most=most).transform(raw(rows), "template")


def _curvature(train: DataFrame, rows: DataFrame, column: str, size: int, bins: int = 16) -> DataFrame:
    """Mean and Gaussian curvature and shape index, ``bins`` each."""
    c = fields.curvature(fields.to_grid(rows, size, column)).select("sample_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(n).alias("z")) for i, n in enumerate(("h", "k", "shape_index"))])).alias("v"))
    c = c.select(F.concat_ws("\t", F.col("sample_id").cast("string"), F.col("v.ch").cast("string")).alias("sample_id"), "v.z")
    h = fields.curvature_histogram(c, bins).select(F.split("sample_id", "\t").alias("k"), "bin", "share")
    h = h.select(F.element_at("k", 1).alias("sid"), (F.element_at("k", 2).cast("int") * bins + F.col("bin")).alias("i"), "share")
    packed = h.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("i", "share"))).alias("m"))
    x = rows.select("sample_id", "subject_id").join(packed, rows["sample_id"].cast("string") == packed["sid"])
    return x.select("sample_id", "subject_id", F.transform(F.sequence(F.lit(0), F.lit(3 * bins - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("template"))


def _landmarks(train: DataFrame, rows: DataFrame, column: str, size: int) -> DataFrame:
    """Distances among the five marks in space, over that of the first two."""
    v = F.col(column)
    points = rows.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), v.alias("v"))
    at = lambda k: F.element_at("v", F.col("i") * 3 + k)
    d = fields.landmark_distances(points.select("sample_id", "i", at(1).alias("px"), at(2).alias("py"), at(3).alias("pz")))
    packed = d.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "d"))), lambda x: x["d"]).alias("template"))
    return rows.select("sample_id", "subject_id").join(packed, "sample_id")


def _normal_hog(a, **how):
    return K.hog(_slope(_normals(a)), **how)


def _slope(n):
    import numpy as np

    return np.linalg.norm(n[..., :2], axis=2)


def _unavailable(train, rows, column, size):
    raise RuntimeError("this feature needs an external network's weights, which aren't shipped")


for _n, _f in {
    "pca": _pca, "depth_pca": _pca, "lda": _lda, "lbp": _fixed(K.lbp), "depth_lbp": _fixed(K.lbp), "hog": _fixed(K.hog),
    "normal_hog": _fixed(_normal_hog), "gabor": _gabor, "curv_hist": _curvature, "lmk3d": _landmarks, "arcface": _unavailable,
}.items():
    FEATURES.add(_n, _f)


def _square(v) -> int:
    v = [int(x) for x in (v if isinstance(v, (list, tuple)) else (v, v))]
    if len(v) != 2 or v[0] != v[1] or v[0] < 1:
        raise ValueError(f"{v} must be two equal positive numbers")
    return v[0]


_AXES = {"variance_keep": ("keep", float), "max_components": ("most", int), "drop_first_k": ("drop", int)}
_PATTERNS = {"points": ("points", int), "radius": ("radius", float), "blocks": ("blocks", int)}
_GRADIENTS = {"orientations": ("orientations", int), "pixels_per_cell": ("cell", _square), "cells_per_block": ("block", _square)}
#: Parameters of features and matchers by their names in files: the argument, and how its value is read.
PARAMETERS = {
    "pca": _AXES, "depth_pca": _AXES, "lda": {"max_components": ("most", int)}, "lbp": _PATTERNS, "depth_lbp": _PATTERNS, "hog": _GRADIENTS, "normal_hog": _GRADIENTS, "curv_hist": {"bins": ("bins", int)},
    "gabor": {"frequencies": ("frequencies", lambda v: tuple(map(float, v))), "orientations": ("orientations", int), "downsample_factor": ("factor", int), "pca_components": ("most", int)},
}
MATCHER_PARAMETERS = {"svm_linear": {"C": ("c", float)}, "svm_rbf": {"C": ("c", float), "gamma": ("gamma", lambda v: None if v == "scale" else float(v))}, "knn3": {"k": ("k", int)}}


def arguments(known: dict, name: str, given: dict) -> dict:
    """Arguments from the parameters of a file; unknown ones are errors."""
    names = known.get(name, {})
    if unknown := sorted(set(given) - set(names)):
        raise ValueError(f"{name} has no parameters {unknown}; known: {sorted(names)}")
    return {names[k][0]: names[k][1](v) for k, v in given.items()}


def feature_of(arm: Arm):
    """An arm's feature with its parameters: (train, rows, column, size) to templates."""
    return partial(FEATURES.get(arm.feature), **arguments(PARAMETERS, arm.feature, arm.feature_params))


def _normals(a):
    import numpy as np

    dy, dx = np.gradient(a)
    n = np.stack([-dx, -dy, np.ones_like(a)], -1)
    return n / np.linalg.norm(n, axis=-1, keepdims=True)


def gallery_of(captures: DataFrame) -> DataFrame:
    """One frontal, neutral, normally lit capture of each subject; where a subject has none, its first by
    the light's number."""
    strict = splits.frontal_neutral(captures)
    rest = captures.join(strict.select("subject_id").distinct(), "subject_id", "left_anti")
    return splits.select_gallery(strict, []).unionByName(splits.select_gallery(rest, splits.fallback_order(F.col("illumination"))))


def roles(captures: DataFrame, protocol: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train rows, split rows with role) of a protocol. Training rows are the gallery (closed) or the
    background subjects (disjoint). A split without gallery or probes is an error."""
    if protocol == "P1_closed":
        gallery = gallery_of(captures)
        train, split = captures.join(gallery.select("sample_id"), "sample_id", "left_semi"), splits.closed(captures, gallery)
    elif protocol == "P2_disjoint":
        part = splits.disjoint_subjects(captures, seed)
        train = captures.join(part.where("part = 'background'"), "subject_id", "left_semi")
        rest = captures.join(part.where("part = 'evaluation'"), "subject_id", "left_semi")
        split = splits.closed(rest, gallery_of(rest))
    else:
        raise ValueError(f"unknown protocol {protocol!r}")
    n = {r["role"]: r["count"] for r in split.groupBy("role").count().collect()}
    if not n.get("gallery") or not n.get("probe"):
        raise ValueError(f"the split {protocol}, seed {seed}, has no {'probes' if n.get('gallery') else 'gallery'}")
    return train, split


def occluded(rows: DataFrame, kind: str, share: float, seed: int, size: int) -> DataFrame:
    """Rows (sample_id, subject_id, image) with part of each image set to its median: the eyes, or a block whose
    place follows from the capture's id."""
    import numpy as np

    h, w = fields.block_size(size, size, share)
    top, left, eh, ew = fields.sunglasses(size, size)
    place = lambda what, n: C.hash32(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col("sample_id").cast("string"))) % (size - n + 1)

    def cover(a: np.ndarray) -> np.ndarray:
        a, at = a[:-2].reshape(size, size).copy(), a[-2:].astype(int)
        y, x, n, m = (top, left, eh, ew) if kind == "sunglasses" else (at[0], at[1], h, w)
        a[y : y + n, x : x + m] = np.median(a)
        return a

    if kind not in ("sunglasses", "block", "random"):
        raise ValueError(f"unknown occlusion {kind!r}")
    x = rows.withColumn("image", F.concat("image", F.array(place("y", h), place("x", w)).cast("array<double>")))
    return K.apply(x, "image", cover, (size * size + 2,), "image")


@dataclass(frozen=True)
class ArmResult:
    """What an arm leaves: its record (one row), decisions, figures by class, and the scores of its pairs (a, b, y, score;
    None without verification). All are written tables."""

    record: DataFrame
    decided: DataFrame
    classes: DataFrame
    scores: DataFrame | None


def verification_pairs(pool: DataFrame, seed: int, ratio: int = 20) -> DataFrame:
    """Rows (a, b, y): all genuine pairs of the captures, and ``ratio`` impostor pairs for each while there are as many."""
    samples = pool.select("sample_id", "subject_id")
    n = samples.groupBy("subject_id").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    if not n:
        raise ValueError("no subject has two captures, so there are no genuine pairs")
    genuine = splits.genuine_pairs(samples).withColumn("y", F.lit(1))
    return genuine.unionByName(splits.impostor_pairs(samples, ratio * n, seed).withColumn("y", F.lit(0)))


def evaluate_arm(
    captures: DataFrame, arm: Arm, protocol: str, seed: int, scratch: Scratch, size: int = 64, verify: bool = True, conditions: tuple[tuple[str, str, float], ...] = (), replicates: int = 1000,
    split: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> ArmResult:
    """An arm over captures with sample_id, subject_id, pose, light and arrays. ``split`` has its training rows' ids, roles
    and pairs, if they are given and not drawn here. ``conditions`` are occlusions of the probes; the gallery stays as it is.

    Templates, decisions, scores and one table of counts are written as they are made, so no plan holds another
    one's; every figure of the curve comes from those counts.
    """
    column, kind, feature = _side(arm.feature), MATCHERS.get(arm.matcher), feature_of(arm)
    train, roles_ = roles(captures, protocol, seed) if split is None else (captures.join(split[0], "sample_id", "left_semi"), split[1])
    rows = captures.join(roles_.select("sample_id"), "sample_id", "left_semi")
    side = lambda t, r: t.join(roles_.where(F.col("role") == r).select("sample_id"), "sample_id", "left_semi")
    templates = scratch.keep(feature(train, rows, column, size), "templates")
    gallery = side(templates, "gallery")
    n_gallery = gallery.select("subject_id").distinct().count()
    decided = scratch.keep(identification.decide(side(templates, "probe"), gallery, kind, "template"), "decided")
    identification.check_decided(decided)
    classes = scratch.keep(identification.per_class(decided, gallery), "classes")
    of = lambda d, *cols: d.agg(F.map_from_entries(F.collect_list(F.struct(cols[0], F.struct(*cols[1:])))).alias("m"))
    shown = captures.select(F.col("sample_id").alias("probe_id"), C.condition(F.col("pose_yaw"), F.col("illumination")).alias("condition"))
    one = identification.metrics(decided, n_gallery).select("rank1", "rank5", "rank10", F.col("rank5").alias("top5_accuracy"), "mrr", "accuracy", "n_probe", "n_gallery")
    one = one.join(identification.averages(classes)).join(identification.cmc(decided).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "rate"))), lambda x: x["rate"]).alias("cmc")))
    one = one.join(of(classes, "subject_id", "precision", "recall", "f1", "support").withColumnRenamed("m", "per_class"))
    one = one.join(of(identification.per_condition(decided, shown), "condition", "rank1", "n").withColumnRenamed("m", "per_condition"))
    out = one.select(F.struct(*[f.name for f in IDENTIFICATION]).cast(IDENTIFICATION).alias("identification"))
    scores = None
    if verify:
        pairs = verification_pairs(rows, seed) if split is None else split[2]
        scores = scratch.keep(scoring.score_pairs(pairs, templates, kind, "template"), "scores")
        by = scratch.keep(verification.count_scores(scores), "counts")
        v = verification.summary(scratch.keep(verification.running_counts(by), "curve"))
        if replicates:
            drawn = verification.bootstrap_counts(by, replicates, seed)
            v = v.join(verification.intervals(drawn).where("metric = 'eer'").select(F.array("lo", "hi").alias("eer_ci95")))
        else:
            v = v.withColumn("eer_ci95", F.lit(None).cast("array<double>"))
        v = v.withColumn("genuine", F.struct(F.col("genuine_mean").alias("mean"), F.col("genuine_std").alias("std"))).withColumn("impostor", F.struct(F.col("impostor_mean").alias("mean"), F.col("impostor_std").alias("std")))
        out = out.join(v.select(F.struct(*[f.name for f in VERIFICATION]).cast(VERIFICATION).alias("verification")))
    else:
        out = out.withColumn("verification", F.lit(None).cast(VERIFICATION))
    robust = F.lit(None).cast("map<string,struct<rank1:double,n:bigint>>")
    if conditions:
        if column != "image":
            raise ValueError("occlusions are for arms on photos")
        found = None
        for name, how, share in conditions:
            covered = side(rows, "probe").select("sample_id", "subject_id", column)
            probe = feature(train, occluded(covered, how, share, seed, size), column, size)
            m = identification.metrics(scratch.keep(identification.decide(probe, gallery, kind, "template"), "covered"), n_gallery).select(F.lit(name).alias("condition"), "rank1", F.col("n_probe").alias("n"))
            found = m if found is None else found.unionByName(m)
        out = out.join(of(found, "condition", "rank1", "n"))
        robust = F.col("m")
    record = out.select(F.lit(arm.key).alias("arm"), F.lit(protocol).alias("protocol"), F.lit(seed).cast("long").alias("seed"), F.lit(arm.feature).alias("feature"), F.lit(arm.matcher).alias("matcher"), "identification", "verification", robust.alias("robustness"))
    return ArmResult(scratch.keep(record, "record"), decided, classes, scores)


def run_arm(captures: DataFrame, arm: Arm, protocol: str, seed: int, size: int = 64, verify: bool = True, conditions: tuple[tuple[str, str, float], ...] = (), replicates: int = 1000) -> DataFrame:
    """The run record (one row) of ``evaluate_arm``; its other tables are deleted."""
    with Scratch(captures.sparkSession) as scratch:
        return keep(evaluate_arm(captures, arm, protocol, seed, scratch, size, verify, conditions, replicates).record, "record")


def run(captures: DataFrame, experiment: Experiment, size: int = 64, done: set[tuple] = frozenset(), modality: str | None = None, replicates: int = 1000) -> DataFrame | None:
    """All run records of an experiment but those in ``done`` (protocol, seed, arm); None if nothing is left. Each run is
    done and written before the next begins."""
    out = None
    for protocol in experiment.protocols:
        for seed in experiment.seeds:
            for arm in experiment.arms:
                if (protocol, seed, arm.key) not in done:
                    one = run_arm(captures, arm, protocol, seed, size, experiment.verification, experiment.conditions, replicates)
                    out = one if out is None else out.unionByName(one)
    return out.select(F.lit(experiment.id).alias("exp_id"), F.lit(experiment.dataset).alias("dataset"), F.lit(modality).cast("string").alias("data_modality"), "*") if out is not None else None
