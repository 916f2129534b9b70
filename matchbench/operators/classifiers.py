"""Classifiers of templates: nearest neighbours by vote, and support vector machines of each subject against the rest.

Machines minimise half the squared weights plus C times the squared hinge losses; a constant 1 after the template carries
the bias, which is regularised with the rest. All machines share a bound of their second derivatives (the identity plus 2 C
times the rows' second moment), so a pass over the rows is a sum of one vector for each subject and a step is one solution
with a matrix that is factored once. Passes are accelerated, with a restart where a step goes uphill.

Subjects are taken in blocks whose weights fit ``BROADCAST_BYTES``; rows never leave the executors. A template has at most
``WIDE`` numbers (longer ones are to be projected first). Empty training tables are an error; rows whose vector is null are
left out of training and predicted by no machine; equal decisions go to the least subject.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import doubles
from ..model import BROADCAST_BYTES
from ..registry import Registry
from .estimators import WIDE, moments
from .scoring import _matrix, score_blocks

CLASSIFIERS = Registry("classifier")
#: Training rows that stand for all others in the kernel's features, at most; passes at most, and the step (against the weights)
#: below which machines are done.
LANDMARKS, PASSES, ACCURACY = 512, 400, 1e-5


def vote_nearest(probe: DataFrame, train: DataFrame, k: int = 3, kind: str = "l2", vector: str = "embedding") -> DataFrame:
    """Rows (probe_id, predicted, votes): the subject of most of a probe's ``k`` nearest training rows. Equally near
    rows go by their ids, equal votes by subject. A task keeps k rows a probe and block of training rows."""
    near = score_blocks(probe, train, kind, vector, top=k)
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "gallery_id")
    near = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    of = train.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").cast("string").alias("predicted"))
    votes = near.join(of, "gallery_id").groupBy("probe_id", "predicted").agg(F.count("*").alias("votes"))
    best = votes.groupBy("probe_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "predicted")).alias("b"))
    return best.select("probe_id", "b.predicted", (-F.col("b.v")).alias("votes"))


@dataclass(frozen=True)
class KernelMap:
    """Features whose products are exp(-gamma |a - b|^2): exactly between landmarks, else by way of them."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * _squares(m, self.landmarks)) @ self.root


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0)


def kernel_map(train: DataFrame, vector: str = "v", landmarks: int = LANDMARKS, gamma: float | None = None) -> KernelMap:
    """Landmarks are the training rows with the least digests of their ids. ``gamma`` is by default one over the template's
    length times the variance of all its numbers."""
    if gamma is None:
        n, s, ss = moments(train, vector)
        spread = np.trace(ss) / (n * len(s)) - (s.sum() / (n * len(s))) ** 2
        gamma = 1 / (len(s) * spread) if spread > 0 else 1.0
    rows = train.orderBy(F.md5(F.col("sample_id").cast("string")), "sample_id").limit(landmarks).select(vector).toArrow()
    m = np.unique(_matrix(rows.column(0)), axis=0)
    values, axes = np.linalg.eigh(np.exp(-gamma * _squares(m, m)))
    kept = values > values.max() * 1e-10
    return KernelMap(m, axes[:, kept] / np.sqrt(values[kept]), gamma)


@dataclass(frozen=True)
class Machines:
    """Blocks of (subjects in order, weights with the bias last), and what maps templates to features."""

    blocks: list[tuple[list[str], np.ndarray]]
    features: KernelMap | None
    passes: int

    def predict(self, probe: DataFrame, vector: str = "embedding") -> DataFrame:
        """Rows (probe_id, predicted, margin)."""
        kind = f"probe_id {probe.schema['sample_id'].dataType.simpleString()}, predicted string, margin double"
        p = probe.where(F.col(vector).isNotNull()).select("sample_id", doubles(F.col(vector)).alias("v"))
        out = None
        for block in self.blocks:
            one = p.mapInArrow(_best(p.sparkSession.sparkContext.broadcast((*block, self.features))), kind)
            out = one if out is None else out.unionByName(one)
        if len(self.blocks) == 1:
            return out
        best = out.groupBy("probe_id").agg(F.min(F.struct((-F.col("margin")).alias("m"), "predicted")).alias("b"))
        return best.select("probe_id", "b.predicted", (-F.col("b.m")).alias("margin"))


def _best(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, features = shared.value
        step = max(1, 4_000_000 // len(names))
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                f = _augmented(_matrix(part.column(1)), features) @ w.T
                at = f.argmax(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[i] for i in at], pa.string()), pa.array(f[np.arange(len(f)), at])], ["probe_id", "predicted", "margin"])

    return run


def _augmented(m: np.ndarray, features: KernelMap | None) -> np.ndarray:
    m = m if features is None else features(m)
    return np.column_stack((m, np.ones(len(m))))


def _pull(rows: DataFrame, names: list[str], w: np.ndarray, features: KernelMap | None) -> np.ndarray:
    """For each machine the sum over rows of slack times sign times features: added in tasks, then subject by subject."""
    shared = rows.sparkSession.sparkContext.broadcast((names, w, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, features = shared.value
        place = {x: i for i, x in enumerate(names)}
        total, step = np.zeros_like(w), max(1, 4_000_000 // len(names))
        for b in batches:
            for lo in range(0, len(b), step):
                part = b.slice(lo, step)
                x = _augmented(_matrix(part.column(1)), features)
                sign = np.full((len(x), len(names)), -1.0)
                own = np.array([place.get(s, -1) for s in part.column(0).to_pylist()], np.int64)
                at = np.flatnonzero(own >= 0)
                sign[at, own[at]] = 1.0
                total += (sign * np.maximum(0.0, 1 - sign * (x @ w.T))).T @ x
        yield pa.RecordBatch.from_pydict({"machine": pa.array(np.arange(len(names), dtype=np.int32)), "sums": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table({"machine": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    got = rows.select("subject_id", "v").mapInArrow(run, "machine int, sums binary").groupBy("machine").applyInArrow(add, "machine int, sums binary").collect()
    shared.unpersist()
    out = np.zeros_like(w)
    for r in got:
        out[r["machine"]] = np.frombuffer(r["sums"])
    return out


def _minimise(rows: DataFrame, names: list[str], bound: np.ndarray, c: float, features: KernelMap | None) -> tuple[np.ndarray, int]:
    solve = np.linalg.inv(bound)
    w = np.zeros((len(names), len(bound)))
    ahead, t = w.copy(), np.ones(len(names))
    for turn in range(1, PASSES + 1):
        slope = ahead - 2 * c * _pull(rows, names, ahead, features)
        new = ahead - slope @ solve
        uphill = (slope * (new - w)).sum(1) > 0
        t_new = np.where(uphill, 1.0, (1 + np.sqrt(1 + 4 * t * t)) / 2)
        ahead = new + np.where(uphill, 0.0, (t - 1) / t_new)[:, None] * (new - w)
        moved = np.abs(new - w).max(1) / np.maximum(1e-12, np.abs(new).max(1))
        w, t = new, t_new
        if moved.max() < ACCURACY:
            return w, turn
    raise ValueError(f"the machines moved by {moved.max():.1e} still after {PASSES} passes; take a smaller C")


def fit_machines(train: DataFrame, kernel: str = "linear", c: float = 1.0, vector: str = "embedding", landmarks: int = LANDMARKS, gamma: float | None = None, block_bytes: int = BROADCAST_BYTES) -> Machines:
    """One machine for each subject of (sample_id, subject_id, vector), by ``linear`` or ``rbf`` kernel."""
    if kernel not in ("linear", "rbf"):
        raise KeyError(f"unknown kernel {kernel!r}")
    rows = train.where(F.col(vector).isNotNull() & F.col("subject_id").isNotNull()).select("sample_id", F.col("subject_id").cast("string"), doubles(F.col(vector)).alias("v")).persist()
    try:
        long = rows.agg(F.max(F.size("v"))).first()[0]
        if long is None:
            raise ValueError("there are no rows to fit")
        if long > WIDE:
            raise ValueError(f"templates of {long} numbers must be projected to {WIDE} at most first")
        features = kernel_map(rows, "v", landmarks, gamma) if kernel == "rbf" else None
        mapped = rows.mapInArrow(_mapped(rows.sparkSession.sparkContext.broadcast(features)), "v array<double>")
        _, s, ss = moments(mapped, "v")
        bound = np.eye(len(s)) + 2 * c * ss
        subjects = rows.select("subject_id").distinct()
        n = -(-subjects.count() * len(s) * 8 // block_bytes)
        blocks, passes = [], 0
        for k in range(n):
            names = sorted(r[0] for r in subjects.where(F.pmod(F.xxhash64("subject_id"), F.lit(n)) == k).collect())
            if names:
                w, turns = _minimise(rows, names, bound, c, features)
                blocks.append((names, w))
                passes += turns
        return Machines(blocks, features, passes)
    finally:
        rows.unpersist()


def _mapped(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(list(_augmented(_matrix(b.column(2)), shared.value)), pa.list_(pa.float64()))], ["v"])

    return run


@CLASSIFIERS.register("svm_linear")
def _svm_linear(probe, train, vector, **how):
    return fit_machines(train, "linear", vector=vector, **how).predict(probe, vector).select("probe_id", "predicted")


@CLASSIFIERS.register("svm_rbf")
def _svm_rbf(probe, train, vector, **how):
    return fit_machines(train, "rbf", vector=vector, **how).predict(probe, vector).select("probe_id", "predicted")


@CLASSIFIERS.register("knn3")
def _knn3(probe, train, vector, k=3):
    return vote_nearest(probe, train, k, vector=vector).select("probe_id", "predicted")


def classify(name: str, probe: DataFrame, train: DataFrame, vector: str = "embedding", **how) -> DataFrame:
    """Rows (probe_id, predicted) of a registered classifier. (Their scores of pairs are cosines: see ``registry``.)"""
    return CLASSIFIERS.get(name)(probe, train, vector, **how)
