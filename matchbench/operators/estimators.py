"""Templates that are fitted on training rows only: principal components and linear discriminants.

Fits need second moments: each task sums them over its Arrow batches, the tasks' matrices are added in
executors block of rows by block of rows, and one d x d sum reaches the driver (d the length of a
template), whatever the number of rows, tasks and subjects. Principal components of longer templates go without that matrix. Discriminants need one vector for each
subject besides, and those stay in executors, where their outer products are summed likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import doubles
from .scoring import _matrix


@dataclass(frozen=True)
class Projection:
    """(x - mean) @ axes."""

    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def transform(self, df: DataFrame, vector: str = "embedding", out: str = "template") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.axes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, axes = shared.value
            for b in batches:
                rows = (_matrix(b.column(2)) - mean) @ axes if len(b) else np.empty((0, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(rows), pa.list_(pa.float64()))], ["sample_id", "subject_id", out])

        x = df.select("sample_id", "subject_id", doubles(F.col(vector)).alias("v"))
        return x.mapInArrow(run, f"sample_id {x.schema['sample_id'].dataType.simpleString()}, subject_id string, {out} array<double>")

    @property
    def template_bytes(self) -> int:
        return 4 * self.axes.shape[1]

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """One row in a table, written by Spark, so that any of its file systems will do."""
        spark = spark or SparkSession.getActiveSession()
        row = (self.mean.tolist(), self.axes.ravel().tolist(), self.explained.tolist())
        spark.createDataFrame([row], "mean array<double>, axes array<double>, explained array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, spark: SparkSession | None = None) -> Projection:
        r = (spark or SparkSession.getActiveSession()).read.parquet(path).first()
        return Projection(np.array(r["mean"]), np.array(r["axes"]).reshape(len(r["mean"]), -1), np.array(r["explained"]))


#: Rows of a d x d matrix that are added in one group.
MATRIX_ROWS = 64


def moments(rows: DataFrame, vector: str = "v", weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, sum of their vectors, and sum of the outer products. With ``weight``, a row stands
    for a group: its vector is the group's sum, and its outer product is divided by the group's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0.0, None, None
        for b in batches:
            if not len(b):
                continue
            m, w = _matrix(b.column(1)), b.column(0).to_numpy()
            n, s = n + w.sum(), m.sum(0) + (0 if s is None else s)
            ss = (m / w[:, None]).T @ m + (0 if ss is None else ss)
        if s is not None:
            for at in range(0, len(s), MATRIX_ROWS):
                yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "sums": pa.array([ss[at : at + MATRIX_ROWS].tobytes()], pa.binary())})
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "sums": pa.array([np.append(s, n).tobytes()], pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    of = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.select(of.alias("w"), doubles(F.col(vector)).alias("v")).mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
    if not parts:
        raise ValueError("there are no rows to fit")
    found = {r["part"]: np.frombuffer(r["sums"]) for r in parts}
    first = found.pop(-1)
    return float(first[-1]), first[:-1], np.concatenate([found[k] for k in sorted(found)]).reshape(len(first) - 1, -1)


def subject_sums(train: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows (subject_id, n, v): each subject's count and vector sum, added up within batches first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                names, at = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
                m = _matrix(b.column(1))
                v = np.zeros((len(names), m.shape[1]))
                np.add.at(v, at, m)
                yield pa.RecordBatch.from_pydict({"subject_id": pa.array(names.tolist()), "n": pa.array(np.bincount(at)), "v": pa.array(list(v), pa.list_(pa.float64()))})

    def total(key, table):
        return pa.table({"subject_id": [key[0].as_py()], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "v": pa.array([_matrix(table.column("v")).sum(0)], pa.list_(pa.float64()))})

    kind = "subject_id string, n long, v array<double>"
    return train.select(F.col("subject_id").cast("string"), doubles(F.col(vector)).alias("v")).mapInArrow(partial, kind).groupBy("subject_id").applyInArrow(total, kind)


def _signed(axes: np.ndarray) -> np.ndarray:
    """The largest entry of each axis is positive."""
    at = np.abs(axes).argmax(0)
    return axes * np.where(axes[at, np.arange(axes.shape[1])] < 0, -1, 1)


#: Rows up to which their products with each other are taken instead of the columns', and columns up to which a
#: d x d matrix is summed. Columns of a piece in the first way; passes, spare axes and accuracy of the third.
GRAM_ROWS, WIDE, PIECE = 2048, 2048, 1024
PASSES, SPARE, CLOSE = 40, 20, 1e-10


def fit_pca(train: DataFrame, vector: str = "embedding", keep: float = 0.95, most: int = 150) -> Projection:
    """Components up to the first at which ``keep`` of the variance is reached, at most ``most``.

    Few rows of many columns: eigenvectors of the rows' products, in pieces of columns (``_gram``). Few columns:
    second moments. Many of both: power iteration on a block of axes (``_iterated``). Nothing larger than
    ``GRAM_ROWS`` squared, ``WIDE`` squared or a template times the axes is held anywhere.
    """
    r = train.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    if not r["n"]:
        raise ValueError("there are no rows to fit")
    if r["n"] <= min(r["d"], GRAM_ROWS):
        return _gram(train, vector, keep, most, r["n"], r["d"])
    if r["d"] > WIDE:
        return _iterated(train, vector, keep, most, r["n"], r["d"])
    n, s, ss = moments(train, vector)
    mean = s / n
    values, axes = np.linalg.eigh(ss / n - np.outer(mean, mean))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    k = _kept(values, keep, most, int(n))
    return Projection(mean, _signed(axes[:, :k]), values[:k] / max(values.sum(), 1e-300))


def _kept(values: np.ndarray, keep: float, most: int, n: int, total: float | None = None) -> int:
    share = np.cumsum(values) / max(values.sum() if total is None else total, 1e-300)
    return min(int(np.searchsorted(share, keep - 1e-12)) + 1, most, n, len(values))


def _gram(train: DataFrame, vector: str, keep: float, most: int, n: int, d: int) -> Projection:
    """From the n x n products of the centred rows: with U and S of those, the axes are the rows' combinations
    U / S. Rows are cut in pieces of columns; a task has one piece of all rows, n x ``PIECE`` numbers."""
    x = train.select("sample_id", doubles(F.col(vector)).alias("v")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(d - 1), F.lit(PIECE))))
    pieces = x.select("sample_id", "p", F.slice("v", F.col("p") + 1, PIECE).alias("v"))

    def centred(table):
        m = _matrix(table.sort_by("sample_id").column("v"))
        return m.mean(0), m - m.mean(0)

    def products(key, table):
        mean, m = centred(table)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "mean": pa.array([mean.tobytes()], pa.binary()), "g": pa.array([(m @ m.T).tobytes()], pa.binary())})

    by = pieces.groupBy("p").applyInArrow(products, "p int, mean binary, g binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for k in range(len(b)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([None], pa.binary())], ["p", "mean", "g"])
                g = np.frombuffer(b.column(2)[k].as_buffer())
                total = g + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], ["p", "mean", "g"])

    found = by.mapInArrow(add, "p int, mean binary, g binary").collect()
    gram = sum(np.frombuffer(r["g"]) for r in found if r["g"] is not None).reshape(n, n) / n
    mean = np.concatenate([np.frombuffer(r["mean"]) for r in sorted((r for r in found if r["mean"] is not None), key=lambda r: r["p"])])
    values, turn = np.linalg.eigh(gram)
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    k = min(_kept(values, keep, most, n), max(1, int((values > values[0] * 1e-12).sum())))
    combine = turn[:, :k] / np.sqrt(np.maximum(values[:k] * n, 1e-300))

    def axes(key, table):
        return pa.table({"p": pa.array([key[0].as_py()], pa.int32()), "a": pa.array([(centred(table)[1].T @ combine).tobytes()], pa.binary())})

    parts = sorted((r["p"], r["a"]) for r in pieces.groupBy("p").applyInArrow(axes, "p int, a binary").collect())
    return Projection(mean, _signed(np.concatenate([np.frombuffer(a).reshape(-1, k) for _, a in parts])), values[:k] / max(values.sum(), 1e-300))


def _iterated(train: DataFrame, vector: str, keep: float, most: int, n: int, d: int) -> Projection:
    """Power iteration on a block of ``most`` + ``SPARE`` axes: a pass multiplies the centred rows' second moments with
    the block, task by task, and the block is made orthogonal again, until its variances stand still. A last pass
    takes the rows' coordinates, and their triangular factors task by task (so their squares are never
    formed): the factors' singular values and vectors give variances and axes."""
    rows, spark = train.select(doubles(F.col(vector)).alias("v")), train.sparkSession
    width = min(most + SPARE, n, d)

    def summed(f) -> list[np.ndarray]:
        """The sum over all tasks of the arrays that ``f`` adds up over a task's matrices, and their number of rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if len(b):
                    one = f(_matrix(b.column(0)))
                    total = one if total is None else [x + y for x, y in zip(total, one, strict=True)]
            for k, x in enumerate(total or []):
                for at in range(0, len(x), MATRIX_ROWS * 16):
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": pa.array([at], pa.int32()), "sums": pa.array([np.ascontiguousarray(x[at : at + MATRIX_ROWS * 16]).tobytes()], pa.binary())})

        def add(key, table):
            total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
            return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        got: dict[int, dict[int, np.ndarray]] = {}
        for r in rows.mapInArrow(run, "k int, part int, sums binary").groupBy("k", "part").applyInArrow(add, "k int, part int, sums binary").collect():
            got.setdefault(r["k"], {})[r["part"]] = np.frombuffer(r["sums"])
        return [np.concatenate([got[k][p] for p in sorted(got[k])]) for k in sorted(got)]

    total, squares = summed(lambda m: [m.sum(0), (m * m).sum(0)])
    mean = total / n
    variance = float(np.maximum(squares / n - mean * mean, 0).sum())
    block, before = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).normal(size=(d, width)))[0], None
    for _ in range(PASSES):
        held = spark.sparkContext.broadcast(block)
        image = summed(lambda m, held=held: [(m - mean).T @ ((m - mean) @ held.value)])[0].reshape(d, width) / n
        held.unpersist()
        values = np.sort(np.linalg.eigvalsh((block.T @ image + image.T @ block) / 2))[::-1]
        block = np.linalg.qr(image)[0]
        if before is not None and np.abs(values[:most] - before[:most]).max() <= CLOSE * values[0]:
            break
        before = values
    held = spark.sparkContext.broadcast(block)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.empty((0, width))
        for b in batches:
            if len(b):
                r = np.linalg.qr(np.vstack((r, (_matrix(b.column(0)) - mean) @ held.value)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def joined(key, table):
        r = np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, width) for b in table.column("r").to_pylist()]), mode="r")
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    few = rows.mapInArrow(factors, "r binary").withColumn("g", F.floor(F.rand(1) * 64)).groupBy("g").applyInArrow(joined, "r binary").collect()
    _, size, turn = np.linalg.svd(np.vstack([np.frombuffer(r["r"]).reshape(-1, width) for r in few]), full_matrices=False)
    values = size * size / n
    k = _kept(values, keep, most, n, variance)
    return Projection(mean, _signed((block @ turn.T)[:, :k]), values[:k] / max(variance, 1e-300))


def fit_lda(train: DataFrame, vector: str = "embedding", most: int = 50) -> Projection:
    """Directions that part the subjects, at most one fewer than subjects. Needs more rows than subjects;
    with a single subject, the mean residual."""
    by = subject_sums(train, vector)
    subjects = by.count()
    n, total, ss = moments(train, vector)
    mean = total / n
    if subjects == 1:
        return Projection(mean, np.full((len(mean), 1), 1 / len(mean)), np.ones(1))
    if n <= subjects:
        raise ValueError("discriminants need more samples than subjects")
    _, _, means = moments(by, "v", "n")
    within = (ss - means) / (n - subjects)
    between = (means - np.outer(total, total) / n) / n
    values, axes = np.linalg.eigh(within)
    good = values > 1e-10 * values.max()
    white = axes[:, good] / np.sqrt(values[good])
    power, turn = np.linalg.eigh(white.T @ between @ white)
    k = min(most, subjects - 1, len(power))
    power, turn = power[::-1][:k], turn[:, ::-1][:, :k]
    return Projection(mean, _signed(white @ turn), power / max(power.sum(), 1e-300))
