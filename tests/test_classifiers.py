"""Classifiers against brute force in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbench.operators import classifiers


def table(spark, m, names, start=0):
    return spark.createDataFrame([(start + i, n, [float(x) for x in row]) for i, (row, n) in enumerate(zip(m, names, strict=True))], "sample_id long, subject_id string, embedding array<double>")


@pytest.fixture(scope="module")
def faces():
    r = np.random.default_rng(5)
    names = [f"S{k:03d}" for k in r.choice(5, 90, p=[0.4, 0.2, 0.2, 0.1, 0.1])]
    centre = r.normal(0, 1, (5, 6))
    return np.array([centre[int(n[1:])] for n in names]) + r.normal(0, 0.8, (90, 6)), names


def machine(x, sign, c):
    """Newton steps with the rows that have a loss, halved until the objective falls."""
    x = np.column_stack((x, np.ones(len(x))))
    w, value = np.zeros(x.shape[1]), lambda w: w @ w / 2 + c * (np.maximum(0, 1 - sign * (x @ w)) ** 2).sum()
    for _ in range(100):
        slack = np.maximum(0, 1 - sign * (x @ w))
        on = slack > 0
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * x[on].T @ x[on], w - 2 * c * (sign * slack) @ x)
        size = 1.0
        while value(w - size * step) > value(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


def test_linear_machines_equal_newton(spark, faces):
    m, names = faces
    fitted = classifiers.fit_machines(table(spark, m, names), c=0.2)
    ((subjects, weights),) = fitted.blocks
    assert subjects == sorted(set(names))
    for s, w in zip(subjects, weights, strict=True):
        assert np.allclose(w, machine(m, np.where(np.array(names) == s, 1.0, -1.0), 0.2), atol=1e-3)


def test_blocks_of_subjects_change_nothing(spark, faces):
    m, names = faces
    train, probe = table(spark, m[:60], names[:60]), table(spark, m[60:], names[60:], 60)
    rows = lambda f: sorted(tuple(r) for r in f.predict(probe).select("probe_id", "predicted", "margin").collect())
    split, whole = (classifiers.fit_machines(train, c=0.05, block_bytes=b) for b in (120, 1 << 20))
    a, b = rows(split), rows(whole)
    assert len(split.blocks) > 1 and len(whole.blocks) == 1 and len(a) == 30
    assert [r[:2] for r in a] == [r[:2] for r in b] and np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-3)


def test_kernel_machines_equal_brute_force(spark, faces):
    """With every row a landmark, features' products are the kernel's, and machines those of the whole matrix."""
    m, names = faces
    fitted = classifiers.fit_machines(table(spark, m, names), "rbf", c=0.2)
    gamma = 1 / (m.shape[1] * m.var())
    assert np.isclose(fitted.features.gamma, gamma)
    k = np.exp(-gamma * ((m[:, None] - m[None]) ** 2).sum(2))
    x = fitted.features(m)
    assert np.allclose(x @ x.T, k, atol=1e-6)
    values, axes = np.linalg.eigh(k)
    root = axes * np.sqrt(np.maximum(values, 0))
    f = np.stack([np.column_stack((root, np.ones(len(m)))) @ machine(root, np.where(np.array(names) == s, 1.0, -1.0), 0.2) for s in sorted(set(names))])
    got = {r["probe_id"]: (r["predicted"], r["margin"]) for r in fitted.predict(table(spark, m, names)).collect()}
    assert [got[i][0] for i in range(90)] == [sorted(set(names))[j] for j in f.argmax(0)]
    assert np.allclose([got[i][1] for i in range(90)], f.max(0), atol=3e-3)


def test_few_landmarks_still_classify(spark, faces):
    m, names = faces
    fitted = classifiers.fit_machines(table(spark, m, names), "rbf", c=0.2, landmarks=20)
    got = {r["probe_id"]: r["predicted"] for r in fitted.predict(table(spark, m, names)).collect()}
    assert len(fitted.features.landmarks) == 20 and np.mean([got[i] == n for i, n in enumerate(names)]) > 0.6


def test_votes(spark):
    train = table(spark, [[0.0], [1.0], [1.1], [5.0], [5.0]], ["B", "A", "A", "C", "B"])
    probe = table(spark, [[0.0], [5.0], [3.0]], ["?"] * 3, 100)
    got = {r["probe_id"]: (r["predicted"], r["votes"]) for r in classifiers.vote_nearest(probe, train).collect()}
    assert got == {100: ("A", 2), 101: ("A", 1), 102: ("A", 2)}
    assert {r["probe_id"]: r["predicted"] for r in classifiers.vote_nearest(probe, train, 1).collect()} == {100: "B", 101: "C", 102: "A"}


def test_edges(spark, faces):
    m, names = faces
    empty = table(spark, [], [])
    with pytest.raises(ValueError, match="no rows"):
        classifiers.fit_machines(empty)
    with pytest.raises(KeyError):
        classifiers.fit_machines(empty, "cubic")
    with pytest.raises(KeyError, match="unknown classifier"):
        classifiers.classify("tree", empty, empty)
    train = table(spark, m, names)
    holes = train.withColumn("embedding", F.when(F.col("sample_id") != 3, F.col("embedding")))
    assert classifiers.classify("svm_linear", holes, train).count() == 89
    one = classifiers.classify("svm_linear", train, train.where("subject_id = 'S001'"))
    assert {r["predicted"] for r in one.collect()} == {"S001"}
    assert classifiers.vote_nearest(train, empty).count() == 0
