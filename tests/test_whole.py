"""Queries and operators read all of their input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbench.operators import sampling, splits, verification
from matchbench.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def genuine(spark):
    by = queries.captures(spark, DATA).groupBy("subject_id").count().collect()
    return sum(r["count"] * (r["count"] - 1) // 2 for r in by)


def test_leak_check_reads_all_genuine_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.splits, "leakage", lambda split, pairs, background: seen.append(pairs) or pairs)
    queries.leakage_audit(spark, DATA)
    assert seen[0].where("a < b and a >= 0").count() == genuine(spark)


def test_all_genuine_pairs_are_scored(spark):
    s = queries.score_pairs_all(spark, DATA)
    assert s.count() == genuine(spark) and s.where("b >= 300").count() > 0


def test_intervals_equal_brute_force(spark):
    """Each replicate drawn out row by row, rates by comparing with every score."""
    r = np.random.default_rng(3)
    rows = [(i, float(x), int(i % 3 == 0)) for i, x in enumerate(np.round(r.normal(0, 1, 60) + (np.arange(60) % 3 == 0), 1))]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    draw = sampling.poisson_draw(0, F.col("replicate").cast("string"), F.col("id").cast("string"))
    counts = spark.range(1000).withColumnRenamed("id", "replicate").crossJoin(df).withColumn("w", draw).collect()
    drawn = [([], []) for _ in range(1000)]
    for x in counts:
        drawn[x["replicate"]][x["y"]].extend([x["score"]] * x["w"])
    eers, aucs = [], []
    for impostor, gen in drawn:
        i, g = np.array(impostor), np.array(gen)
        t = np.array([np.inf, *sorted({*impostor, *gen}, reverse=True)])
        far, frr = (i >= t[:, None]).mean(1), (g < t[:, None]).mean(1)
        j = int(np.argmax(far >= frr))
        d0, d1 = far[j - 1] - frr[j - 1], far[j] - frr[j]
        eers.append(far[j - 1] + d0 / (d0 - d1) * (far[j] - far[j - 1]))
        aucs.append(((g[:, None] > i) + 0.5 * (g[:, None] == i)).mean())
    got = {x["metric"]: (x["lo"], x["hi"]) for x in verification.bootstrap_ci(df, draw).collect()}
    assert np.allclose(got["eer"], np.percentile(eers, [2.5, 97.5]), atol=1e-9) and np.allclose(got["auc"], np.percentile(aucs, [2.5, 97.5]), atol=1e-9)


def test_twenty_impostor_pairs_for_each_genuine_one(spark):
    small = queries.captures(spark, DATA).groupBy("subject_id").agg(F.slice(F.array_sort(F.collect_list("sample_id")), 1, 2).alias("s")).select("subject_id", F.explode("s").alias("sample_id"))
    n = splits.genuine_pairs(small).count()
    every = small.count() * (small.count() - 1) // 2 - n
    assert splits.impostor_pairs(small, 20 * n, 0).count() == min(20 * n, every)
    c = queries.captures(spark, DATA)
    assert queries.pairs_impostor_20(spark, DATA).count() == min(20 * genuine(spark), c.count() * (c.count() - 1) // 2 - genuine(spark))
