"""Closed-set identification: ranks, match curves, precision and recall, confusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import SCORE_DECIMALS
from . import scoring

CMC_LENGTH = 20


def rank(scores: DataFrame) -> DataFrame:
    """``scores`` with rank: 1 for a probe's best; ties go by gallery id."""
    w = Window.partitionBy("probe_id").orderBy(F.col("score").desc(), F.col("gallery_id"))
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def decisions(scores: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row a probe: probe_id, truth, predicted and true_rank. ``subjects`` has sample_id, subject_id.

    Aggregates only, no window over the scores: the best row, the best row of the probe's own subject,
    and how many rows aren't behind that one.
    """
    p = subjects.select(F.col("sample_id").alias("probe_id"), F.col("subject_id").alias("truth"))
    g = subjects.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").alias("guess"))
    rows = scores.join(g, "gallery_id").join(p, "probe_id").withColumn("place", F.struct((-F.col("score")).alias("s"), F.col("gallery_id").alias("g")))
    best = rows.groupBy("probe_id", "truth").agg(F.min_by("guess", "place").alias("predicted"), F.min(F.when(F.col("guess") == F.col("truth"), F.col("place"))).alias("own"))
    ranks = rows.select("probe_id", "place").join(best.select("probe_id", "own"), "probe_id").where("place <= own").groupBy("probe_id").agg(F.count("*").alias("true_rank"))
    return best.join(ranks, "probe_id", "left").select("probe_id", "truth", "predicted", "true_rank")


def decide(probe: DataFrame, gallery: DataFrame, kind: str = "cosine", vector: str = "embedding") -> DataFrame:
    """``decisions`` of templates (sample_id, subject_id, vector): one row a probe. While the gallery may be
    sent to every executor, a batch of probes is scored and decided at once, and scores never leave it."""
    g = gallery.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").alias("guess"), scoring.doubles(F.col(vector)).alias("gv"))
    held = scoring.held_gallery(g)
    if held is None:
        both = probe.select("sample_id", "subject_id").unionByName(gallery.select("sample_id", "subject_id")).distinct()
        return decisions(scoring.score_blocks(probe, gallery, kind, vector), both)
    shared = probe.sparkSession.sparkContext.broadcast((np.array(held.column("guess").to_pylist(), object), scoring._matrix(held.column("gv"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        at = np.arange(len(m))
        for b in batches:
            if not len(b) or not len(m):
                continue
            s = np.round(scoring.similarity_matrix(scoring._matrix(b.column(2)), m, kind), SCORE_DECIMALS)
            if np.isnan(s).any():
                raise ValueError("scores must not be NaN")
            truth = np.array(b.column(1).to_pylist(), object)
            own = truth[:, None] == names[None, :]
            j = np.where(own, s, -np.inf).argmax(1)
            mine = s[np.arange(len(s)), j][:, None]
            rank = ((s > mine) | ((s == mine) & (at[None, :] < j[:, None]))).sum(1) + 1
            known = own.any(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[s.argmax(1)].tolist(), pa.string()), pa.array(rank, pa.int64(), mask=~known)], ["probe_id", "truth", "predicted", "true_rank"])

    p = probe.select(F.col("sample_id").alias("probe_id"), F.col("subject_id").alias("truth"), scoring.doubles(F.col(vector)).alias("pv"))
    return p.mapInArrow(run, f"probe_id {p.schema['probe_id'].dataType.simpleString()}, truth string, predicted string, true_rank long")


def check_decided(decided: DataFrame) -> None:
    """Errors for no probes, and for a probe without a gallery subject."""
    r = decided.agg(F.count("*").alias("n"), F.count_if(F.col("true_rank").isNull()).alias("unknown")).first()
    if not r["n"]:
        raise ValueError("there are no probes")
    if r["unknown"]:
        raise ValueError(f"{r['unknown']} probes have a subject that isn't in the gallery")


def check(scores: DataFrame, decided: DataFrame) -> None:
    """``check_decided``, and an error for scores that are no numbers."""
    check_decided(decided)
    if scores.where(F.isnan("score") | F.col("score").isNull()).limit(1).count():
        raise ValueError("scores must not be NaN")


def metrics(decided: DataFrame, n_gallery: int) -> DataFrame:
    """One row: rank-k rates, mean reciprocal rank, chance and the ratio to it."""
    within = lambda k: F.avg((F.col("true_rank") <= k).cast("double"))
    return decided.agg(
        F.count("*").alias("n_probe"), within(1).alias("rank1"), within(5).alias("rank5"), within(10).alias("rank10"),
        F.avg(1 / F.col("true_rank").cast("double")).alias("mrr"), F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy"),
    ).withColumn("n_gallery", F.lit(n_gallery).cast("long")).withColumn("chance", F.lit(1.0) / n_gallery).withColumn("ratio", F.col("rank1") * n_gallery)


def cmc(decided: DataFrame, length: int = CMC_LENGTH) -> DataFrame:
    """Rows (k, rate) for k = 1 to ``length``: one pass over the probes, then over at most as many counts."""
    counts = decided.groupBy(F.least("true_rank", F.lit(length + 1)).alias("r")).agg(F.count("*").alias("n"))
    ks = counts.sparkSession.range(1, length + 1, 1, 1).withColumnRenamed("id", "k")
    total = counts.agg(F.sum("n").alias("total"))
    return ks.join(F.broadcast(counts), F.col("r") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits")).join(F.broadcast(total)).select("k", (F.col("hits") / F.col("total")).alias("rate"))


def per_class(decided: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows (subject_id, precision, recall, f1, support) over the gallery's subjects; 0 where undefined."""
    t = decided.groupBy(F.col("truth").alias("subject_id")).agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp"))
    p = decided.groupBy(F.col("predicted").alias("subject_id")).agg(F.count("*").alias("guessed"))
    x = universe.select("subject_id").distinct().join(t, "subject_id", "left").join(p, "subject_id", "left").na.fill(0, ["support", "tp", "guessed"])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("guessed"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return x.select("subject_id", "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")


def averages(classes: DataFrame) -> DataFrame:
    """One row: macro and support-weighted precision, recall and F1."""
    cols = []
    for m in ("precision", "recall", "f1"):
        cols += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted")]
    return classes.agg(*cols)


def confusion(decided: DataFrame) -> DataFrame:
    """Rows (truth, predicted, n), and share of the truth's row."""
    c = decided.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def per_condition(decided: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rows (condition, rank1, n). ``conditions`` has probe_id and condition."""
    x = decided.join(conditions, "probe_id")
    return x.groupBy("condition").agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("rank1"), F.count("*").alias("n"))
