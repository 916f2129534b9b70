"""Splits, reports and records on disk."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reporting, splits

_PAIRS = "array<array<string>>"
SPLIT = f"protocol string, seed bigint, train_subjects array<string>, eval_subjects array<string>, gallery_ids array<string>, probe_ids array<string>, gallery_selection string, verification struct<genuine:{_PAIRS},impostor:{_PAIRS}>"
METRICS = ("rank1", "rank5", "mrr", "eer", "auc")


def make_split(manifest: DataFrame, protocol: str, seed: int, ratio: int = 20) -> DataFrame:
    """Rows (kind, a, b): train and eval subjects, gallery and probe captures (b null), and genuine and impostor
    pairs of the evaluated captures, ``ratio`` impostor pairs for each genuine one while there are as many."""
    from ..plans.experiments import roles

    train, split = roles(manifest, protocol, seed)
    pool = manifest.join(split.select("sample_id"), "sample_id", "left_semi")
    genuine = splits.genuine_pairs(pool).persist()
    n = genuine.count()
    if not n:
        raise ValueError("no subject has two captures, so there are no genuine pairs")
    one = lambda d, kind, col: d.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("a"), F.lit(None).cast("string").alias("b")).distinct()
    two = lambda d, kind: d.select(F.lit(kind).alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    out = one(pool if protocol == "P1_closed" else train, "train_subject", "subject_id").unionByName(one(pool, "eval_subject", "subject_id"))
    for role in ("gallery", "probe"):
        out = out.unionByName(one(split.where(F.col("role") == role), role, "sample_id"))
    return out.unionByName(two(genuine, "genuine")).unionByName(two(splits.impostor_pairs(pool.select("sample_id", "subject_id"), ratio * n, seed), "impostor"))


def summary(split: DataFrame) -> DataFrame:
    """Rows (kind, n)."""
    return split.groupBy("kind").agg(F.count("*").alias("n"))


def leaks(split: DataFrame, protocol: str) -> DataFrame:
    """Rows (rule, n) of a split's violations."""
    of = lambda k: split.where(F.col("kind") == k)
    part = of("gallery").select(F.col("a").alias("sample_id"), F.lit("gallery").alias("role")).unionByName(of("probe").select(F.col("a").alias("sample_id"), F.lit("probe").alias("role")))
    pairs = split.where("kind in ('genuine', 'impostor')").select("a", "b")
    found = splits.leakage(part.withColumn("subject_id", F.lit("")), pairs, part.select(F.lit(None).cast("string").alias("subject_id")).limit(0))
    if protocol != "P2_disjoint":
        return found
    both = of("train_subject").select("a").intersect(of("eval_subject").select("a")).agg(F.count("*").alias("n")).select(F.lit("subject_in_both_parts").alias("rule"), "n")
    none = split.agg((F.count_if(F.col("kind") == "train_subject") == 0).cast("long").alias("n")).select(F.lit("empty_background").alias("rule"), "n")
    return found.unionByName(both).unionByName(none)


def write_split(split: DataFrame, path: str) -> None:
    """A table of (kind, a, b), after no rule is broken."""
    split.write.mode("overwrite").parquet(path)


def read_split(spark: SparkSession, path: str, protocol: str) -> DataFrame:
    """A split's table; leaks are errors."""
    split = spark.read.parquet(path)
    if bad := [f"{r['rule']}: {r['n']}" for r in leaks(split, protocol).where("n > 0").collect()]:
        raise ValueError(f"the split leaks: {', '.join(bad)}")
    return split


def split_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Split files in the nested layout (one a file) as rows (protocol, seed, kind, a, b)."""
    raw = spark.read.option("multiLine", "true").schema(SPLIT).json(path)
    none = F.lit(None).cast("string")
    single = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("a"), none.alias("b")))
    pair = lambda k, c: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x[0].alias("a"), x[1].alias("b")))
    parts = [single("train_subject", F.col("train_subjects")), single("eval_subject", F.col("eval_subjects")), single("gallery", F.col("gallery_ids")), single("probe", F.col("probe_ids")), pair("genuine", F.col("verification.genuine")), pair("impostor", F.col("verification.impostor"))]
    return raw.select("protocol", "seed", F.explode(F.concat(*parts)).alias("v")).select("protocol", "seed", "v.*")


def write_scores(scores: DataFrame, path: str) -> None:
    """Score arrays in long form, one folder for each truth if there is one."""
    w = scores.write.mode("overwrite")
    (w.partitionBy("y") if "y" in scores.columns else w).parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A report's table (confusion, per class, robustness, timing: bounded by classes or runs) as one file."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def flat(runs: DataFrame) -> DataFrame:
    """Runs with the reported metrics as columns, chance and the ratio to it."""
    x = runs.select("exp_id", "dataset", "data_modality", "arm", "protocol", "seed", *[f"identification.{m}" for m in METRICS[:3]], "verification.eer", "verification.auc", F.col("identification.n_gallery").alias("gallery_size"))
    return reporting.with_chance(x)


def tables(runs: DataFrame) -> dict[str, DataFrame]:
    keys = ["dataset", "data_modality", "exp_id", "arm", "protocol"]
    x = flat(runs)
    return {"T1_main_comparison": reporting.render(x, keys, ["rank1", "eer", "auc"]), "T1_extended": reporting.render(x, keys, ["rank1", "chance", "ratio", "rank5", "mrr", "eer", "auc"])}


def robustness_table(runs: DataFrame) -> DataFrame:
    x = runs.where("robustness is not null")
    return reporting.rollup_conditions(x, ["exp_id", "arm", "protocol", "seed"], "robustness")


def timing_table(runs: DataFrame) -> DataFrame:
    return reporting.timing(runs.where("timing is not null").withColumn("ms", F.col("timing.ms_per_probe")), ["exp_id", "arm"], "ms")


def write_report(runs: DataFrame, root: str, preamble: str = "") -> str:
    """T1, extended, robustness and timing tables as CSV, T1 as Markdown, a sweep's JSON, and RESULTS.md."""
    out = Path(root)
    made = tables(runs)
    text = {name: reporting.to_markdown(t) for name, t in made.items()}
    for name, t in [*made.items(), ("robustness", robustness_table(runs)), ("T5_timing", timing_table(runs))]:
        write_csv(t, str(out / "tables" / name))
    (out / "tables" / "T1_main_comparison.md").write_text(text["T1_main_comparison"], encoding="utf-8")
    rows = [r.asDict() for r in robustness_table(runs).orderBy("exp_id", "arm", "protocol", "seed", "condition").collect()]
    (out / "tables" / "sweep.json").write_text(json.dumps(rows, indent=2, sort_keys=True), encoding="utf-8")
    n = runs.agg(F.count("*").alias("n"), F.countDistinct("protocol").alias("p"), F.collect_set("data_modality").alias("m")).first()
    head = f"# RESULTS\n\nFrom {n['n']} runs over {n['p']} protocols; data: {', '.join(sorted(n['m'])) or 'unknown'}.\n"
    body = "\n".join([head, preamble, "## Main comparison (mean ± deviation over seeds)\n", text["T1_main_comparison"], "## Further metrics\n", text["T1_extended"]])
    (out / "RESULTS.md").write_text(body, encoding="utf-8")
    return body


def sysinfo(spark: SparkSession) -> dict:
    """What produced a run: machine, versions, parallelism, revision."""
    try:
        sha = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except OSError:
        sha = None
    return {"host": platform.node(), "os": platform.platform(), "python": platform.python_version(), "cpus": os.cpu_count(), "spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "git_sha": sha}
