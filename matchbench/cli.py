"""Command line: python -m matchbench.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import anonymous
from .operators import identification, manifest, splits
from .plans import config, experiments, preprocess
from .registry import FEATURES, MATCHERS
from .sources import files, results, toy
from .storage import Scratch

SCANS = {"toy": toy.scan, "yaleb": lambda spark, root: files.light_photos(files.listing(spark, root)), "tufts3d": lambda spark, root: files.meshes_and_photos(files.listing(spark, root))}


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matchbench")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dataset-build", "ingest", "preprocess", "splits", "audit", "run", "robustness", "timing", "aggregate", "architecture"):
        c = sub.add_parser(name)
        c.add_argument("--subjects", type=int, default=12)
        c.add_argument("--samples", type=int, default=15)
        c.add_argument("--data-seed", type=int, default=0)
        c.add_argument("--dataset", default="toy", choices=sorted(SCANS))
        c.add_argument("--data-root", default="data")
        c.add_argument("--results-root", default="results")
        c.add_argument("--configs-root")
        c.add_argument("--exp", default="E00")
        c.add_argument("--protocol", action="append")
        c.add_argument("--seed", type=int, action="append")
        c.add_argument("--modality", default="both", choices=("2d", "3d", "both"))
        c.add_argument("--replicates", type=int, default=1000)
        c.add_argument("--anonymize", action="store_true")
        c.add_argument("--force", action="store_true")
    return p


def _has(path: str) -> bool:
    return Path(path).exists()


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    samples = SCANS[a.dataset](spark, f"{a.data_root}/raw/{a.dataset}")
    if a.dataset != "toy" and manifest.all_content_equal(files.listing(spark, f"{a.data_root}/raw/{a.dataset}"), "content"):
        raise ValueError("all files hold the same bytes: the download is broken")
    if a.anonymize:
        samples = samples.withColumn("subject_id", anonymous(F.col("subject_id"))).withColumn("sample_id", F.sha2("sample_id", 256))
    m = manifest.project(samples)
    manifest.audit(m).show()
    files.write_manifest(m, f"{a.data_root}/processed/{a.dataset}/manifest")


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compute missing arrays, then flag the manifest. Arrays are appended, so what is fresh isn't read again."""
    m = files.read_manifest(spark, f"{a.data_root}/processed/{a.dataset}/manifest").persist()
    path, settings = f"{a.data_root}/interim/{a.dataset}", config.preprocessing({"dataset": a.dataset}, a.configs_root)
    cache = spark.read.schema(preprocess.SCHEMA).parquet(path) if _has(path) else None
    contents = files.listing(spark, f"{a.data_root}/raw/{a.dataset}")
    missing = preprocess.absent(m, contents).groupBy("kind").count().collect()
    for r in missing:
        print(f"{r['count']} captures have no file for {r['kind']}")
    if missing:
        preprocess.absent(m, contents).write.mode("overwrite").parquet(f"{a.data_root}/processed/{a.dataset}/absent")
    rows = preprocess.stale(m, contents, cache, settings)
    if a.modality != "both":
        rows = rows.where(F.col("kind") == {"2d": "image", "3d": "depth"}[a.modality])
    preprocess.compute(rows, settings).write.mode("append").parquet(path)
    arrays = preprocess.latest(spark.read.schema(preprocess.SCHEMA).parquet(path), settings, contents, m)
    preprocess.flagged(m, arrays, a.modality).write.mode("overwrite").parquet(f"{a.data_root}/processed/{a.dataset}/flagged")


def captures(spark: SparkSession, a: argparse.Namespace, e: experiments.Experiment) -> DataFrame:
    m = files.read_manifest(spark, f"{a.data_root}/processed/{e.dataset}/manifest")
    settings = e.settings.get("preprocess") or config.preprocessing({"dataset": e.dataset}, a.configs_root)
    arrays = preprocess.latest(spark.read.schema(preprocess.SCHEMA).parquet(f"{a.data_root}/interim/{e.dataset}"), settings, files.listing(spark, f"{a.data_root}/raw/{e.dataset}"), m)
    return preprocess.captures(m, arrays, experiments.kinds(e)).persist()


def stored_split(spark: SparkSession, a: argparse.Namespace, e: experiments.Experiment, c: DataFrame, protocol: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training ids, roles and pairs of a split's table, checked for leaks; the table is made if it isn't there."""
    path = f"{a.data_root}/processed/{e.dataset}/splits/protocol={protocol}/seed={seed}"
    if not _has(path):
        results.write_split(results.make_split(c, protocol, seed), path)
    s = results.read_split(spark, path, protocol)
    of = lambda *kinds: s.where(F.col("kind").isin(*kinds))
    part = of("gallery", "probe").select(F.col("a").alias("sample_id"), F.col("kind").alias("role"))
    known = part.join(c.select("sample_id", "subject_id"), "sample_id", "left")
    if n := known.where("subject_id is null").count():
        raise ValueError(f"{n} captures of the split {protocol}, seed {seed}, aren't in the manifest; make it anew")
    train = of("gallery").select(F.col("a").alias("sample_id")) if protocol == "P1_closed" else c.join(of("train_subject").select(F.col("a").alias("subject_id")), "subject_id", "left_semi").select("sample_id")
    return train, known.select("sample_id", "subject_id", "role"), of("genuine", "impostor").select("a", "b", (F.col("kind") == "genuine").cast("int").alias("y"))


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs that exist already are skipped unless forced; each is recorded with settings and machine."""
    e = config.experiment(a.exp, a.configs_root)
    e = replace(e, protocols=tuple(a.protocol or e.protocols), seeds=tuple(a.seed or e.seeds), verification=e.verification and a.command == "run", conditions=e.conditions if a.command != "timing" else ())
    if a.command == "robustness" and not e.conditions:
        raise ValueError(f"{e.id} has no conditions")
    path = f"{a.results_root}/runs/{a.command}"
    c = captures(spark, a, e)
    modality = c.select("data_modality").first()[0]
    done = set()
    if _has(path) and not a.force:
        done = {(r["protocol"], r["seed"], r["arm"]) for r in files.read_runs(spark, path).where(F.col("exp_id") == e.id).select("protocol", "seed", "arm").collect()}
    for protocol in e.protocols:
        for seed in e.seeds:
            for arm in e.arms:
                if (protocol, seed, arm.key) in done:
                    print(f"skipping {e.id} {protocol} {seed} {arm.key}")
                    continue
                began = time.time()
                with Scratch(spark) as scratch:
                    split = stored_split(spark, a, e, c, protocol, seed)
                    done_ = experiments.evaluate_arm(c, arm, protocol, seed, scratch, verify=e.verification, conditions=e.conditions, replicates=a.replicates, split=split)
                    n = done_.record.first()["identification"]["n_probe"]
                    ms = 1000 * (time.time() - began)
                    one = done_.record.select(F.lit(e.id).alias("exp_id"), F.lit(e.dataset).alias("dataset"), F.lit(modality).cast("string").alias("data_modality"), "*")
                    timed = one.withColumn("timing", F.struct(F.lit(ms).alias("total_ms"), F.lit(ms / n).alias("ms_per_probe"), F.lit(n).cast("bigint").alias("probe_samples"))).withColumn("recorded", F.current_timestamp())
                    out = f"{a.results_root}/arms/{a.command}/{e.id}/{protocol}/{seed}/{arm.key}"
                    results.write_csv(identification.confusion(done_.decided), f"{out}/confusion")
                    results.write_csv(done_.classes, f"{out}/per_class")
                    if done_.scores is not None:
                        results.write_scores(done_.scores, f"{out}/scores")
                    files.write_runs(timed, path)
    meta = Path(a.results_root) / "meta"
    meta.mkdir(parents=True, exist_ok=True)
    (meta / f"{e.id}.json").write_text(json.dumps({"experiment": e, "sysinfo": results.sysinfo(spark)}, indent=2, default=vars), encoding="utf-8")


def aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = files.read_runs(spark, f"{a.results_root}/runs")
    newest = splits.dedupe_latest(runs, ["exp_id", "arm", "protocol", "seed"], [F.col("verification").isNull(), F.col("recorded").desc_nulls_last(), F.to_json(F.struct("identification"))]).persist()
    print(results.write_report(newest, a.results_root))


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    if a.command == "architecture":
        print("features:", *FEATURES.names())
        print("matchers:", *MATCHERS.names())
        print("datasets:", *sorted(SCANS))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "dataset-build":
        toy.write_files(toy.schedule(spark, a.subjects, a.samples, a.data_seed), str(Path(a.data_root, "raw", "toy").resolve())).count()
    elif a.command == "ingest":
        ingest(spark, a)
    elif a.command == "preprocess":
        prepare(spark, a)
    elif a.command in ("splits", "audit"):
        m = files.read_manifest(spark, f"{a.data_root}/processed/{a.dataset}/manifest")
        for protocol in a.protocol or ("P1_closed", "P2_disjoint"):
            for seed in a.seed or (0,):
                path = f"{a.data_root}/processed/{a.dataset}/splits/protocol={protocol}/seed={seed}"
                if a.command == "splits":
                    results.write_split(results.make_split(m, protocol, seed), path)
                results.summary(results.read_split(spark, path, protocol)).show()
    elif a.command == "aggregate":
        aggregate(spark, a)
    else:
        run(spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
