"""Manifest rows: projection, validation, audit, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

NUMERIC = ("pose_yaw", "pose_pitch", "orig_w", "orig_h", "n_points")


def project(samples: DataFrame) -> DataFrame:
    """The manifest's columns from samples with any subset of them; missing ones are null, presence
    flags follow the paths, stage flags begin false."""
    have = {c.lower() for c in samples.columns}
    col = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t)
    cols: list[Column] = []
    for f in model.MANIFEST:
        if f.name in ("has_2d", "has_3d"):
            cols.append(col(f"path_{f.name[-2:]}", "string").isNotNull().alias(f.name))
        elif f.name in ("detect_ok", "align_ok", "nosetip_ok"):
            cols.append(F.lit(False).alias(f.name))
        elif f.name == "quality_flag":
            cols.append(F.lit("").alias(f.name))
        elif f.name == "data_modality":
            cols.append(F.when(F.col("dataset") == "toy", "synthetic_toy").otherwise("real").alias(f.name))
        else:
            cols.append(F.nullif(col(f.name, "string"), F.lit("NA")).try_cast(f.dataType).alias(f.name))
    return samples.select(cols)


def rules() -> list[tuple[str, str]]:
    """(rule, SQL predicate of a row that breaks it). Numbers may be text, as in a raw file."""
    light = " or ".join(f"startswith(illumination, '{p}')" for p in model.ILLUMINATION_PREFIXES)
    inside = ", ".join(f"'{x}'" for x in model.ILLUMINATIONS)
    return [
        ("blank_sample_id", "sample_id is null or trim(sample_id) = ''"),
        ("subject_id", "subject_id is null or not subject_id rlike '^S[0-9]{3,}$'"),
        ("illumination", f"illumination is not null and not (illumination in ({inside}) or {light})"),
        ("data_modality", "data_modality is null or not data_modality in ({})".format(", ".join(f"'{x}'" for x in model.MODALITIES))),
        *[(f"numeric_{c}", f"{c} is not null and {c} <> 'NA' and try_cast({c} as double) is null") for c in NUMERIC],
    ]


def missing_columns(df: DataFrame) -> list[str]:
    return [f.name for f in model.MANIFEST if f.name not in df.columns]


def violations(raw: DataFrame) -> DataFrame:
    """Rows (rule, n) for every rule, in one scan; numbers as text."""
    text = [F.col(c).cast("string").alias(c) if c in NUMERIC else F.col(c) for c in raw.columns]
    applicable = [(r, p) for r, p in rules() if not r.startswith("numeric_") or r.removeprefix("numeric_") in raw.columns]
    one = raw.select(text).agg(*[F.expr(f"count_if({p})").alias(r) for r, p in applicable])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("n")) for r, _ in applicable])).alias("v")).select("v.*")


def audit(manifest: DataFrame) -> DataFrame:
    """One row: captures, subjects, least and most captures of a subject, missing 2D and 3D."""
    by = manifest.groupBy("subject_id").agg(F.count("*").alias("n"), F.count_if(~F.col("has_2d")).alias("no2"), F.count_if(~F.col("has_3d")).alias("no3"))
    return by.agg(
        F.sum("n").alias("n_samples"), F.count("*").alias("n_subjects"), F.min("n").alias("min_per_subject"), F.max("n").alias("max_per_subject"),
        F.sum("no2").cast("long").alias("missing_2d"), F.sum("no3").cast("long").alias("missing_3d"), (F.min("n") >= 2).alias("has_genuine_pairs"),
    )


def audit_pivot(manifest: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Counts of each combination, absent ones 0."""
    return manifest.groupBy(rows).pivot(columns, values).count().na.fill(0)


def duplicate_groups(files: DataFrame, content: str) -> DataFrame:
    """Content that occurs more than once: sha256, n."""
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.count("*").alias("n")).where("n > 1")


def all_content_equal(files: DataFrame, content: str) -> bool:
    """Whether many files all hold the same bytes, the mark of a broken download."""
    r = files.agg(F.count("*").alias("n"), F.min(F.sha2(F.col(content), 256)).alias("lo"), F.max(F.sha2(F.col(content), 256)).alias("hi")).first()
    return r["n"] > 1 and r["lo"] == r["hi"]


def stale(inputs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose digest and settings aren't in the cache: what has to be computed again."""
    return inputs.join(cache, keys, "left_anti")


def quality_flag(modality: str) -> Column:
    """Empty or rejected, from the stage flags: 2D needs detection, 3D the nose tip, both each where the
    capture has that kind of data."""
    good = {"2d": F.col("detect_ok"), "3d": F.col("nosetip_ok")}.get(modality, (~F.col("has_2d") | F.col("detect_ok")) & (~F.col("has_3d") | F.col("nosetip_ok")))
    return F.when(good, F.lit("")).otherwise(F.lit("rejected"))
