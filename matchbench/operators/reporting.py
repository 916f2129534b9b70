"""Aggregation of runs into report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_std(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of keys, n, mean and sample deviation (0 for one value)."""
    v = F.col(value)
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"))


def summarized(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of many metrics; null for a single run."""
    aggs = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))]
    return rows.groupBy(*keys).agg(*aggs)


def with_chance(rows: DataFrame, gallery_size: str = "gallery_size", rank1: str = "rank1") -> DataFrame:
    chance = F.lit(1.0) / F.col(gallery_size)
    return rows.withColumn("chance", chance).withColumn("ratio", F.col(rank1) / chance)


def render(rows: DataFrame, keys: list[str], values: list[str], decimals: int = 4) -> DataFrame:
    """Keys, and ``mean±std`` as text; rows without the first metric are left out."""
    x = rows.where(F.col(values[0]).isNotNull() & ~F.isnan(F.col(values[0])))
    std = lambda v: F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
    f = f"%.{decimals}f±%.{decimals}f"
    return x.groupBy(*keys).agg(*[F.format_string(f, F.avg(v), std(v)).alias(v) for v in values])


def to_markdown(table: DataFrame) -> str:
    """A small report table as text."""
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in table.collect()]) + "\n"


def pareto(points: DataFrame, good: str, cost: str) -> DataFrame:
    """Points that no other beats: more of ``good`` for less ``cost``. Only the cheapest point of each
    value of ``good`` matters, and those are compared along descending values."""
    best = points.groupBy(good).agg(F.min(cost).alias(cost))
    w = Window.orderBy(F.col(good).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_b", F.min(cost).over(w)).where(F.col("_b").isNull() | (F.col(cost) < F.col("_b"))).drop("_b")


def rollup_conditions(runs: DataFrame, keys: list[str], conditions: str) -> DataFrame:
    """One row for each condition of a run's map of (rank1, n)."""
    return runs.select(*keys, F.explode(conditions).alias("condition", "_m")).select(*keys, "condition", "_m.rank1", "_m.n")


def timing(rows: DataFrame, keys: list[str], ms: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.percentile(ms, F.lit(0.5)).alias("median_ms"), F.avg(ms).alias("mean_ms"), F.stddev_pop(ms).alias("std_ms"), F.count(ms).alias("n"))
