"""Mixing sources to target weights.

Source ``s`` holds a share ``p_s`` of all tokens. Its weight is ``p_s ** a``, normalised. The exponent
``a`` in [0, 1] is the smallest, found by bisection, at which the weights' entropy is no more than the
target and no source is repeated beyond the limit. The weights are realised as a token budget for
each source. A budget is whole passes over the source plus the start of one more pass: rows are dealt
by a keyed hash to blocks, the blocks are taken in that order until the budget is used up, and the
last block is cut between two rows. So the extra pass is a prefix of a keyed permutation, known
without sorting the source: only block totals and the rows of each source's last block are ordered.

Edge cases: a null source is a source of its own; null or empty texts have 0 tokens and follow their
hash like others; a source without tokens is taken once; rows with the same key (repeated rows) are
taken alike, so a budget may be exceeded by such ties and by less than one row; a budget above all tokens
times ``max_epochs`` is an error (``ValueError``); an empty table gives
an empty result; further columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Words as counted for budgets.
TOKEN = r"[^\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 4096


@dataclass(frozen=True)
class MixSpec:
    """entropy: target as a fraction of the largest possible entropy. max_epochs: how often a source
    may be read. budget: tokens in all; None takes the least at which each source is read whole."""

    entropy: float = 0.999
    max_epochs: float = 2.0
    budget: int | None = None
    seed: str = "mix-1"


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def permutation_key(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit(""))))


def _block(h: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32 - bits)


def _alpha_sql(spec: MixSpec) -> str:
    """Bisection over an array ``shares`` of all positive shares, in one row."""
    z = "aggregate(shares, 0D, (a, p) -> a + power(p, {m}))"
    e = "aggregate(shares, 0D, (a, p) -> a + power(p, {m}) * ln(p))"
    mid = "((s.lo + s.hi) / 2)"
    entropy = f"(ln({z}) - {{m}} * {e} / {z})".format(m=mid)
    if spec.budget is None:
        repeats = f"power(array_max(shares) / array_min(shares), 1 - {mid})"
    else:
        repeats = f"({spec.budget}D / total * power(array_min(shares), {mid} - 1) / {z})".format(m=mid)
    good = f"{entropy} <= {spec.entropy}D * ln(size(shares)) + 1e-12D and {repeats} <= {spec.max_epochs}D"
    return (
        "aggregate(sequence(1, 50), named_struct('lo', 0D, 'hi', 1D), "
        f"(s, i) -> if({good}, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', s.hi)), s -> round(s.hi, 9))"
    )


def plan_mix(df: DataFrame, spec: MixSpec = MixSpec(), source: str = "source", key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """One row for each source: source, n_tokens, weight, budget, epochs (whole passes) and cutoff, the
    largest permutation key of the pass after those (null if none of it is taken)."""
    tokens = count_tokens(F.col("text")) if tokens is None else tokens
    rows = df.count()
    bits = min(30, max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_BLOCK))) if rows > ROWS_PER_BLOCK else 0)
    h = permutation_key(F.col(f"`{key}`"), spec.seed)
    base = df.select(F.col(f"`{source}`").alias("source"), tokens.alias("t"), h.alias("h")).withColumn("block", _block(F.col("h"), bits))
    blocks = materialize(base.groupBy("source", "block").agg(F.sum("t").alias("t")), "mix-blocks")
    sources = blocks.groupBy("source").agg(F.sum("t").alias("n_tokens"))
    found = (
        sources.where("n_tokens > 0")
        .agg(F.sort_array(F.collect_list("n_tokens")).alias("n"), F.sum("n_tokens").cast("double").alias("total"))
        .selectExpr("transform(n, x -> x / total) as shares", "total")
        .selectExpr("shares", "total", f"case when size(shares) > 0 then {_alpha_sql(spec)} end as alpha")
        .selectExpr("total", "alpha", "aggregate(shares, 0D, (a, p) -> a + power(p, alpha)) as z", "power(array_max(shares), 1 - alpha) as least")
        .first()
    )
    if spec.budget is not None and found["total"] and spec.budget > spec.max_epochs * found["total"]:
        raise ValueError(f"a budget of {spec.budget} tokens can't be met: {found['total']:.0f} tokens may be read {spec.max_epochs:g} times each")
    total, alpha, z, least = (found["total"], found["alpha"], found["z"], found["least"]) if found["alpha"] is not None else (1.0, 1.0, 1.0, 1.0)
    budget = float(spec.budget) if spec.budget is not None else total * least * z
    weight = F.pow(F.col("n_tokens") / F.lit(total), F.lit(alpha)) / F.lit(z)
    sources = (
        sources.withColumn("weight", F.when(F.col("n_tokens") > 0, F.round(weight, 9)).otherwise(F.lit(0.0)))
        .withColumn("budget", F.round(F.col("weight") * F.lit(budget)).cast("long"))
        .withColumn("epochs", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(F.lit(1)).cast("long"))
        .withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("budget") - F.col("epochs") * F.col("n_tokens")).otherwise(F.lit(0)))
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = blocks.withColumn("before", before).withColumnRenamed("source", "src")
    edge = (
        run.join(sources, run["src"].eqNullSafe(sources["source"]))
        .where("before < rest and before + t >= rest")
        .select("source", "block", "before", "rest")
    )
    last = base.groupBy("source", "block", "h").agg(F.sum("t").alias("t"))
    last = last.join(edge.withColumnRenamed("source", "src").withColumnRenamed("block", "blk"), (F.col("source").eqNullSafe(F.col("src"))) & (F.col("block") == F.col("blk")))
    within = F.coalesce(F.sum("t").over(Window.partitionBy("src").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("within", within).where("before + within < rest").groupBy("src").agg(F.max("h").alias("cutoff"))
    return sources.join(cut, sources["source"].eqNullSafe(cut["src"]), "left").select("source", "n_tokens", "weight", "budget", "epochs", "cutoff")


def count_copies(df: DataFrame, spec: MixSpec = MixSpec(), source: str = "source", key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """``df`` with ``copies`` (long): how often the mix holds each row."""
    if "copies" in {c.lower() for c in df.columns}:
        raise ValueError("the input already has copies")
    plan = materialize(plan_mix(df, spec, source, key, tokens), "mix-plan")
    s, e, c = fresh(df, "source", "epochs", "cutoff")
    plan = plan.select(F.col("source").alias(s), F.col("epochs").alias(e), F.col("cutoff").alias(c))
    extra = F.when(permutation_key(F.col(f"`{key}`"), spec.seed) <= F.col(c), 1).otherwise(0)
    return df.join(plan, df[f"`{source}`"].eqNullSafe(plan[s]), "left").withColumn("copies", (F.col(e) + extra).cast("long")).drop(s, e, c)


def mix(df: DataFrame, spec: MixSpec = MixSpec(), **names) -> DataFrame:
    """The mixed rows: each row as often as its number of copies says."""
    (n,) = fresh(df, "copy")
    return count_copies(df, spec, **names).where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(n, "copies")
