"""Galleries, protocols, verification pairs, leakage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BROADCAST_BYTES
from ..storage import Scratch
from .numbering import among_drawn, drawn, numbered


def frontal_neutral(manifest: DataFrame, strict: tuple[str, ...] = ("normal",)) -> DataFrame:
    """Frontal rows in the given light, neutral if the table has any neutral row at all."""
    neutral = manifest.where("expression = 'neutral'").limit(1).count() > 0
    out = manifest.where((F.col("pose_yaw") == 0) & (F.col("pose_pitch") == 0) & F.col("illumination").isin(*strict))
    return out.where("expression = 'neutral'") if neutral else out


def select_gallery(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """One row of each subject, the first in the given order; the sample id settles ties."""
    w = Window.partitionBy("subject_id").orderBy(*order, F.col("sample_id"))
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fallback_order(illumination: Column) -> list[Column]:
    """By the number in ``yale:<n>``; other labels come last."""
    return [F.regexp_extract(illumination, r"^yale:(-?\d+)$", 1).try_cast("long").asc_nulls_last()]


def closed(manifest: DataFrame, gallery: DataFrame) -> DataFrame:
    """Rows (sample_id, subject_id, role): gallery, and all the rest as probes. The gallery has one row
    a subject."""
    role = gallery.select("sample_id", F.lit("gallery").alias("_g"))
    return manifest.select("sample_id", "subject_id").join(role, "sample_id", "left").select("sample_id", "subject_id", F.coalesce("_g", F.lit("probe")).alias("role"))


def disjoint_subjects(manifest: DataFrame, seed: int, share: float = 0.4) -> DataFrame:
    """Rows (subject_id, part): background for the first ``share`` of the subjects in a keyed order."""
    subjects = manifest.select("subject_id").distinct()
    n = subjects.count()
    take = max(1, int(share * n))
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col("subject_id")))
    first = subjects.withColumn("_h", h).orderBy("_h", "subject_id").limit(take).select("subject_id", F.lit("background").alias("_p"))
    return subjects.join(first, "subject_id", "left").select("subject_id", F.coalesce("_p", F.lit("evaluation")).alias("part"))


#: Samples of a subject's block: two blocks make the pairs that meet in a task at once. Such lots of pairs a partition has.
BLOCK, LOTS = 2048, 8


def genuine_tiles(samples: DataFrame, *columns: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``samples`` in blocks by subject, with sample_id, subject_id, their own block _b and ``columns``, and how many partitions
    their pairs take. Blocks are told by ids, so equal ids are in one; a subject has as many as its samples need."""
    sizes = samples.where("subject_id is not null").groupBy("subject_id").agg(F.ceil(F.count("*") / block).alias("_k"))
    tiles = sizes.agg(F.sum(F.expr("_k * (_k + 1) div 2"))).first()[0] or 0
    n = max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tiles // LOTS))
    dealt = samples.join(sizes, "subject_id").withColumn("_b", F.pmod(F.xxhash64("sample_id"), F.col("_k")))
    return dealt.select("subject_id", "sample_id", *columns, "_b", "_k"), n


def genuine_pairs(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (a, b), a before b, of the same subject: a join on the subject and on two blocks of its samples, so no task has
    the pairs of a whole subject."""
    t, n = genuine_tiles(samples, block=block)
    a = t.select("subject_id", F.col("sample_id").alias("a"), F.col("_b").alias("_x"), F.explode(F.expr("sequence(_b, _k - 1)")).alias("_y"))
    b = t.select("subject_id", F.col("sample_id").alias("b"), F.explode(F.expr("sequence(0L, _b)")).alias("_x"), F.col("_b").alias("_y"))
    on = ["subject_id", "_x", "_y"]
    # Bytes shuffled say nothing of the pairs made, so partitions are counted and neither side is broadcast.
    both = a.repartition(n, *on).join(b.repartition(n, *on).hint("merge"), on).where("_x < _y or a < b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def impostor_pairs(samples: DataFrame, n: int, seed: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Up to ``n`` different pairs (a, b) of samples of different subjects, drawn by a keyed permutation.

    Samples are numbered subject by subject. The sample at position j forms a pair with each of the s before its
    subject, so pairs have numbers: a subject with c samples from position s on has s * c of them, after those of the
    subjects before. The permutation's first ``n`` numbers are taken apart again: a lookup among the
    subjects' first numbers, a division, and two lookups of positions. Pairs that aren't drawn are never made. While the ids may be
    sent to every executor, the task that draws a number looks it up, and nothing is shuffled; else lookups are joins. Where one pair in
    ``DENSE`` or more is drawn, all are gone through in tiles of positions instead, whose few ids take little space when they are written.
    """
    if (held := _held_ids(samples, limit)) is not None:
        return _looked_up(samples, *held, n, seed)
    spark, scratch = samples.sparkSession, Scratch(samples.sparkSession)
    placed = numbered(samples.select("subject_id", "sample_id"), ["subject_id", "sample_id"], scratch)
    by = placed.groupBy("subject_id").agg(F.min("position").alias("s"), F.count("*").alias("c")).withColumn("pairs", F.col("s") * F.col("c"))
    by = numbered(by.where("pairs > 0"), ["s"], scratch, "first", "pairs")
    total = by.agg(F.sum("pairs").alias("n"), F.count("*").alias("k")).first()
    every = total["n"] or 0
    if not every:
        return placed.select(F.col("sample_id").alias("a"), F.col("sample_id").alias("b")).limit(0)
    # Subjects are found by equal stretches of numbers, as many as subjects; a subject is listed in each that it reaches.
    width = -(-every // total["k"])
    stretch = lambda x: F.call_function("div", x, F.lit(width).cast("bigint"))
    listed = by.withColumn("stretch", F.explode(F.sequence(stretch(F.col("first")), stretch(F.col("first") + F.col("pairs") - 1))))
    numbers = drawn(spark, n, every, seed).withColumn("stretch", stretch(F.col("number")))
    at = numbers.join(listed, "stretch").where("number >= first and number < first + pairs").withColumn("rest", F.col("number") - F.col("first"))
    at = at.select((F.col("rest") % F.col("s")).alias("i"), (F.col("s") + F.expr("rest div s")).alias("j"))
    name = lambda c, x: placed.select(F.col("position").alias(c), F.col("sample_id").alias(x))
    both = at.join(name("i", "x"), "i").join(name("j", "y"), "j")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _held_ids(samples: DataFrame, limit: int) -> tuple[pa.Array, np.ndarray] | None:
    """Ids in order of subjects and ids, and the subjects' first positions, if the ids take at most ``limit`` bytes; else None."""
    size = F.octet_length(F.col("sample_id").cast("string")) if samples.schema["sample_id"].dataType.typeName() == "string" else F.lit(8)
    if (samples.agg(F.sum(F.coalesce(size, F.lit(0)) + 8).alias("n")).first()["n"] or 0) > limit:
        return None
    rows = samples.select("subject_id", "sample_id").orderBy("subject_id", "sample_id").toArrow()
    of = np.array(rows.column("subject_id").to_pylist(), object)
    return pa.concat_arrays(rows.column("sample_id").chunks) if len(rows) else pa.array([], rows.schema.field("sample_id").type), np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)


def _looked_up(samples: DataFrame, ids: pa.Array, starts: np.ndarray, n: int, seed: int) -> DataFrame:
    pairs = starts * np.diff(np.append(starts, len(ids)))
    first = np.cumsum(pairs) - pairs
    every = int(pairs.sum())
    kind = samples.schema["sample_id"].dataType.simpleString()
    if not every:
        return samples.select(F.col("sample_id").alias("a"), F.col("sample_id").alias("b")).limit(0)
    if n * DENSE >= every:
        return _tiled(samples, ids, starts, first, among_drawn(n, every, seed) if n < every else None, f"a {kind}, b {kind}")
    shared = samples.sparkSession.sparkContext.broadcast((ids, starts[1:], first[1:]))

    def look(number: np.ndarray) -> pa.RecordBatch:
        ids, s, first = shared.value
        k = np.searchsorted(first, number, "right") - 1
        rest, s = number - first[k], s[k]
        above = rest // s
        x, y = ids.take(pa.array(rest - above * s)), ids.take(pa.array(s + above))
        return pa.RecordBatch.from_arrays([pc.min_element_wise(x, y), pc.max_element_wise(x, y)], ["a", "b"])

    return drawn(samples.sparkSession, n, every, seed, look, f"a {kind}, b {kind}")


#: Positions before and after that make a tile of pairs, and pairs of a tile gone through at once. So few positions before fit a byte each.
BEFORE, AFTER, AT_ONCE = 256, 1 << 16, 1 << 18
#: Pairs gone through for each that is drawn, at most; tasks at most, as tiles that share a file share its dictionaries.
DENSE, TASKS = 4, 1 << 15


def _tiled(samples: DataFrame, ids: pa.Array, starts: np.ndarray, first: np.ndarray, among: Callable[[np.ndarray], np.ndarray] | None, schema: str) -> DataFrame:
    """All impostor pairs, or those whose numbers are ``among`` the drawn, tile by tile of ``BEFORE`` positions with ``AFTER`` later ones of other
    subjects. A tile has the pairs in which the earlier position has the lower id, or the others, so each column holds few ids or long runs of one:
    columnar files take far fewer bytes than for pairs in a drawn order."""
    spark = samples.sparkSession
    # A position's pairs begin where its subject ends.
    others = np.append(starts[1:], len(ids))[np.searchsorted(starts, np.arange(0, len(ids), BEFORE), "right") - 1]
    tiles = [(at, to, low) for low in (1, 0) for at, after in zip(range(0, len(ids), BEFORE), others.tolist(), strict=True) for to in range(after, len(ids), AFTER)]
    tiles = np.array(tiles, np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast((ids, pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64), starts, first, tiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rank, starts, first, tiles = shared.value
        for batch in batches:
            for at, to, low in tiles[batch.column(0).to_numpy()].tolist():
                x, y = np.arange(at, min(at + BEFORE, len(ids))), np.arange(to, min(to + AFTER, len(ids)))
                y = y[rank[y] > rank[x].min() if low else rank[y] <= rank[x].max()]
                step = max(1, AT_ONCE // len(x))
                for lo in range(0, len(y), step):
                    z = y[lo : lo + step]
                    k = np.searchsorted(starts, z, "right") - 1
                    own = starts[k]  # the subject's first position
                    inside = (rank[x] < rank[z][:, None]) == bool(low)
                    if own[0] <= x[-1]:  # subjects end within the tile
                        inside &= x < own[:, None]
                    if among:
                        inside &= among(((first[k] + (z - own) * own)[:, None] + x).ravel()).reshape(inside.shape)
                    j, i = np.nonzero(inside)
                    u, v = ids.take(pa.array(x[i])), ids.take(pa.array(z[j]))
                    yield pa.RecordBatch.from_arrays([pc.min_element_wise(u, v), pc.max_element_wise(u, v)], ["a", "b"])

    return spark.range(0, len(tiles), 1, max(1, min(len(tiles), TASKS))).mapInArrow(run, schema)


def leakage(split: DataFrame, pairs: DataFrame, background: DataFrame) -> DataFrame:
    """Rows (rule, n) of violations. ``split`` has sample_id, subject_id, role; ``pairs`` a and b;
    ``background`` subject_id."""
    both = split.groupBy("sample_id").agg(F.count_if(F.col("role") == "gallery").alias("g"), F.count_if(F.col("role") == "probe").alias("p")).where("g > 0 and p > 0")
    hidden = split.join(background, "subject_id", "left_semi")
    # Pairs may be many times the samples, so they are read once.
    used = pairs.select(F.explode(F.array("a", "b")).alias("sample_id"), (F.col("a") == F.col("b")).alias("self")).groupBy("sample_id").agg(F.count_if("self").alias("self"))
    used = used.join(split.select("sample_id", F.lit(True).alias("known")).distinct(), "sample_id", "left")
    used = used.agg(F.expr("coalesce(sum(self), 0) div 2").alias("self_pair"), F.count_if(F.col("known").isNull()).alias("pair_outside_split"))
    counts = [
        ("gallery_and_probe", both),
        ("background_in_evaluation", hidden),
        ("empty_gallery", _none(split, "gallery")),
        ("empty_probe", _none(split, "probe")),
    ]
    out = None
    for rule, rows in counts:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(used.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in used.columns])).alias("r")).select("r.*"))


def _none(split: DataFrame, role: str) -> DataFrame:
    return split.agg(F.count_if(F.col("role") == role).alias("k")).where("k = 0")


def dedupe_latest(runs: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*newest)
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
