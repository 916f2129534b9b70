"""Connected components of a link table, and the rounds that find the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, materialize, release

#: Members that each bucket is compared with, round by round, and buckets of a node used for that.
ROUNDS = (1, 8)
STAR_BUCKETS = 4
#: Rows of a bucket that one group compares with as many others, and rows from which a bucket counts as large.
TILE, LARGE = 1024, 64
#: Large buckets of a node that its rows name.
NAMED = 32


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label), label the least node of its component, for the nodes of ``edges`` (a, b).

    Each round takes the least label among a node and its neighbours, then that label's own label, so
    long chains shorten as fast as they are followed. A hub's rows are pre-aggregated before they are
    shuffled. Every round's table is written to the shared folder, and the one before deleted.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(step.join(of, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")), "cc-labels")
        release(labels)
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            release(both)
            return labels


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of all links found so far: ``labels`` (node, label) with further ``links`` (a, b)."""
    if labels is None:
        return components(links)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    out = components(known.union(links.select("a", "b")))
    release(labels)
    return out


def tiles(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (bucket, sig, n, label) dealt for full comparison: with the part (i, j), side (0 or 1) and
    top (the row is in the bucket's most frequent component).

    In each bucket the rows outside its most frequent component (side 0) meet all rows (side 1); rows of
    that component needn't meet each other. Both sides are dealt in tiles of about ``TILE`` rows by hash,
    and each pair of tiles is a part of its own, so no group outgrows 2 * ``TILE`` rows by much. ``large``
    names up to ``NAMED`` of the node's large buckets, the least ones: the same pair meets in each of its
    buckets, and only the least that both rows name hands it on.
    """
    size = rows.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("size"), F.max_by("label", F.struct("k", "label")).alias("major"), F.max("k").alias("most"))
    parts = lambda n: F.ceil(n / TILE).cast("int")
    size = materialize(size.select("bucket", "size", "major", parts(F.col("size") - F.col("most")).alias("na"), parts(F.col("size")).alias("nb")), "tile-sizes")
    named = rows.join(size.where(F.col("size") >= LARGE).select("bucket"), "bucket", "left_semi").groupBy("sig").agg(F.array_sort(F.collect_set("bucket")).alias("large"))
    x = rows.join(size, "bucket").join(named.select("sig", F.slice("large", 1, NAMED).alias("large")), "sig", "left")
    own = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = x.where("label <> major").withColumn("i", own("na")).withColumn("j", every("nb")).withColumn("side", F.lit(0))
    b = x.withColumn("j", own("nb")).withColumn("i", every("na")).withColumn("side", F.lit(1))
    return a.unionByName(b).select("bucket", "i", "j", "side", "sig", "n", "label", (F.col("label") == F.col("major")).alias("top"), "large", *extra)


def compare_parts(tiles: DataFrame, meet: Callable[[int, pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) that ``meet(bucket, rows)`` finds in each part of ``tiles``. Many small parts share a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            key = np.column_stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            ends = [*new[1:], len(table)] if last else [*new[1:]]
            found = [meet(int(key[s, 0]), table.slice(s, e - s)) for s, e in zip(new, ends, strict=False)]
            a, b = (np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]), table.slice(ends[-1] if ends else 0)

        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch])
                out, rest = pairs(pa.concat_tables([rest, table]).combine_chunks() if rest is not None and len(rest) else table, False)
                yield out
        if rest is not None and len(rest):
            yield pairs(rest, True)[0]

    return tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(giving_back(run), "a long, b long")


def connect(buckets: DataFrame, filter_pairs: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame | None], compatible: str = "true", rounds: tuple[int, ...] = ROUNDS, extra: tuple[str, ...] = ()) -> DataFrame | None:
    """Components of all links between nodes that share a bucket, as (node, label); None without links.

    ``buckets`` has rows (bucket, sig, n and the ``extra`` columns); pairs with ``compatible`` (over n and n2,
    and so on) are candidates. In
    the first rounds a few of every node's buckets compare their nodes with a few of them, which costs a
    group of copies its size times those few; ``filter_pairs(pairs)`` drops pairs (a, b) that cannot link.
    What shares any bucket but no component after that is compared in full by ``compare(tiles)``, which
    hands on only pairs that may link. ``verify(pairs)`` returns the links among pairs. Nodes in one
    component already are never compared again, and no link between components is lost.
    """
    open_, tested, labels = buckets, None, None
    for turn in range(len(rounds) + 1):
        if labels is None:
            rows = open_.withColumn("label", F.col("sig"))
        else:
            rows = open_.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        mixed = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
        rows = materialize(rows.join(mixed, "bucket", "left_semi"), "open-buckets")
        if turn:
            release(open_)
        if rows.isEmpty():
            release(rows)
            break
        open_ = rows.drop("label")
        if turn < len(rounds):
            order = Window.partitionBy("sig").orderBy(F.xxhash64("bucket"), "bucket")
            few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= STAR_BUCKETS).drop("_r")
            one = F.struct(F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("label").alias("label2"), *[F.col(c).alias(f"{c}2") for c in extra])
            some = few.groupBy("bucket").agg(*[F.min_by(one, F.xxhash64("sig", F.lit(100 * turn + k))).alias(f"o{k}") for k in range(rounds[turn])])
            some = some.select("bucket", F.explode(F.array_distinct(F.array(*[f"o{k}" for k in range(rounds[turn])]))).alias("o"))
            both = few.join(some.select("bucket", "o.*"), "bucket")
            pairs = both.where(f"label <> label2 and {compatible}").select(F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b")).distinct()
        else:
            pairs = compare(tiles(rows, extra)).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidate-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = verify(pairs if turn == len(rounds) else filter_pairs(pairs))
        if links is not None and not links.isEmpty():
            labels = merge(labels, links)
            release(links)
    if tested is not None:
        release(tested)
    return labels
