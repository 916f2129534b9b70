"""Scores of probe and gallery templates, in long form (probe_id, gallery_id, score); higher is more alike.

Two ways with one contract: ``score_columns`` keeps everything in the JVM by higher-order functions
and suits short sides and checking; ``score_blocks`` multiplies matrices in Arrow batches. There the
gallery is a broadcast matrix while it has at most ``BROADCAST_ROWS`` rows; a larger one is dealt in
blocks, and each block meets the probes in tasks of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SIMILARITIES, doubles
from ..model import BROADCAST_BYTES, BROADCAST_ROWS, SCORE_DECIMALS
from .splits import BLOCK, LOTS, genuine_tiles


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def similarity_matrix(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "cosine":
        return (a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-12)) @ (b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-12)).T
    if kind == "l2":
        return -np.stack([np.sqrt(((row - b) ** 2).sum(1)) for row in a]) if len(a) else np.empty((0, len(b)))
    if kind == "chi2":
        out = np.empty((len(a), len(b)))
        for i, row in enumerate(a):
            s = row + b
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i] = -np.where(s > 0, (row - b) ** 2 / s, 0).sum(1)
        return out
    raise KeyError(f"unknown similarity {kind!r}")


def _sides(probe: DataFrame, gallery: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    p = probe.select(F.col("sample_id").alias("probe_id"), doubles(F.col(vector)).alias("pv"))
    g = gallery.select(F.col("sample_id").alias("gallery_id"), doubles(F.col(vector)).alias("gv"))
    return p, g


def held_gallery(gallery: DataFrame, limit: int = BROADCAST_ROWS) -> pa.Table | None:
    """The gallery's rows in order of their ids, if they are few enough, by count and bytes, to be sent to
    every executor; else None."""
    r = gallery.agg(F.count("*").alias("n"), F.max(F.size("gv")).alias("d")).first()
    if r["n"] > limit or r["n"] * max(r["d"] or 0, 1) * 8 > BROADCAST_BYTES:
        return None
    return gallery.toArrow().sort_by("gallery_id")


def score_columns(probe: DataFrame, gallery: DataFrame, kind: str = "cosine", vector: str = "embedding") -> DataFrame:
    """Every probe with every gallery template, by column expressions."""
    p, g = _sides(probe, gallery, vector)
    g = F.broadcast(g) if gallery.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else g
    return p.crossJoin(g).select("probe_id", "gallery_id", F.round(SIMILARITIES[kind](F.col("pv"), F.col("gv")), SCORE_DECIMALS).alias("score"))


#: Scores that a task has at once where it keeps the best of a row, and probes at most.
AT_ONCE, PROBES = 1 << 21, 1024


def rows_at_once(others: int) -> int:
    """Probes whose scores with so many gallery rows are made together, so that memory doesn't grow with the gallery."""
    return max(1, min(PROBES, AT_ONCE // max(1, others)))


def _rows(probe_ids, gallery_ids, scores: np.ndarray, kinds) -> pa.RecordBatch:
    n, m = scores.shape
    p = pa.array(probe_ids).take(pa.array(np.repeat(np.arange(n), m)))
    g = pa.array(gallery_ids).take(pa.array(np.tile(np.arange(m), n)))
    return pa.RecordBatch.from_arrays([p, g, pa.array(np.round(scores, SCORE_DECIMALS).ravel())], kinds)


def score_blocks(probe: DataFrame, gallery: DataFrame, kind: str = "cosine", vector: str = "embedding", limit: int = BROADCAST_ROWS, block: int = 4096, top: int | None = None) -> DataFrame:
    """The same scores by matrix products. ``top`` keeps each probe's best ones inside a batch (of each
    block), for decisions that need no more."""
    p, g = _sides(probe, gallery, vector)
    names = ["probe_id", "gallery_id", "score"]
    schema = f"probe_id {p.schema['probe_id'].dataType.simpleString()}, gallery_id {g.schema['gallery_id'].dataType.simpleString()}, score double"

    def best(ids, other, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        if top is None or top >= s.shape[1]:
            for lo in range(0, len(s), max(1, 500_000 // max(1, s.shape[1]))):
                hi = lo + max(1, 500_000 // max(1, s.shape[1]))
                yield _rows(ids[lo:hi], other, s[lo:hi], names)
            return
        s = np.round(s, SCORE_DECIMALS)
        at = np.argsort(-s, axis=1, kind="stable")[:, :top]
        rows = np.repeat(np.arange(len(s)), top)
        yield pa.RecordBatch.from_arrays([pa.array(ids).take(pa.array(rows)), pa.array(other).take(pa.array(at.ravel())), pa.array(s[rows, at.ravel()])], names)

    held = held_gallery(g, limit)
    if held is not None:
        shared = probe.sparkSession.sparkContext.broadcast((held.column("gallery_id").to_pylist(), _matrix(held.column("gv"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            step = rows_at_once(len(ids))
            for b in batches:
                for lo in range(0, len(b), step):
                    part = b.slice(lo, step)
                    if len(part) and len(ids):
                        yield from best(part.column(0).to_pylist(), ids, similarity_matrix(_matrix(part.column(1)), m, kind))

        return p.mapInArrow(run, schema)
    blocks = -(-gallery.count() // block)
    dealt = g.withColumn("_b", F.pmod(F.xxhash64("gallery_id"), F.lit(blocks)))
    spread = max(1, -(-probe.count() // block))
    tiles = p.withColumn("_t", F.pmod(F.xxhash64("probe_id"), F.lit(spread))).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    others = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))

    def tile(left, right):
        if not len(left) or not len(right):
            return pa.table({n: [] for n in names}, schema=pa.schema([("probe_id", left.schema.field("probe_id").type), ("gallery_id", right.schema.field("gallery_id").type), ("score", pa.float64())]))
        right = right.sort_by("gallery_id")
        ids, others, a, b = left.column("probe_id").to_pylist(), right.column("gallery_id").to_pylist(), _matrix(left.column("pv")), _matrix(right.column("gv"))
        step = rows_at_once(len(b))
        return pa.Table.from_batches([x for lo in range(0, len(a), step) for x in best(ids[lo : lo + step], others, similarity_matrix(a[lo : lo + step], b, kind))])

    return tiles.groupBy("_b", "_t").cogroup(others.groupBy("_b", "_t")).applyInArrow(tile, schema)


def rowwise(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    """Similarity of each row of ``a`` with the same row of ``b``."""
    if kind == "cosine":
        return np.einsum("ij,ij->i", a, b) / ((np.linalg.norm(a, axis=1) + 1e-12) * (np.linalg.norm(b, axis=1) + 1e-12))
    if kind == "l2":
        return -np.sqrt(((a - b) ** 2).sum(1))
    if kind == "chi2":
        s = a + b
        with np.errstate(divide="ignore", invalid="ignore"):
            return -np.where(s > 0, (a - b) ** 2 / s, 0).sum(1)
    raise KeyError(f"unknown similarity {kind!r}")


def score_pairs(pairs: DataFrame, templates: DataFrame, kind: str = "cosine", vector: str = "embedding") -> DataFrame:
    """Scores of given pairs (a, b and further columns), without templates in shuffles while those may be sent to every
    executor; else by two equi-joins. Pairs with an unknown sample are left out."""
    t = templates.select(F.col("sample_id").alias("gallery_id"), doubles(F.col(vector)).alias("gv"))
    held = held_gallery(t)
    if held is not None:
        shared = templates.sparkSession.sparkContext.broadcast((held.column("gallery_id").to_pylist(), _matrix(held.column("gv"))))
        names = [*pairs.columns, "score"]
        at = [names.index(c) for c in ("a", "b")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            place = {x: i for i, x in enumerate(ids)}
            step = max(1, 2_000_000 // max(1, m.shape[1]))
            for b in batches:
                i, j = (np.array([place.get(x, -1) for x in b.column(k).to_pylist()], np.int64) for k in at)
                known = np.flatnonzero((i >= 0) & (j >= 0))
                for lo in range(0, len(known), step):
                    k = known[lo : lo + step]
                    part = b.take(pa.array(k))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.round(rowwise(m[i[k]], m[j[k]], kind), SCORE_DECIMALS))], names)

        return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields]).add("score", T.DoubleType()))
    t = templates.select("sample_id", doubles(F.col(vector)).alias("v"))
    out = pairs.join(t.select(F.col("sample_id").alias("a"), F.col("v").alias("va")), "a").join(t.select(F.col("sample_id").alias("b"), F.col("v").alias("vb")), "b")
    return out.withColumn("score", F.round(SIMILARITIES[kind](F.col("va"), F.col("vb")), SCORE_DECIMALS)).drop("va", "vb").select(*pairs.columns, "score")


#: Rows of a block of a subject's templates where these are shuffled: as many pairs meet in a task as take little memory, and templates move
#: once for each block of their subject.
DEALT = 16384


def _genuine_rows(ids: pa.Array, m: np.ndarray, i: range, j: range, kind: str) -> Iterator[pa.RecordBatch]:
    """Scores of the rows ``i`` with those of ``j``, ids being in order: of a range with itself each pair once, and none of equal ids."""
    none = pa.RecordBatch.from_arrays([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["a", "b", "score"])
    for low in range(j.start, j.stop, 2048):
        q = np.arange(low, min(low + 2048, j.stop))
        y = m[q].astype(np.float64)
        to = np.linalg.norm(y, axis=1) + 1e-12
        for lo in range(i.start, min(i.stop, q[-1]) if i == j else i.stop, 256):
            p = np.arange(lo, min(lo + 256, i.stop))
            x = m[p].astype(np.float64)
            s = x @ y.T / ((np.linalg.norm(x, axis=1) + 1e-12)[:, None] * to) if kind == "cosine" else similarity_matrix(x, y, kind)
            s, u, v = np.round(s, SCORE_DECIMALS).ravel(), np.repeat(p, len(q)), np.tile(q, len(p))
            if i == j and lo + len(p) > low:
                s, u, v = (z[u < v] for z in (s, u, v))
            first, last = ids.take(pa.array(np.minimum(u, v))), ids.take(pa.array(np.maximum(u, v)))
            batch = pa.RecordBatch.from_arrays([first, last, pa.array(s)], none.schema.names)
            same = pc.equal(first, last)
            yield batch.filter(pc.invert(pc.fill_null(same, False))) if pc.any(same).as_py() else batch
    yield none


def _held_subjects(t: DataFrame, limit: int) -> tuple[pa.Array, np.ndarray, np.ndarray] | None:
    """Ids, vectors as stored and the subjects' first rows, in order of subjects and ids, if they take at most ``limit`` bytes; else None."""
    text = t.schema["sample_id"].dataType.typeName() == "string"
    wide = 4 if t.schema["v"].dataType.elementType.typeName() == "float" else 8
    r = t.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.sum(F.coalesce(F.octet_length("sample_id") if text else F.lit(0), F.lit(0)) + 8).alias("b")).first()
    if r["n"] * max(r["d"] or 0, 1) * wide + (r["b"] or 0) > limit:
        return None
    rows = t.select("subject_id", "sample_id", "v").toArrow().sort_by([("subject_id", "ascending"), ("sample_id", "ascending")]).combine_chunks()
    of, ids, v = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)))) if len(of) else np.empty(0, np.int64)
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.empty((0, 1)), np.append(starts, len(of))


def score_genuine(templates: DataFrame, kind: str = "cosine", vector: str = "embedding", block: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (a, b, score) of all genuine pairs (``splits.genuine_pairs``), scored where two blocks of a subject's templates
    meet. While templates take at most ``limit`` bytes every executor has them, and nothing is shuffled; else templates are shuffled once for
    each block of their subject, pairs never."""
    t = templates.where(F.col("subject_id").isNotNull() & F.col(vector).isNotNull()).select("subject_id", "sample_id", F.col(vector).alias("v"))
    id_ = t.schema["sample_id"].dataType.simpleString()
    schema, spark = f"a {id_}, b {id_}, score double", templates.sparkSession
    if (held := _held_subjects(t, limit)) is not None:
        ids, m, starts = held
        step = block or BLOCK
        cuts = [(range(lo, hi, step), hi) for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if hi - lo > 1]
        tiles = np.array([(x, min(x + step, hi), y, min(y + step, hi)) for at, hi in cuts for k, x in enumerate(at) for y in at[k:]], np.int64).reshape(-1, 4)
        shared = spark.sparkContext.broadcast((ids, m, tiles))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, tiles = shared.value
            for batch in batches:
                for a, b, c, d in tiles[batch.column(0).to_numpy()].tolist():
                    yield from _genuine_rows(ids, m, range(a, b), range(c, d), kind)

        n = max(1, min(len(tiles), max(8 * spark.sparkContext.defaultParallelism, -(-len(tiles) // LOTS))))
        return spark.range(0, len(tiles), 1, n).mapInArrow(run, schema)
    t, _ = genuine_tiles(t, "v", block=block or DEALT)
    on = ["subject_id", "_x", "_y"]
    # Templates are few beside their pairs, so each tile of pairs may take a task.
    tiles = t.select("subject_id", F.expr("_k * (_k + 1) div 2").alias("n")).distinct().agg(F.sum("n")).first()[0] or 0
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles), 10_000)
    t = t.withColumn("_o", F.explode(F.expr("sequence(0L, _k - 1)"))).select("subject_id", "sample_id", "v", "_b", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("_b", "ascending"), ("sample_id", "ascending")])
        ids, v, own = (pa.concat_arrays(rows.column(c).chunks) for c in ("sample_id", "v", "_b"))
        m, cut = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), int(np.searchsorted(own.to_numpy(), own[0].as_py(), "right"))
        if rows.column("_x")[0].as_py() == rows.column("_y")[0].as_py():
            yield from _genuine_rows(ids, m, range(len(ids)), range(len(ids)), kind)
        else:  # ids are in order within a block only
            for b in _genuine_rows(ids, m, range(cut), range(cut, len(ids)), kind):
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(b.column(0), b.column(1)), pc.max_element_wise(b.column(0), b.column(1)), b.column(2)], ["a", "b", "score"])

    return t.repartition(n, *on).groupBy(*on).applyInArrow(tile, schema)


def all_pairs(templates: DataFrame, kind: str = "cosine", vector: str = "embedding") -> DataFrame:
    """Every unordered pair of templates: a, b, score and y (1 for the same subject). While the templates may be
    sent to every executor, truth is told inside the batch; else scores are joined with the subjects."""
    t = templates.select(F.col("sample_id").alias("gallery_id"), doubles(F.col(vector)).alias("gv"), F.col("subject_id").alias("subject"))
    held = held_gallery(t)
    if held is not None:
        ids, names = held.column("gallery_id").combine_chunks(), np.array(held.column("subject").to_pylist(), object)
        subjects = {x: i for i, x in enumerate(dict.fromkeys(names))}
        shared = templates.sparkSession.sparkContext.broadcast((ids, _matrix(held.column("gv")), np.array([subjects[x] for x in names], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, code = shared.value
            position = {x: i for i, x in enumerate(ids.to_pylist())}
            for b in batches:
                at = np.array([position[x] for x in b.column(0).to_pylist()], np.int64)
                for lo in range(0, len(at), max(1, 500_000 // max(1, len(m)))):
                    a = at[lo : lo + max(1, 500_000 // max(1, len(m)))]
                    s = np.round(similarity_matrix(m[a], m, kind), SCORE_DECIMALS)
                    i, j = np.nonzero(np.arange(len(m))[None, :] > a[:, None])  # ids are in order
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[i])), ids.take(pa.array(j)), pa.array(s[i, j]), pa.array((code[a[i]] == code[j]).astype(np.int32))], ["a", "b", "score", "y"])

        kind_ = t.schema["gallery_id"].dataType.simpleString()
        return templates.select("sample_id").mapInArrow(run, f"a {kind_}, b {kind_}, score double, y int")
    s = templates.select("sample_id", "subject_id")
    scores = score_blocks(templates, templates, kind, vector).where("probe_id < gallery_id")
    scores = scores.join(F.broadcast(s.select(F.col("sample_id").alias("probe_id"), F.col("subject_id").alias("sa"))) if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else s.select(F.col("sample_id").alias("probe_id"), F.col("subject_id").alias("sa")), "probe_id")
    scores = scores.join(F.broadcast(s.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").alias("sb"))) if s.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else s.select(F.col("sample_id").alias("gallery_id"), F.col("subject_id").alias("sb")), "gallery_id")
    return scores.select(F.col("probe_id").alias("a"), F.col("gallery_id").alias("b"), "score", (F.col("sa") == F.col("sb")).cast("int").alias("y"))


# --- score normalisation and fusion -----------------------------------------------------------------


def fit_normaliser(scores: DataFrame, score: str = "score") -> dict[str, float]:
    """Mean, population deviation (1 if 0), least and greatest (least + 1 if not above it)."""
    r = scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    return {"mean": r["mean"], "std": r["std"] or 1.0, "lo": lo, "hi": hi if hi > lo else lo + 1}


def normalise(score, fitted: dict[str, float], kind: str):
    if kind == "zscore":
        return (score - fitted["mean"]) / fitted["std"]
    if kind == "minmax":
        return (score - fitted["lo"]) / (fitted["hi"] - fitted["lo"])
    if kind == "tanh":
        return (F.tanh((score - fitted["mean"]) / (2 * fitted["std"])) + 1) * 0.5
    raise KeyError(f"unknown normalisation {kind!r}")


def fuse(a: DataFrame, b: DataFrame, kind: str, weight: float = 0.5) -> DataFrame:
    """Two score tables joined on their pairs. ``weight`` is the first one's."""
    if not 0 <= weight <= 1:
        raise ValueError("the weight must be within [0, 1]")
    both = a.join(b.withColumnRenamed("score", "other"), ["probe_id", "gallery_id"])
    x, y = F.col("score"), F.col("other")
    how = {"sum": x + y, "product": x * y, "weighted_sum": weight * x + (1 - weight) * y}
    if kind not in how:
        raise KeyError(f"unknown fusion {kind!r}")
    return both.select("probe_id", "gallery_id", how[kind].alias("score"))


def weight_sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best gallery row of each probe for the weights 0, 0.05, ... 1 of the first table: rows (weight,
    probe_id, gallery_id). One aggregation with a column a weight, so no row is copied for the weights."""
    both = a.join(b.withColumnRenamed("score", "other"), ["probe_id", "gallery_id"])
    weights = [round(k / 20, 2) for k in range(21)]
    fused = lambda w: F.round(w * F.col("score") + (1 - w) * F.col("other"), SCORE_DECIMALS)
    best = both.groupBy("probe_id").agg(*[F.min_by("gallery_id", F.struct(-fused(w), F.col("gallery_id"))).alias(f"_{k}") for k, w in enumerate(weights)])
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"_{k}").alias("gallery_id")) for k, w in enumerate(weights)]))
    return best.select("probe_id", each.alias("v")).select("v.weight", "probe_id", "v.gallery_id")
