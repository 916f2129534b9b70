"""Compressing vectors into codes: every part of a vector is replaced by the number of its nearest codebook entry.

Components become integers, so that squared distances are exact. A task screens all entries at once: the
float32 matrix product of parts and entries, with an interval around each result that holds the true value
whatever the order of sums (see ``screen``). An entry whose interval lies above the least upper bound can't be
nearest. Parts that are left with one entry are done; all entries of the others are evaluated again
in int64, and ties go to the lower index. Results are those of integer arithmetic, on any machine.

Codebooks begin as the parts of the rows with the least ids; each round assigns all parts and replaces
every entry by the floored mean of its parts. Tasks hand on sums by entry only (parts x entries rows); codebooks, whose size
doesn't depend on the number of rows, are all that the driver holds.

Edge cases: rows whose vector is null, empty, or has null, NaN or infinite components are left out; so are
vectors that are not as long as the kept vector with the least id whose length the number of parts divides;
null ids are behind all others; rows repeated with their id count and are returned as often; with fewer rows
than entries, codebooks are smaller; an empty table gives an empty result; errors are added up over equal
labels, nulls together; components so large that squared distances could leave int64 are an error; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize, release, small

#: Rows screened at once, and components that are evaluated again at once.
BLOCK, DOUBTFUL = 2048, 1 << 21
#: Labels of at least this share of the rows are few, whatever the labels.
HOT = 1000


@dataclass(frozen=True)
class Spec:
    """``scale``: a component x becomes floor(scale * x)."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256

    def __post_init__(self):
        if not 0 < self.entries <= 256 or self.parts < 1 or self.rounds < 0:
            raise ValueError("1 to 256 entries, at least one part, and no negative number of rounds")


def quantise(rows: DataFrame, spec: Spec, vec_id: str, vector: str, label: str | None) -> DataFrame:
    """Rows (vec_id, label, q): q has the integer components as little-endian int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2)
            flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            at = v.offsets.to_numpy().astype(np.int64)
            size = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
            good = (size > 0) & (bad[at[1:]] == bad[at[:-1]])
            keep, blobs = np.flatnonzero(good), []
            for i in keep:
                with np.errstate(over="ignore"):
                    x = np.floor(flat[at[i] : at[i + 1]] * spec.scale)
                most = np.abs(x).max()
                if most >= 2**31 or (len(x) // spec.parts + 1) * (2 * most) ** 2 >= 2**62:
                    raise ValueError(f"components of {most / spec.scale:.3g} are too large for exact distances")
                blobs.append(x.astype("<i4").tobytes())
            some = b.select([0, 1]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(blobs, pa.binary())], ["vec_id", "label", "q"])

    x = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), (F.col(f"`{label}`") if label else F.lit(None).cast("string")).alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    kind = lambda c: x.schema[c].dataType.simpleString()
    return x.mapInArrow(giving_back(run), f"vec_id {kind('vec_id')}, label {kind('label')}, q binary")


def _cut(q: np.ndarray, parts: int) -> np.ndarray:
    """Rows of integers as (part, row, position)."""
    return q.reshape(len(q), parts, -1).transpose(1, 0, 2)


def screen(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries may be nearest: a mask (part, row, entry) that holds every nearest entry.

    With s = |c|^2 - 2 v.c in float32, u = 2^-24 and parts of w components: the product of rounded operands,
    summed in any order, is off by at most (w + 2) u |v||c| to first order, rounding |c|^2 and the
    difference adds 2 u (|c|^2 + 2 |v||c|), and adding the bound itself as much again. The factor below
    covers these with room for terms of second order and for the bound's own rounding.
    """
    w = book.shape[2]
    c2 = (book * book).sum(2)
    cn, vn = np.sqrt(c2.astype(np.float64)), np.sqrt((v * v).sum(2).astype(np.float64))
    s = c2.astype(np.float32)[:, None, :] - 2 * np.matmul(v.astype(np.float32), book.astype(np.float32).transpose(0, 2, 1))
    wide = np.float32((2 * w + 16) * 2.0**-24 * 1.01)
    bound = wide * (c2.astype(np.float32)[:, None, :] + 2 * vn.astype(np.float32)[:, :, None] * cn.astype(np.float32)[:, None, :])
    best = (s + bound).min(2, keepdims=True)
    return s - bound <= best


def assign(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry (row, part) and its squared distance, exact."""
    parts = len(book)
    numbers, errors = np.empty((len(q), parts), np.uint8), np.empty((len(q), parts), np.int64)
    for lo in range(0, len(q), BLOCK):
        v = _cut(q[lo : lo + BLOCK].astype(np.int64), parts)
        may = screen(v, book)
        near = may.argmax(2)
        p, i = np.nonzero(may.sum(2) > 1)
        step = max(1, DOUBTFUL // (book.shape[1] * book.shape[2]))
        for k in range(0, len(p), step):
            a, b = p[k : k + step], i[k : k + step]
            row, entry = np.nonzero(may[a, b])  # all entries in doubt of each doubtful part
            d = v[a[row], b[row]] - book[a[row], entry]
            d = (d * d).sum(1)
            order = np.lexsort((entry, d, row))
            first = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
            near[a[row[first]], b[row[first]]] = entry[first]
        d = v - np.take_along_axis(book, near[:, :, None], 1)
        numbers[lo : lo + BLOCK], errors[lo : lo + BLOCK] = near.T, (d * d).sum(2).T
    return numbers, errors


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1)


def refine(kept: DataFrame, book: np.ndarray) -> np.ndarray:
    """One round: entries become the floored means of the parts nearest to them; unused ones stay."""
    parts, entries, w = book.shape
    shared = kept.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, w), np.int64)
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                q = _matrix(b.column(0).slice(lo, BLOCK))
                slot = (assign(q, book)[0] + np.arange(parts) * entries).ravel()
                n += np.bincount(slot, minlength=len(n))
                values = q.astype(np.float64).reshape(-1, w)  # sums of a block are exact below 2^53
                for k in range(w):
                    sums[:, k] += np.bincount(slot, values[:, k], len(n)).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = kept.select("q").mapInArrow(giving_back(run), "slot long, n long, sums array<long>").select("slot", "n", F.posexplode("sums").alias("k", "s"))
    book = book.reshape(-1, w).copy()
    for r in found.groupBy("slot", "k").agg(exact("n").alias("n"), exact("s").alias("s")).collect():  # at most one row for each number in the codebooks
        book[r["slot"], r["k"]] = int(r["s"]) // int(r["n"])
    shared.unpersist()
    return book.reshape(parts, entries, w)


def _with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the error summed over equal labels. Labels that many rows share are few, and
    are sent to every executor; the others are joined by shuffle."""
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "code-labels")
    n = sums.agg(F.sum("_n")).first()[0] or 0
    join = lambda rows, s: rows.join(s.withColumnRenamed("label", "_l").drop("_n"), rows["label"].eqNullSafe(F.col("_l")), "inner").drop("_l")
    held = small(sums)
    if held is not sums:
        return join(codes, held)
    hot = F.broadcast(sums.where(F.col("_n") * HOT >= n))
    rest = codes.join(hot.select(F.col("label").alias("_l")), codes["label"].eqNullSafe(F.col("_l")), "left_anti")
    return join(codes, hot).unionByName(join(rest, sums.where(F.col("_n") * HOT < n)))


def compress(rows: DataFrame, spec: Spec = Spec(), vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(rows (vec_id, label, code, error, label_error), final codebooks as (part, entry, position)). Without a
    usable row, the first is empty and the second None."""
    every = materialize(quantise(rows, spec, vec_id, vector, label), "code-vectors")
    first = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    head = every.where(F.octet_length("q") % (4 * spec.parts) == 0).orderBy(*first).limit(1).collect()
    if not head:
        release(every)
        empty = "vec_id {}, label {}".format(*(every.schema[c].dataType.simpleString() for c in ("vec_id", "label")))
        return every.sparkSession.createDataFrame([], f"{empty}, code string, error long, label_error long"), None
    kept = every.where(F.octet_length("q") == len(head[0]["q"]))
    start = kept.orderBy(*first).limit(spec.entries).select("q").collect()
    book = np.ascontiguousarray(_cut(np.stack([np.frombuffer(r["q"], "<i4") for r in start]).astype(np.int64), spec.parts))
    for _ in range(spec.rounds):
        book = refine(kept, book)
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                numbers, errors = assign(_matrix(b.column(2)), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in numbers]), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    kind = lambda c: every.schema[c].dataType.simpleString()
    codes = materialize(kept.mapInArrow(giving_back(run), f"vec_id {kind('vec_id')}, label {kind('label')}, code string, error long"), "codes")
    release(every)
    return _with_label_errors(codes), book


def book_digest(book: np.ndarray | None) -> str:
    """SHA-256 of all components, as decimals joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist() if book is not None else [])).encode()).hexdigest()


def decode(code: str, book: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book[p, e] for p, e in enumerate(bytes.fromhex(code))])
