"""Exact duplicates by a tree of merges over sorted runs of digests.

Every input partition is a run: its texts' SHA-256 digests, sorted, one entry for each distinct digest with
the identifier that stays, the number of rows and the runs that hold it. In binomial rounds, ``FAN`` neighbouring
runs exchange slices: each keeps the digests whose next bits name it, and merges the ``FAN`` sorted slices
that it gets. After r rounds a merged run covers ``FAN ** r`` input runs and that share of all digests, so runs
don't grow on the way up, no task ever sees a whole level, and a text that a third of all rows repeat is one
entry of each run. Entries are verified at every level: digests count as equal only with equal lengths
and equal second hashes (64 bits, another function).

The way down: entries with several rows go back to the runs that hold them, keyed by run and digest, and meet
the rows there. So a group of copies is dealt over as many keys as runs hold it.

Edge cases: a null text counts as empty; null ids are behind all others (kept only in groups of nulls); of
rows with equal id and text exactly one is kept, the one in the earliest run; an empty table gives an empty
result; other columns, whatever their names, are ignored (``resolve``) or passed on (``deduplicate``); ids
must be integers, others are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, giving_back, materialize, release, small

#: Runs merged at once, digests a merged run should hold, and rows gathered before a sorted slice is handed on.
FAN_BITS, RUN_ENTRIES, FLUSH = 4, 1 << 18, 1 << 17
FAN = 1 << FAN_BITS
#: Columns of an entry: four words of the digest, second hash, length, id missing, id, row, rows in the group, runs.
_CHECK, _SIZE, _NONE, _ID, _ROW, _COUNT, _RUNS, _WIDTH = 4, 5, 6, 7, 8, 9, 10, 11


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """row, run, id, digest, check (second hash) and size of each row's text, written once: rows and runs
    are numbered as they are read, and keep their numbers."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise ValueError("identifiers must be integers")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    value = F.coalesce(normalise(value), F.lit("")) if normalise else value
    x = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), value.alias("v"), F.monotonically_increasing_id().alias("row"))
    x = x.select("row", F.shiftrightunsigned("row", 33).cast("int").alias("run"), "id", F.unhex(F.sha2("v", 256)).alias("digest"), F.xxhash64("v").alias("check"), F.octet_length("v").cast("long").alias("size"))
    return materialize(x, "dedup-digests")


def _pack(entries: np.ndarray, runs: np.ndarray) -> bytes:
    return np.int64(len(entries)).tobytes() + entries.tobytes() + runs.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.uint64, n * _WIDTH, 8).reshape(n, _WIDTH), np.frombuffer(blob, np.int32, offset=8 + 8 * n * _WIDTH)


def merge_runs(entries: np.ndarray, runs: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of all entries: equal digests (verified) become one, with the id that stays, the number of
    rows and the distinct runs of all. ``runs`` lists each entry's runs, one entry after the other."""
    if not len(entries):
        return entries, runs
    signed = entries[:, _ID].view(np.int64)
    order = np.lexsort((entries[:, _ROW], ~signed if largest else signed, entries[:, _NONE], *(entries[:, c] for c in (_SIZE, _CHECK, 3, 2, 1, 0))))
    size = entries[:, _RUNS].astype(np.int64)
    begin = np.cumsum(size) - size
    x, size, begin = entries[order], size[order], begin[order]
    first = np.flatnonzero(np.concatenate(([True], (x[1:, : _SIZE + 1] != x[:-1, : _SIZE + 1]).any(1))))
    out = x[first].copy()
    out[:, _COUNT] = np.add.reduceat(x[:, _COUNT], first)
    group = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x)))), size)
    held = runs[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    pairs = np.unique(group << 32 | held)  # a run that was handed on in several slices counts once
    out[:, _RUNS] = np.bincount(pairs >> 32, minlength=len(first))
    return out, (pairs & 0xFFFFFFFF).astype(np.int32)


def _slices(entries: np.ndarray, runs: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """A sorted run cut by the leading ``bits`` of its digests: (those bits, slice)."""
    prefix = (entries[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))) if len(prefix) else np.empty(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(entries[:, _RUNS].astype(np.int64))))
    for a, b in zip(cut, [*cut[1:], len(prefix)], strict=True):
        yield int(prefix[a]), _pack(entries[a:b], runs[upto[a] : upto[b]])


_PIECE = pa.schema([("g", pa.int32()), ("p", pa.int64()), ("blob", pa.binary())])


def first_runs(rows: DataFrame, largest: bool) -> DataFrame:
    """Sorted slices (g, p, blob) of every input run, for the first round."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        out = []
        run, valid, ids, row, check, size = (np.concatenate([h[k] for h in held]) for k in range(6))
        words = np.frombuffer(b"".join(h[6] for h in held), ">u8").astype(np.uint64).reshape(-1, 4)
        x = np.empty((len(run), _WIDTH), np.uint64)
        x[:, :4], x[:, _CHECK], x[:, _SIZE], x[:, _NONE] = words, check.view(np.uint64), size.view(np.uint64), ~valid
        x[:, _ID], x[:, _ROW], x[:, _COUNT], x[:, _RUNS] = ids.view(np.uint64), row.view(np.uint64), 1, 1
        for r in np.unique(run):
            mine = run == r
            entries, runs = merge_runs(x[mine], run[mine], largest)
            out += [(int(r) // FAN, p, blob) for p, blob in _slices(entries, runs, FAN_BITS)]
        return pa.RecordBatch.from_pylist([dict(zip(_PIECE.names, o, strict=True)) for o in out], _PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column(1)
            held.append((b.column(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), *(b.column(k).to_numpy() for k in (2, 3, 4)), b"".join(b.column(5).to_pylist())))
            n += len(b)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return rows.select("run", "id", "row", "check", "size", "digest").mapInArrow(giving_back(cut), "g int, p long, blob binary")


def exchange(pieces: DataFrame, turn: int, largest: bool) -> DataFrame:
    """One round: slices of the same group of runs and the same range of digests meet, become one sorted run,
    and are cut for the next round."""

    def meet(key, table):
        got = [_unpack(b) for b in table.column("blob").to_pylist()]
        entries, runs = merge_runs(np.concatenate([e for e, _ in got]), np.concatenate([r for _, r in got]), largest)
        rows = [{"g": key[0].as_py() // FAN, "p": p, "blob": b} for p, b in _slices(entries, runs, FAN_BITS * (turn + 1))]
        return pa.Table.from_pylist(rows, _PIECE)

    return pieces.groupBy("g", "p").applyInArrow(meet, "g int, p long, blob binary")


def verdicts(pieces: DataFrame, largest: bool) -> DataFrame:
    """The last round: rows (run, digest, check, size, keep_id, keep_row, group_size) of all groups with several
    rows, one for each run that holds the group."""
    names = ["run", "digest", "check", "size", "keep_id", "keep_row", "group_size"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def meet(key, table):
        got = [_unpack(b) for b in table.column("blob").to_pylist()]
        entries, runs = merge_runs(np.concatenate([e for e, _ in got]), np.concatenate([r for _, r in got]), largest)
        many = entries[:, _COUNT] > 1
        size = entries[:, _RUNS].astype(np.int64)
        runs = runs[np.repeat(many, size)]
        x = entries[many]
        at = np.repeat(np.arange(len(x)), size[many])
        digests = pa.array([r.tobytes() for r in x[:, :4].astype(">u8")], pa.binary()).take(pa.array(at))
        number = lambda c: pa.array(x[at, c].view(np.int64))
        ids = pa.array(x[at, _ID].view(np.int64), mask=x[at, _NONE] > 0)
        return pa.Table.from_arrays([pa.array(runs), digests, number(_CHECK), number(_SIZE), ids, number(_ROW), number(_COUNT)], schema=pa.schema(list(zip(names, kinds, strict=True))))

    return pieces.groupBy("g", "p").applyInArrow(meet, "run int, digest binary, check long, size long, keep_id long, keep_row long, group_size long")


def rounds_for(runs: int, rows: int) -> int:
    """Rounds after which one group holds all runs, and merged runs have about ``RUN_ENTRIES`` entries."""
    n = 1
    while FAN**n < max(runs, -(-rows // RUN_ENTRIES)):
        n += 1
    return n


def _resolved(docs: DataFrame, doc_id: str, text: str, largest: bool, normalise) -> DataFrame:
    rows = describe(docs, doc_id, text, normalise)
    r = rows.agg(F.max("run").alias("runs"), F.count("*").alias("n")).first()
    rounds = rounds_for((r["runs"] or 0) + 1, r["n"])
    pieces = first_runs(rows, largest)
    for turn in range(1, rounds):
        pieces = exchange(pieces, turn, largest)
    found = materialize(verdicts(pieces, largest), "dedup-verdicts")
    key = ["run", "digest", "check", "size"]
    return rows.join(small(found), key, "left").select(
        "id", "row", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def resolve(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = False, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``. The row with the smallest
    id of each group of equal texts stays, or the one with the ``largest``. ``normalise`` maps the text
    before it is compared."""
    return _resolved(docs, doc_id, text, largest, normalise).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = False, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts."""
    rows = materialize(_resolved(docs, doc_id, text, largest, normalise).where("group_size > 1").select("id", "digest", "kept", F.col("id").eqNullSafe(F.col("keep_id")).alias("best")), "dedup-groups")
    key, i, h = fresh(docs, "digest", "id", "h")
    name = lambda d: d.select(F.col("id").alias(i), F.col("digest").alias(h))
    gone = materialize(name(rows.where("not best").distinct()), "dedup-gone")
    again = materialize(name(rows.where("best and not kept").distinct()), "dedup-again")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    x = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(normalise(value), F.lit("")) if normalise else value, 256)))
    same = lambda a, b: (a[key] == b[h]) & a[f"`{doc_id}`"].cast("long").eqNullSafe(b[i])
    kept = x.join(small(gone), same(x, gone), "left_anti")
    if again.isEmpty():
        release(rows)
        return kept.drop(key)
    once = kept.join(small(again), same(kept, again), "left_semi").dropDuplicates([key, doc_id])
    return kept.join(small(again), same(kept, again), "left_anti").unionByName(once).drop(key)
