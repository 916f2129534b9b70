"""N-gram Jaccard self-join under several global token orders.

Texts are sets of hashed word shingles. Under any total order of tokens, two sets whose Jaccard
similarity is at least T share a token among the first ``n - ceil(T * n) + 1`` of each (its prefix),
so pairs that share no prefix token under even one order need no verification.

Orders: the first runs from rare to frequent tokens (a class of document frequency counted over all
texts, then the hash); it deals sets into buckets, one for each prefix token. The others (descending
hash, mixed hash) filter inside the buckets, whose rows carry 16 bits of each prefix token under every
further order (``marks``); with them goes a parity sketch that bounds how far two sets differ. Only
pairs that share prefix tokens under all orders and are near enough by the sketch are handed on, and
have their intersections counted. All filters are lossless. Prefixes of over 128 tokens (sets of over
about 640) carry the sketch only. An order need only be the same for all texts, so frequency is counted
on 32 bits of the hash.

Components rather than all pairs: texts with equal sets are one class from the start. In every bucket
all classes are compared with one member, then with eight others, and pairs that are connected already
are never compared again. What remains in several components after those rounds is compared in full,
inside tasks that see a tile of a bucket at a time and hand on only pairs that pass all filters. So a
group of near copies costs its size times a few rounds, plus comparisons of sketches for its members
that have no link, and no link between components is lost.

Tokens in fewer than ``heavy`` texts make buckets of fewer than ``heavy`` classes, which are gathered
in numpy by hash range; the rest (frequent passages, large groups) go through joins that split hot
keys. Set identities are 64-bit digests: among a billion different texts, two are mistaken for equal
with a chance of about 3 %.

Edge cases: a text without words, or null, has an empty set and links with nothing; repeated rows are
one class; a null id never becomes the component's id unless all ids of the component are null; an
empty table gives an empty result; further columns are not needed and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, giving_back, materialize, release, small
from .components import compare_parts, connect
from .wordhash import mix, set_id, shingle_sets

WORDS, NUM, DEN = 5, 80, 100
#: Texts in which a token must occur to count as frequent, and how many such tokens are broadcast at most (4 bytes each, and a class).
HEAVY, MAX_HEAVY = 32, 4_000_000
#: Prefix tokens a range of hashes should hold, and tokens gathered before they are handed on.
RANGE_TOKENS, FLUSH = 1 << 20, 1 << 20


def prefix_size(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def compatible(a: str, b: str) -> str:
    """Sets of these sizes may be similar enough."""
    return f"{DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b})"


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, sig (the set's identity; null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sigs = [], []
            for s in shingle_sets(batch.column(2), WORDS):
                ns.append(0 if s is None else len(s))
                sigs.append(set_id(s) if s is not None and len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64())], ["doc_id", "th", "n_shingles", "sig"])

    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    return x.mapInArrow(giving_back(run), f"doc_id {x.schema['doc_id'].dataType.simpleString()}, th long, n_shingles long, sig long")


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted distinct 32-bit integers as differences, two bytes each where they fit."""
    gaps = np.diff(tokens)
    kind = np.uint16 if not len(gaps) or gaps.max() < 65536 else np.uint32
    return tokens[:1].tobytes() + (b"\2" if kind is np.uint16 else b"\4") + gaps.astype(kind).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    gaps = np.frombuffer(blob, np.uint16 if blob[4] == 2 else np.uint32, offset=5)
    return np.concatenate((np.frombuffer(blob, np.uint32, 1), np.frombuffer(blob, np.uint32, 1) + np.cumsum(gaps, dtype=np.uint32)))


def _new_sets(column: pa.Array, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Sets not met before in this task, so that copies count once a task."""
    for s in shingle_sets(column, WORDS):
        if s is not None and len(s) and (sig := set_id(s)) not in seen:
            seen.add(sig)
            yield sig, s


def frequent_tokens(docs: DataFrame, ranges: int, text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Rows (token, df): the leading 32 bits of hashes in at least ``heavy`` texts."""
    shift = 32 - ranges.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            where = tokens >> np.uint32(shift) if shift < 32 else np.zeros(len(tokens), np.uint32)
            at = np.searchsorted(where, np.arange(ranges + 1))
            rows = []
            for r in range(ranges):
                t, c = tokens[at[r] : at[r + 1]], counts[at[r] : at[r + 1]]
                if len(t):
                    many = np.flatnonzero(c > 1)
                    rows.append((r, _pack(t), many.astype(np.uint32).tobytes(), c[many].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_pylist([dict(zip(("range", "tokens", "many", "counts"), r, strict=True)) for r in rows], pa.schema([("range", pa.int32()), ("tokens", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            for _, s in _new_sets(batch.column(0), seen):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                n += len(s)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def total(key, table):
        tokens, counts = [], []
        for t, m, c in zip(*(table.column(x).to_pylist() for x in ("tokens", "many", "counts")), strict=True):
            t = _unpack(t)
            n = np.ones(len(t), np.int64)
            n[np.frombuffer(m, np.uint32)] = np.frombuffer(c, np.uint32)
            tokens.append(t)
            counts.append(n)
        tokens, at = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        keep = df >= heavy
        give_back()
        return pa.table({"token": tokens[keep].astype(np.int64), "df": df[keep]})

    blobs = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(giving_back(count), "range int, tokens binary, many binary, counts binary")
    return blobs.groupBy("range").applyInArrow(total, "token long, df long")


class _Order:
    """The first order's rank: class of frequency, then hash."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray):
        self.tokens, self.classes = tokens, classes

    def class_of(self, s: np.ndarray) -> np.ndarray:
        t = (s >> np.uint64(32)).astype(np.uint32)
        if not len(self.tokens):
            return np.zeros(len(s), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
        return np.where(self.tokens[at] == t, self.classes[at], 0).astype(np.uint64)

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix's tokens, and which of them are frequent."""
        c, p = self.class_of(s), prefix_size(len(s))
        rank = (c << np.uint64(58)) | (s >> np.uint64(6))
        first = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
        return s[first], c[first] > 0


def postings(docs: DataFrame, ranges: int, order, text: str = "text") -> DataFrame:
    """Prefix tokens under the first order: rare ones packed by hash range, frequent ones as rows."""
    shift = 64 - ranges.bit_length() + 1
    kind = "range int, blob binary, token long, sig long, n int"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        light, heavy, n = [], [], 0
        schema = pa.schema([("range", pa.int32()), ("blob", pa.binary()), ("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])

        def flush():
            rows = []
            if light:
                t, s, k = (np.concatenate(x) for x in zip(*light, strict=True))
                where = (t >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(t), np.int64)
                by = np.argsort(where, kind="stable")
                at = np.searchsorted(where[by], np.arange(ranges + 1))
                for r in range(ranges):
                    i = by[at[r] : at[r + 1]]
                    if len(i):
                        rows.append({"range": r, "blob": t[i].tobytes() + s[i].tobytes() + k[i].tobytes()})
            out = [pa.RecordBatch.from_pylist(rows, schema)] if rows else []
            if heavy:
                t, s, k = (np.concatenate(x) for x in zip(*heavy, strict=True))
                none = pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.binary())
                out.append(pa.RecordBatch.from_arrays([*none, pa.array(t.view(np.int64)), pa.array(s), pa.array(k)], schema=schema))
            return out

        for batch in batches:
            for sig, s in _new_sets(batch.column(0), seen):
                p, frequent = order.value.prefix(s)
                for into, which in ((light, ~frequent), (heavy, frequent)):
                    if m := int(which.sum()):
                        into.append((p[which], np.full(m, sig, np.int64), np.full(m, len(s), np.int32)))
                        n += m
                if n >= FLUSH:
                    yield from flush()
                    light, heavy, n = [], [], 0
        yield from flush()

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(giving_back(post), kind)


def buckets(posted: DataFrame) -> DataFrame:
    """Rows (bucket, sig, n): the classes that share a prefix token under the first order. Buckets of
    rare tokens with the same members are one; classes without a partner of fitting size are left out."""

    def gather(key, table):
        parts = []
        for b in table.column("blob").to_pylist():
            m = len(b) // 20
            parts.append((np.frombuffer(b, np.uint64, m), np.frombuffer(b, np.int64, m, 8 * m), np.frombuffer(b, np.int32, m, 16 * m)))
        t, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((s, n, t))
        t, s, n = t[by], s[by], n[by]
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s, n = t[keep], s[keep], n[keep].astype(np.int64)
        near = np.zeros(len(t), bool)  # sizes ascend within a token, so a partner is a neighbour
        near[1:] = (t[1:] == t[:-1]) & (DEN * n[:-1] >= NUM * n[1:])
        keep = near.copy()
        keep[:-1] |= near[1:]
        t, s, n = t[keep], s[keep], n[keep]
        if not len(t):  # no class of this range has a partner
            return pa.table({"bucket": pa.array([], pa.int64()), "sigs": pa.array([], pa.list_(pa.int64())), "ns": pa.array([], pa.list_(pa.int32()))})
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(first, len(t)))
        digest = mix(np.add.reduceat(mix(s.view(np.uint64)), first) + size.astype(np.uint64))
        _, one = np.unique(np.where(size > 1, digest, np.uint64(0)), return_index=True)
        one = one[size[one] > 1]
        give_back()
        rows = [(int(digest[i].view(np.int64)), s[first[i] : first[i] + size[i]].tolist(), n[first[i] : first[i] + size[i]].tolist()) for i in one]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "sigs": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "ns": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})

    sets = posted.where("range is not null").select("range", "blob").groupBy("range").applyInArrow(gather, "bucket long, sigs array<long>, ns array<int>")
    rare = sets.groupBy("bucket").agg(F.first(F.arrays_zip("sigs", "ns")).alias("m")).select("bucket", F.explode("m").alias("m")).select("bucket", F.col("m.sigs").alias("sig"), F.col("m.ns").alias("n"))
    often = posted.where("token is not null").select(F.col("token").alias("bucket"), "sig", "n").distinct()
    return rare.unionByName(often)


def _rows_of(docs: DataFrame, described: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The text of one row of each class in ``wanted`` (sig)."""
    one = described.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("r")).join(wanted, "sig", "left_semi")
    one = materialize(one.select(F.col("r.doc_id").alias("d"), F.col("r.th").alias("th")), "ngram-wanted")
    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    return x.join(small(one), (x["h"] == one["th"]) & x["doc_id"].eqNullSafe(one["d"]), "left_semi").select("text")


def _per_class(docs: DataFrame, described: DataFrame, wanted: DataFrame, doc_id: str, text: str, value) -> DataFrame:
    """Rows (sig, value), ``value(set)`` as bytes, one for each class in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = [(sig, value(s)) for sig, s in _new_sets(batch.column(0), seen)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["sig", "value"])

    found = materialize(_rows_of(docs, described, wanted, doc_id, text).mapInArrow(giving_back(run), "sig long, value binary"), "ngram-sets")
    if found.count() > found.select("sig").distinct().count():  # rows repeated with their ids
        found = materialize(found.dropDuplicates(["sig"]), "ngram-sets")
    return found


#: Bits of the parity sketch of sets of up to that many tokens and of larger ones; longest prefix whose further orders a row carries.
NARROW, WIDE, LISTED = 512, 2048, 128


def marks(s: np.ndarray) -> bytes:
    """What a bucket's row carries of a set: the parity of the number of its tokens in each of 512 (large
    sets: 2,048) classes, and 16 bits of its prefix tokens under each further order (descending hash,
    mixed hash), for prefixes of up to ``LISTED`` tokens."""
    p, bits = prefix_size(len(s)), NARROW if len(s) <= NARROW else WIDE
    parity = np.packbits((np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()
    if p > LISTED:
        return np.array([0, bits], np.uint16).tobytes() + parity
    x = mix(s)
    low = s[np.argpartition(x, p - 1)[:p]] if p < len(x) else s
    return np.array([p, bits], np.uint16).tobytes() + parity + np.concatenate((s[-p:], low)).astype(np.uint16).tobytes()


def _least_shared(i: np.ndarray, j: np.ndarray, size: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """For each pair of rows (i, j), the least value below ``top`` that both hold; ``top`` if none. Row r
    holds ``size[r]`` entries of ``value``, one row after the other."""
    at = np.cumsum(size) - size
    held = np.sort(np.repeat(np.arange(len(size)), size) * top + value)
    out = np.full(len(i), top, np.int64)
    for lo in range(0, len(i) if len(held) else 0, 20_000):
        a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
        n = size[a]
        v = value[np.repeat(at[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        want = np.repeat(b, n) * top + v
        hit = held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want
        np.minimum.at(out, lo + np.repeat(np.arange(len(a)), n)[hit], v[hit])
    return out


class Sketches:
    """The marks of a few thousand rows, as arrays. All tests are lossless: a pair that links passes."""

    def __init__(self, blobs: list[bytes], n: np.ndarray):
        self.n = n.astype(np.int64)
        head = np.array([np.frombuffer(b, np.uint16, 2) for b in blobs], np.int64).reshape(-1, 2)
        self.listed, self.wide = head[:, 0], head[:, 1] == WIDE
        self.parity, self.full = np.zeros((len(blobs), NARROW // 64), np.uint64), {}
        orders: list[list[np.ndarray]] = [[], []]
        for r, b in enumerate(blobs):
            size = int(head[r, 1]) // 8
            bits = np.frombuffer(b, np.uint64, size // 8, 4)
            if self.wide[r]:
                self.full[r] = bits
                bits = np.bitwise_xor.reduce(bits.reshape(WIDE // NARROW, -1), 0)
            self.parity[r] = bits
            p = int(head[r, 0])
            for k in (0, 1):
                orders[k].append(np.frombuffer(b, np.uint16, p, 4 + size + 2 * p * k))
        self.orders = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in orders]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of all pairs of rows ``i`` and ``j`` fit by size and parity. Sets with s tokens in all and a
        similarity of at least NUM / DEN differ in at most s * (DEN - NUM) / (DEN + NUM) tokens, and
        parities in no more classes than sets in tokens."""
        apart = np.bitwise_count(self.parity[i][:, None, :] ^ self.parity[j][None, :, :]).sum(2, dtype=np.int64)
        a, b = self.n[i][:, None], self.n[j][None, :]
        return (DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)) & ((DEN + NUM) * apart <= (DEN - NUM) * (a + b))

    def fit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (i[k], j[k]) pass all filters: size, parity, and shared prefix tokens under every further order."""
        a, b = self.n[i], self.n[j]
        ok = DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)
        ok &= (DEN + NUM) * np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(1, dtype=np.int64) <= (DEN - NUM) * (a + b)
        for k in np.flatnonzero(ok & self.wide[i] & self.wide[j]):
            x = int(np.bitwise_count(self.full[i[k]] ^ self.full[j[k]]).sum())
            ok[k] = (DEN + NUM) * x <= (DEN - NUM) * int(a[k] + b[k])
        for values in self.orders:
            k = np.flatnonzero(ok & (self.listed[i] > 0) & (self.listed[j] > 0))
            ok[k] = _least_shared(i[k], j[k], self.listed, values, 1 << 16) < 1 << 16
        return ok


def meet(bucket: int, side: np.ndarray, sig: np.ndarray, n: np.ndarray, label: np.ndarray, top: np.ndarray, blobs: list[bytes], large: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one part of ``components.tiles`` that pass all filters, each in one of their buckets if both rows name it."""
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    x = Sketches(blobs, n)
    ids = np.unique(np.concatenate([[bucket], *[v for v in large if v]]).astype(np.int64))
    size = np.array([len(v) if v else 0 for v in large], np.int64)
    named = np.searchsorted(ids, np.concatenate([np.empty(0, np.int64), *[v for v in large if v]]).astype(np.int64))
    left, right = [], []
    for lo in range(0, len(own), 128):
        o = own[lo : lo + 128]
        ok = x.near(o, other) & (label[o][:, None] != label[other][None, :]) & ((sig[o][:, None] < sig[other][None, :]) | top[other][None, :])
        i, j = np.nonzero(ok)
        i, j = o[i], other[j]
        first = _least_shared(i, j, size, named, len(ids))
        k = (first == len(ids)) | (ids[np.minimum(first, len(ids) - 1)] == bucket)
        i, j = i[k], j[k]
        k = x.fit(i, j)
        left.append(np.minimum(sig[i[k]], sig[j[k]]))
        right.append(np.maximum(sig[i[k]], sig[j[k]]))
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def compare_tiles(tiles: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass all filters among the rows that ``components.tiles`` brings together."""

    def of_part(bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        columns = [table.column(c).to_numpy() for c in ("side", "sig", "n", "label", "top")]
        return meet(bucket, *columns, table.column("value").to_pylist(), table.column("large").to_pylist())

    return compare_parts(tiles.join(marked, "sig").select("bucket", "i", "j", "side", "sig", "n", "label", "top", "value", "large"), of_part)


def filter_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass all filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            n = np.concatenate([batch.column(k).to_numpy() for k in (3, 5)])
            x = Sketches(batch.column(2).to_pylist() + batch.column(4).to_pylist(), n)
            yield batch.select([0, 1]).filter(pa.array(x.fit(np.arange(m), np.arange(m) + m), pa.bool_()))

    side = lambda c, x, k: marked.select(F.col("sig").alias(c), F.col("value").alias(x), F.col("n").alias(k))
    both = side("a", "x", "nx").join(small(pairs), "a").join(side("b", "y", "ny"), "b").select("a", "b", "x", "nx", "y", "ny")
    return both.mapInArrow(giving_back(run), "a long, b long")


def similar(a: bytes, b: bytes) -> bool:
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.intersect1d(a, b, assume_unique=True).size
    return DEN * both >= NUM * (len(a) + len(b) - both)


def keep_similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = [similar(x[i].as_buffer(), y[i].as_buffer()) for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("sig").alias("a"), F.col("value").alias("x")).join(small(pairs), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("value").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(giving_back(run), "a long, b long")


def link_classes(docs: DataFrame, described: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """Rows (node, label) for the classes that have a link; None if there is no link."""
    spark = docs.sparkSession
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = 1 << max(0, (int(total) // RANGE_TOKENS).bit_length())
    counted = materialize(frequent_tokens(docs, ranges, text), "ngram-frequent")
    least = HEAVY
    while counted.where(F.col("df") >= least).count() > MAX_HEAVY:
        least *= 2
    rows = counted.where(F.col("df") >= least).toPandas().sort_values("token")
    order = spark.sparkContext.broadcast(_Order(rows["token"].to_numpy(np.uint32), np.minimum(63, 1 + np.log2(np.maximum(1, rows["df"].to_numpy() / least)) * 2).astype(np.uint8)))
    posted = materialize(postings(docs, ranges, order, text), "ngram-postings")
    open_ = materialize(buckets(posted), "ngram-buckets")
    release(posted)
    release(counted)
    if open_.isEmpty():
        release(open_)
        order.unpersist()
        return None
    sizes = open_.groupBy("sig").agg(F.first("n").alias("n"))
    found = _per_class(docs, described, sizes.select("sig"), doc_id, text, marks)
    marked = materialize(found.join(sizes, "sig"), "ngram-marks")
    release(found)
    sets: list[DataFrame] = []

    def verify(pairs: DataFrame) -> DataFrame | None:
        passed = materialize(pairs, "ngram-passed")
        if passed.isEmpty():
            return None
        wanted = passed.select(F.col("a").alias("sig")).union(passed.select("b")).distinct()
        for known in sets:
            wanted = wanted.join(known.select("sig"), "sig", "left_anti")
        wanted = materialize(wanted, "ngram-missing")
        if not wanted.isEmpty():
            sets.append(_per_class(docs, described, wanted, doc_id, text, lambda s: s.tobytes()))
        every = sets[0]
        for more in sets[1:]:
            every = every.union(more)
        links = materialize(keep_similar(passed, every), "ngram-links")
        release(wanted)
        release(passed)
        return links

    labels = connect(open_, lambda pairs: filter_pairs(pairs, marked), lambda t: compare_tiles(t, marked.select("sig", "value")), verify, compatible("n", "n2"))
    for x in (open_, marked, *sets):
        release(x)
    order.unpersist()
    return labels


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, th, n_shingles and first, the least row (doc_id, then
    th; null ids last) of its component, null for empty sets."""
    described = materialize(describe(docs, doc_id, text), "ngram-described")
    labels = link_classes(docs, described, doc_id, text)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = described.where("sig is not null").groupBy("sig").agg(F.min(row).alias("first"))
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        least = classes.groupBy("label").agg(F.min("first").alias("first"))
        classes = classes.select("sig", "label").join(least, "label").select("sig", "first")
    return described.join(classes, "sig", "left").select("doc_id", "th", "n_shingles", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``."""
    return components_of(docs, doc_id, text).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the least id; rows with empty sets stay."""
    rows = materialize(components_of(docs, doc_id, text).where("first is not null"), "ngram-components")
    key, i, h = fresh(docs, "th", "id", "h")
    keeper = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    gone = rows.where(~keeper).select(F.col("doc_id").alias(i), F.col("th").alias(h))
    again = materialize(rows.where(keeper).groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(i), F.col("th").alias(h)), "ngram-again")
    same = lambda x, y: (x[key] == y[h]) & x[f"`{doc_id}`"].eqNullSafe(y[i])
    x = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`")))
    gone = materialize(gone, "ngram-gone")
    kept = x.join(small(gone), same(x, gone), "left_anti")
    if again.isEmpty():
        return kept.drop(key)
    once = kept.join(small(again), same(kept, again), "left_semi").dropDuplicates([key, doc_id])
    return kept.join(small(again), same(kept, again), "left_anti").unionByName(once).drop(key)
