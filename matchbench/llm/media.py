"""Copies among images by local descriptors.

Corners are found at several scales; each gets an orientation (intensity centroid) and 256 binary
brightness tests in its turned neighbourhood. Hamming tables: a key is a fixed choice of 20 bits of a
corner's descriptor together with the same bits of the nearest corner that is at least a neighbourhood
away; there are two such choices. Two corners instead of one, because single neighbourhoods of unrelated
pictures are often alike. Rows of a key carry where the second corner lies as seen from the first, and
only rows that agree on that make a candidate. Candidates are matched corner by corner and hold if
enough matches agree on one similarity transform.

Found are copies that are cropped (to less than half of the area of even the smallest pictures), brightened, blurred, noisy,
turned by quarter turns, or scaled by about a step of the pyramid (0.8, 1.25 and their powers); recall
against comparing all pairs is measured in the tests and in the README. Turns in between and scales
between the steps change too many bits to be found surely.

Images with equal descriptors and places are one class from the start; a key's images are first
compared with a few of them, not with each other (see ``components.connect``).

Media are binary columns in the portable graymap or pixmap format (P5, P6).

Edge cases: null, empty or undecodable media, images smaller than a descriptor and flat images have
no corners and link with nothing; a null id links like others and never names a component; repeated
rows are one class; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, materialize, release, small
from .components import TILE, compare_parts, connect
from .wordhash import mix

RADIUS, BITS = 9, 256
#: All corners above the response threshold are kept at each scale.
SCALES = (1.0, 0.8, 0.64, 0.512)
#: Corners that are described or matched at once.
BLOCK = 1024
#: Bits in which matched descriptors may differ, pixels by which places may, matches that must agree, and their
#: least share of the corners of the picture that has fewer (large pictures agree in a few by chance).
MAX_BITS, MAX_PIXELS, AGREE, SHARE = 40, 3.0, 5, 1 / 6
#: Tables, bits of each corner in a key, and least distance of its corners (in pixels of their scale).
TABLES, KEY_BITS, APART = 2, 20, 12.0
#: Pixels and turns by which the second corner's place and orientation, seen from the first, may differ.
NEAR_PIXELS, NEAR_TURNS = 5, 2


def _tests(reach: float = 8.0, least: float = 3.0) -> np.ndarray:
    """Pairs of points in a disc, not too near each other: such tests depend little on one another."""
    p = np.random.Generator(np.random.PCG64(3)).uniform(-reach, reach, (8 * BITS, 4))
    far = np.hypot(p[:, 0] - p[:, 2], p[:, 1] - p[:, 3]) >= least
    return p[(np.hypot(p[:, 0], p[:, 1]) <= reach) & (np.hypot(p[:, 2], p[:, 3]) <= reach) & far][:BITS]


_PATTERN = _tests()
_CHOICES = [np.random.Generator(np.random.PCG64(11 + t)).permutation(BITS)[:KEY_BITS] for t in range(TABLES)]
_TURNS = 36
_ANGLES = np.arange(_TURNS) * 2 * np.pi / _TURNS
_TURNED = np.stack([np.concatenate([np.round(_PATTERN[:, i : i + 2] @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])) for i in (0, 2)], 1) for a in _ANGLES]).astype(np.int64)
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_GRID**2).sum(0) <= RADIUS**2
#: Places in eighths of a pixel of the whole picture, number of the scale, number of the turn.
_CORNER = np.dtype([("x", "<u4"), ("y", "<u4"), ("scale", "u1"), ("turn", "u1"), ("bits", "u1", BITS // 8)])
_HEAD = re.compile(rb"\AP([56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def decode(media: bytes | None) -> np.ndarray | None:
    """Brightness of a graymap or pixmap, or None."""
    m = _HEAD.match(media or b"")
    if not m:
        return None
    kind, w, h, top = (int(x) for x in m.groups())
    n = w * h * (3 if kind == 6 else 1)
    data = np.frombuffer(media, np.uint8, offset=m.end())[:n] if top < 256 else np.empty(0, np.uint8)
    if len(data) < n or not n:
        return None
    if kind == 6:
        return data.reshape(h, w, 3) @ np.array([0.299, 0.587, 0.114], np.float32)
    return data.reshape(h, w).astype(np.float32)


def encode(gray: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (gray.shape[1], gray.shape[0]) + np.clip(np.round(gray), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1, edges repeated."""
    n = 2 * r + 1
    c = np.cumsum(np.pad(a, ((r + 1, r), (r, r)), "edge"), 0)
    c = (c[n:] - c[:-n])[:, :]
    c = np.cumsum(np.pad(c, ((0, 0), (1, 0))), 1)
    return (c[:, n:] - c[:, :-n]) / (n * n)


def _resize(a: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return a
    h, w = (max(1, int(round(n * scale))) for n in a.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    a = _box(a, 1)
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def corners(gray: np.ndarray) -> np.ndarray:
    """Oriented corners with descriptors, as records of ``_CORNER``."""
    found = []
    for k, scale in enumerate(SCALES):
        a = _resize(gray.astype(np.float64), scale)
        h, w = a.shape
        if min(h, w) < 2 * RADIUS + 3:
            continue
        smooth = _box(a, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        score = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
        inner = score[RADIUS:-RADIUS, RADIUS:-RADIUS]
        if inner.max() <= 1e-6:
            continue
        around = np.stack([score[RADIUS + i : h - RADIUS + i, RADIUS + j : w - RADIUS + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
        peak = (inner >= around.max(0)) & (inner > 0.001 * inner.max())
        y, x = np.nonzero(peak)
        by = np.lexsort((x, y, -np.round(inner[y, x], 3)))
        y, x = y[by] + RADIUS, x[by] + RADIUS
        soft = _box(a, 2)
        found += [_describe(soft, y[i : i + BLOCK], x[i : i + BLOCK], k) for i in range(0, len(y), BLOCK)]
    return np.concatenate(found) if found else np.zeros(0, _CORNER)


def _describe(smooth: np.ndarray, y: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    patch = smooth[y[:, None, None] + _GRID[0], x[:, None, None] + _GRID[1]] * _DISC
    angle = np.arctan2((patch * _GRID[0]).sum((1, 2)), (patch * _GRID[1]).sum((1, 2)))
    turn = np.round(angle / (2 * np.pi) * _TURNS).astype(int) % _TURNS
    t = _TURNED[turn]
    dy, dx = np.clip(t[:, :, (1, 3)], -RADIUS, RADIUS), np.clip(t[:, :, (0, 2)], -RADIUS, RADIUS)
    value = smooth[y[:, None, None] + dy, x[:, None, None] + dx]
    out = np.zeros(len(y), _CORNER)
    out["x"], out["y"], out["scale"], out["turn"] = np.round(8 * x / SCALES[k]), np.round(8 * y / SCALES[k]), k, turn
    out["bits"] = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
    return out


def _nearest(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each corner of ``a`` the corner of ``b`` that differs in the fewest bits (the first of several), and in
    how many; and the same for the corners of ``b``."""
    x, y = (np.ascontiguousarray(c["bits"]).view(np.uint64) for c in (a, b))
    da, ja = np.full(len(a), BITS + 1, np.int64), np.zeros(len(a), np.int64)
    db, jb = np.full(len(b), BITS + 1, np.int64), np.zeros(len(b), np.int64)
    for i in range(0, len(a), BLOCK):
        for k in range(0, len(b), BLOCK):
            apart = np.bitwise_count(x[i : i + BLOCK, None, :] ^ y[None, k : k + BLOCK, :]).sum(2, dtype=np.int64)
            for d, j, lo, at, axis in ((da, ja, i, k, 1), (db, jb, k, i, 0)):
                best, n = apart.argmin(axis), apart.min(axis)
                closer = np.flatnonzero(n < d[lo : lo + len(n)])
                d[lo + closer], j[lo + closer] = n[closer], best[closer] + at
    return (ja, da), (jb, db)


def _one_transform(a: np.ndarray, b: np.ndarray, j: np.ndarray, apart: np.ndarray) -> bool:
    """Do enough of the matches of ``a``'s corners with corners ``j`` of ``b`` agree on a similarity transform?"""
    i = np.flatnonzero(apart <= MAX_BITS)
    need = max(AGREE, SHARE * min(len(a), len(b)))
    if len(i) < need:
        return False
    j = j[i]
    scale = np.array(SCALES)
    pa_, pb = ((c["x"][m].astype(np.float64) + 1j * c["y"][m]) / 8 for c, m in ((a, i), (b, j)))
    turn = ((b["turn"][j].astype(np.int64) - a["turn"][i] + _TURNS // 2) % _TURNS - _TURNS // 2) * 2 * np.pi / _TURNS
    turn = np.where(np.abs(turn) < 0.3, 0.0, turn)  # orientations are coarse
    factor = (scale[a["scale"][i]] / scale[b["scale"][j]]) * np.exp(1j * turn)
    places = np.unique(np.round(pa_), return_inverse=True)[1]
    for k in range(0, len(i), BLOCK):
        moved = factor[k : k + BLOCK, None] * (pa_[None, :] - pa_[k : k + BLOCK, None]) + pb[k : k + BLOCK, None]
        agree = np.abs(moved - pb[None, :]) <= MAX_PIXELS
        if any(len(np.unique(places[row])) >= need for row in agree[agree.sum(1) >= need]):
            return True
    return False


def same_picture(a: bytes, b: bytes) -> bool:
    """Do enough corners match under one similarity transform, from either side?"""
    a, b = np.frombuffer(a, _CORNER), np.frombuffer(b, _CORNER)
    there, back = _nearest(a, b)
    return _one_transform(a, b, *there) or _one_transform(b, a, *back)


def keys(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a picture's corners, and of each the second corner's place (8 bits each way) and turn as seen from the first."""
    found, seen = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for k in np.unique(c["scale"]):
        own = c[c["scale"] == k]
        z = (own["x"].astype(np.float64) + 1j * own["y"]) / 8 * SCALES[k]
        near, ok = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        for i in range(0, len(own), BLOCK):
            d = np.abs(z[i : i + BLOCK, None] - z[None, :])
            d[d < APART] = np.inf
            near[i : i + BLOCK], ok[i : i + BLOCK] = d.argmin(1), np.isfinite(d.min(1))
        i = np.flatnonzero(ok)
        j = near[i]
        place = (z[j] - z[i]) * np.exp(-2j * np.pi / _TURNS * own["turn"][i])
        turn = (own["turn"][j].astype(np.int64) - own["turn"][i]) % _TURNS
        place = np.clip(np.round([place.real, place.imag]) + 128, 0, 255).astype(np.int64)
        bits = np.unpackbits(own["bits"], axis=1).astype(np.uint64)
        for t, choice in enumerate(_CHOICES):
            code = bits[:, choice] @ (np.uint64(1) << np.arange(KEY_BITS, dtype=np.uint64))
            found.append(mix((code[i] << np.uint64(KEY_BITS)) + code[j] + np.uint64((t + 1) << 2 * KEY_BITS)).view(np.int64))
            seen.append((place[0] << 16 | place[1] << 8 | turn).astype(np.int32))
    return np.concatenate(found), np.concatenate(seen)


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether second corners are seen at about the same place and turn."""
    turn = np.abs((x & 255) - (y & 255))
    far = ((x >> 16) - (y >> 16)) ** 2 + ((x >> 8 & 255) - (y >> 8 & 255)) ** 2
    return (far <= NEAR_PIXELS**2) & (np.minimum(turn, _TURNS - turn) <= NEAR_TURNS)


def describe(media: DataFrame, media_id: str = "media_id", content: str = "media") -> DataFrame:
    """Rows (media_id, sig, n, corners): sig and corners are null without corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ns, packed = [], [], []
            for m in batch.column(1).to_pylist():
                gray = decode(m)
                c = corners(gray) if gray is not None else np.zeros(0, _CORNER)
                raw = c.tobytes()
                words = np.frombuffer(raw + bytes(-len(raw) % 8), np.uint64)
                places = np.arange(1, len(words) + 1, dtype=np.uint64)
                sigs.append(int(mix(np.array([mix(words ^ mix(places)).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0]) if len(c) else None)
                ns.append(len(c))
                packed.append(raw if len(c) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), pa.array(packed, pa.binary())], ["media_id", "sig", "n", "corners"])

    x = media.select(F.col(f"`{media_id}`").alias("media_id"), F.col(f"`{content}`").alias("media"))
    return x.mapInArrow(giving_back(run), f"media_id {x.schema['media_id'].dataType.simpleString()}, sig long, n int, corners binary")


def hamming_tables(described: DataFrame) -> DataFrame:
    """Rows (bucket, sig, n, seen): a bucket for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((0, 4), np.int64)]
            for s, n, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                k, seen = keys(np.frombuffer(c, _CORNER))
                out.append(np.unique(np.column_stack((k, np.full(len(k), s), np.full(len(k), n), seen)), axis=0))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], ["bucket", "sig", "n", "seen"])

    return described.where("sig is not null").select("sig", "n", "corners").mapInArrow(giving_back(run), "bucket long, sig long, n int, seen int")


def agreeing(tables: DataFrame) -> DataFrame:
    """The rows of ``hamming_tables`` that agree with another picture's row of their key. No other row makes a candidate, and as keys of
    unrelated pictures coincide the more the more pictures there are, most rows end here. Keys of over ``TILE`` rows pass whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        through = None

        def kept(t: pa.Table) -> pa.Table:
            bucket, sig, seen = (t.column(c).to_numpy() for c in ("bucket", "sig", "seen"))
            new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            keep = np.repeat((size := np.diff(np.append(new, len(t)))) > TILE, size)
            i, d = np.flatnonzero(~keep), 1
            while len(i):
                i = i[i + d < len(t)]
                i = i[bucket[i] == bucket[i + d]]
                ok = i[(sig[i] != sig[i + d]) & agree(seen[i], seen[i + d])]
                keep[ok] = keep[ok + d] = True
                d += 1
            return t.filter(pa.array(keep))

        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None and len(rest) else t
            bucket = t.column("bucket").to_numpy()
            if through is not None:  # the rest of a large key
                n = int(np.argmax(bucket != through)) if (bucket != through).any() else len(t)
                yield from t.slice(0, n).to_batches()
                if n == len(t):
                    continue
                t, bucket, through = t.slice(n), bucket[n:], None
            last = len(t) - int(np.argmax(bucket[::-1] != bucket[-1])) if (bucket != bucket[-1]).any() else 0
            if len(t) - last > TILE:
                through, whole = bucket[-1], t.slice(last)
                yield from whole.to_batches()
            if last:
                yield from kept(t.slice(0, last)).to_batches()
            rest = t.slice(last) if through is None else t.slice(len(t))
        if rest is not None and len(rest):
            yield from kept(rest).to_batches()

    return tables.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(run), tables.schema)


def compare_tiles(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of pictures whose rows of a key agree, among the rows that ``components.tiles`` brings together."""

    def of_part(bucket: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, sig, label, top, seen = (table.column(c).to_numpy() for c in ("side", "sig", "label", "top", "seen"))
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for lo in range(0, len(own), BLOCK):
            o = own[lo : lo + BLOCK]
            ok = agree(seen[o][:, None], seen[other][None, :]) & (label[o][:, None] != label[other][None, :]) & ((sig[o][:, None] < sig[other][None, :]) | top[other][None, :])
            i, j = np.nonzero(ok)
            found += zip(np.minimum(sig[o[i]], sig[other[j]]).tolist(), np.maximum(sig[o[i]], sig[other[j]]).tolist(), strict=True)
        pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return compare_parts(tiles, of_part)


def find_copies(media: DataFrame, media_id: str = "media_id", content: str = "media") -> DataFrame:
    """Rows (media_id, n_corners, component_id): the least id among all images that show the same."""
    whole = materialize(describe(media, media_id, content), "media-described")
    described = materialize(whole.select("media_id", "sig", "n"), "media-rows")
    classes = materialize(whole.where("sig is not null").dropDuplicates(["sig"]).select("sig", "n", "corners"), "media-classes")
    release(whole)
    tables = materialize(agreeing(hamming_tables(classes)), "media-tables")

    def check(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                yield batch.select([0, 1]).filter(pa.array([same_picture(p, q) for p, q in zip(x, y, strict=True)], pa.bool_()))

        left = classes.select(F.col("sig").alias("a"), F.col("corners").alias("x")).join(small(pairs), "a")
        both = left.join(classes.select(F.col("sig").alias("b"), F.col("corners").alias("y")), "b").select("a", "b", "x", "y")
        return materialize(both.mapInArrow(giving_back(run), "a long, b long"), "media-links")

    turn = "abs((seen & 255) - (seen2 & 255))"
    at = "pow((seen >> 16) - (seen2 >> 16), 2) + pow((seen >> 8 & 255) - (seen2 >> 8 & 255), 2)"
    compatible = f"{at} <= {NEAR_PIXELS**2} and least({turn}, {_TURNS} - {turn}) <= {NEAR_TURNS}"
    labels = connect(tables, lambda pairs: pairs, compare_tiles, check, compatible, extra=("seen",))
    release(tables)
    first = described.where("sig is not null").groupBy("sig").agg(F.min("media_id").alias("first"))
    if labels is not None:
        first = first.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        first = first.select("sig", "label").join(first.groupBy("label").agg(F.min("first").alias("first")), "label").select("sig", "first")
    return described.join(first, "sig", "left").select("media_id", F.col("n").cast("long").alias("n_corners"), F.coalesce("first", "media_id").alias("component_id"))
