"""Vectorised hashes of words and word shingles over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_C = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A value for each byte; separators count 0.
_VALUE = np.where(_SPACE, _U(0), mix(_FOLD.astype(np.uint64) + _U(0x1234567)))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * out[have - 1 : have] * p
        have += more
    return out


_tables: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK:
        return _powers(_P, n), _powers(_PINV, n)
    if not _tables:
        _tables["p"], _tables["q"] = _powers(_P, CHUNK), _powers(_PINV, CHUNK)
    return _tables["p"][:n], _tables["q"][:n]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that end at ``ends`` in ``data``, and the number of words up
    to each text's end."""
    space = _SPACE[data]
    start = ~space
    inner = start.copy()
    start[1:] &= space[:-1]
    firsts = np.concatenate(([0], ends[:-1]))
    firsts = firsts[firsts < len(data)]
    start[firsts] = inner[firsts]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    p, q = _power_table(len(data))
    sums = np.add.reduceat(_VALUE[data] * p, at)
    return mix(sums * q[at]), np.searchsorted(at, ends)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray | None]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; with fewer words, of the
    whole sequence as one; empty without words; None for null."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(texts):
        hi = lo + 1
        while hi < len(texts) and offsets[hi + 1] - offsets[lo] <= CHUNK:
            hi += 1
        w, upto = word_hashes(every[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo])
        if len(w) >= k:
            s = w[: len(w) - k + 1] * _C[0]
            for j in range(1, k):
                s = s + w[j : len(w) - k + 1 + j] * _C[j]
            s = mix(s)
        a = 0
        for d, b in enumerate(upto):
            if not valid[lo + d]:
                yield None
            elif b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield mix((w[a:b] * _C[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a))
            else:
                yield np.empty(0, np.uint64)
            a = b
        lo = hi


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes."""
    return int(mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(s))], np.uint64)).view(np.int64)[0])
