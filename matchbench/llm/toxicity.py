"""Toxicity by a support vector machine with a subsequence string kernel.

A word's kernel features are its subsequences of three letters within a span of five, begin and end
marks included, weighed ``DECAY`` for each letter skipped; words are normalised. Inserted letters
leave most of these subsequences in place; inserted other characters are removed beforehand, and
runs of single letters ("i d i o t") are read as one word as well. A few hundred landmark words
(Nystroem) span the space in which a support vector machine with squared hinge loss is trained. Its
decision is a weighted sum of kernels with the landmarks, hence linear in the features, and is stored
as one weight for each (hashed) feature: scoring costs a table lookup for each subsequence.

The machine decides on words, not on sentences: a text's decision is the largest of its words', so
sentence bounds don't matter, and a text whose insult is a combination of ordinary words isn't found.
Training has labels of documents only. Candidates are words of toxic documents that are in no clean
one, or in so few (``RATIO``) that chance is ruled out; all other words are clean. Seeds are those with letter sequences found in many toxic and hardly any clean
documents; each round of training chooses anew the words that make toxic documents toxic. A logistic
curve through the training documents' decisions gives scores from 0 to 1.

The training sample is bounded (``Spec``), drawn by a hash of the id; scoring reads every whole text.

Edge cases: null and empty texts, and texts without letters, get the score of a text without toxic
words; if the labels lack one of the two classes the score is constant, the share of toxic rows (0.0
without rows); repeated label rows count once, and the larger label holds; repeated documents get
equal scores; further columns pass through (``annotate``) and may not be called score or predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, giving_back
from .wordhash import CHUNK, mix, word_hashes

DIMS, DECAY = 1 << 16, 0.6
#: Places of the second and third letter after the first, and the letters they skip.
STEPS = tuple((a, b) for b in range(2, 5) for a in range(1, b))
#: Chance at which a letter sequence may be in so many toxic documents without meaning it.
CHANCE = 1e-7
#: How often, at most, what tells toxic documents is in clean ones, as a share of how often it is in toxic ones.
RATIO = 0.1
#: Words whose decisions a task remembers.
REMEMBERED = 1 << 20
_BEGIN, _END = 1, 2


@dataclass(frozen=True)
class Spec:
    """The bounds of the sample of labelled rows (``toxic_docs``, ``clean_docs``), and the machine's
    parameters. ``clean_words`` is where its working set of clean words begins: all others are scored in
    each round, and those near or inside the margin join."""

    toxic_docs: int = 1500
    clean_docs: int = 2500
    clean_words: int = 12_000
    landmarks: int = 256
    rounds: int = 4
    regular: float = 1e-5


@dataclass(frozen=True)
class Model:
    """weights: by feature. The score is 1 / (1 + exp(-(slope * decision + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -500, 500)))


def _letters(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of lower-cased texts as bytes, letters and spaces only, and each text's end."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    keep = np.zeros(256, bool)
    keep[[0x20, *range(0x09, 0x0E), *range(97, 123), *range(128, 256)]] = True
    lo = 0
    while lo < len(texts):
        hi = lo + 1
        while hi < len(texts) and offsets[hi + 1] - offsets[lo] <= CHUNK:
            hi += 1
        part = data[offsets[lo] : offsets[hi]]
        kept = keep[part]
        upto = np.concatenate(([0], np.cumsum(kept)))
        yield part[kept], upto[offsets[lo + 1 : hi + 1] - offsets[lo]]
        lo = hi


def _spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word, in the order of ``word_hashes``."""
    inner = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    first = np.concatenate(([0], ends[:-1]))
    start, last = inner.copy(), inner.copy()
    start[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    f = first[first < len(data)]
    start[f] = inner[f]
    e = ends[(ends > 0) & (ends <= len(data))] - 1
    last[e] = inner[e]
    at = np.flatnonzero(start)
    return at, np.flatnonzero(last) - at + 1


def features(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised features of words (start and length in ``data``): word, feature, weight, by word."""
    total = size + 2
    to = np.concatenate(([0], np.cumsum(total)))
    word = np.repeat(np.arange(len(at)), total)
    inside = np.arange(to[-1]) - to[word]
    b = np.empty(to[-1], np.uint8)
    body = (inside > 0) & (inside < total[word] - 1)
    b[body] = data[(at[word] + inside - 1)[body]]
    b[to[:-1]], b[to[1:] - 1] = _BEGIN, _END
    left = total[word] - inside
    words, feats, weights = [], [], []
    b = b.astype(np.uint64)
    for one, two in STEPS:
        i = np.flatnonzero(left > two)
        code = b[i] | (b[i + one] << np.uint64(8)) | (b[i + two] << np.uint64(16))
        words.append(word[i])
        feats.append((mix(code + np.uint64(77)) >> np.uint64(48)).astype(np.int64))
        weights.append(np.full(len(i), DECAY ** (two - 2)))
    key = np.concatenate(words) * DIMS + np.concatenate(feats)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    weight = np.add.reduceat(weight, first) if len(first) else np.empty(0)
    key = key[first]
    w, f = key // DIMS, key % DIMS
    norm = np.sqrt(np.bincount(w, weight * weight, minlength=len(at)))
    return w, f, weight / np.maximum(norm[w], 1e-12)


def _decide(data: np.ndarray, at: np.ndarray, size: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(at))
    step = max(1, int(60_000 // max(1, size.mean() + 2))) if len(at) else 1
    for i in range(0, len(at), step):
        w, f, x = features(data, at[i : i + step], size[i : i + step])
        out[i : i + step] = np.bincount(w, weights[f] * x, minlength=min(step, len(at) - i)) + bias
    return out


class Scorer:
    """Decisions of texts; remembers those of words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes, self.values = np.empty(0, np.uint64), np.empty(0)

    def _words(self, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        unique, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        value = np.empty(len(unique))
        i = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[i] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        value[known] = self.values[i[known]]
        new = np.flatnonzero(~known)
        if len(new):
            value[new] = _decide(data, at[one[new]], size[one[new]], self.model.weights, self.model.bias)
            if len(self.hashes) + len(new) > REMEMBERED:
                self.hashes, self.values = np.empty(0, np.uint64), np.empty(0)
            h = np.concatenate((self.hashes, unique[new]))
            order = np.argsort(h, kind="stable")
            self.hashes, self.values = h[order], np.concatenate((self.values, value[new]))[order]
        return value[back]

    def decisions(self, texts: pa.Array) -> np.ndarray:
        out = []
        for data, ends in _letters(texts):
            best = np.full(len(ends), -1.0)
            at, size = _spans(data, ends)
            if len(at):
                hashes, upto = word_hashes(data, ends)
                value = self._words(hashes, data, at, size)
                doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], upto))))
                np.maximum.at(best, doc, value)
                for d, v in self._spelled(data, at, size, doc):
                    best[d] = max(best[d], v)
            out.append(best)
        return np.concatenate(out) if out else np.empty(0)

    def _spelled(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, float]]:
        """Runs of three or more single letters, read as words."""
        single = np.concatenate(([False], size == 1, [False]))
        edge = np.flatnonzero(single[1:] != single[:-1])
        runs = [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]
        pieces = []
        for a, b in runs:
            cut = np.flatnonzero(np.diff(doc[a:b])) + a + 1
            pieces += [(x, y) for x, y in zip([a, *cut], [*cut, b], strict=True) if y - x >= 3]
        if pieces:
            joined = np.concatenate([data[at[a:b]] for a, b in pieces])
            n = np.array([b - a for a, b in pieces])
            value = _decide(joined, np.concatenate(([0], np.cumsum(n)[:-1])), n, self.model.weights, self.model.bias)
            yield from zip((int(doc[a]) for a, _ in pieces), value, strict=True)


def _bags(texts: list[str | None], vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """The distinct words of each text, as numbers of a growing vocabulary."""
    out: list[np.ndarray] = []
    for t in texts:
        for data, _ in _letters(pa.array([t], pa.string())):
            out.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in set(data.tobytes().split())], np.int32))
    return out


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64), size


def _kernels(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark (a column of ``landmarks``)."""
    out = np.zeros((len(words), landmarks.shape[1]), np.float32)
    for i in range(0, len(words), 200):
        part = words[i : i + 200]
        w, f, x = features(*_flat(part))
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        out[i + w[first]] = np.add.reduceat(landmarks[f] * x[:, None].astype(np.float32), first)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, regular: float, block: int = 2048) -> tuple[np.ndarray, float]:
    """Squared hinge loss, by Newton steps over the rows inside the margin. Rows are widened block by block."""
    d = x.shape[1] + 1
    penalty = np.diag(np.append(np.full(d - 1, regular), 1e-6))
    beta = np.zeros(d)
    before = None
    for _ in range(30):
        inside = np.concatenate([y[i : i + block] * (x[i : i + block] @ beta[:-1] + beta[-1]) < 1 for i in range(0, len(x), block)])
        if before is not None and (inside == before).all():
            break
        before = inside
        left, right = penalty.copy(), np.zeros(d)
        for i in range(0, len(x), block):
            k = i + np.flatnonzero(inside[i : i + block])
            own = np.hstack((x[k].astype(np.float64), np.ones((len(k), 1))))
            a = own * weight[k, None]
            left += a.T @ own
            right += a.T @ y[k]
        beta = np.linalg.solve(left, right)
    return beta[:-1], float(beta[-1])


def _tail(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` of ``n`` draws, each with chance ``p``."""
    log = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * np.log(p) + (n - i) * np.log1p(-p)
    return float(sum(np.exp(log(i)) for i in range(k + 1)))


def _hash_order(words) -> list[bytes]:
    words = sorted(words)
    data, at, size = _flat(words) if words else (np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
    h = [int(mix(np.array([np.frombuffer(data[a : a + n], np.uint8).astype(np.uint64) @ np.arange(1, n + 1, dtype=np.uint64) + np.uint64(n)], np.uint64))[0]) for a, n in zip(at, size, strict=True)]
    return [w for _, w in sorted(zip(h, words, strict=True))]


def _sequences(word: bytes, n: int = 4) -> set[bytes]:
    word = b"\1" + word + b"\2"
    return {word[i : i + n] for i in range(max(1, len(word) - n + 1))}


class _Grams:
    """The letter sequences of all words of a vocabulary, as numbers."""

    def __init__(self, words: list[bytes]):
        number: dict[bytes, int] = {}
        rows = [np.array([number.setdefault(q, len(number)) for q in sorted(_sequences(w))], np.int32) for w in words]
        self.size = np.array([len(r) for r in rows])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(rows)
        self.count = len(number)

    def documents(self, bags: list[np.ndarray]) -> np.ndarray:
        """In how many bags each sequence occurs."""
        out = np.zeros(self.count, np.int64)
        for b in bags:
            n = self.size[b]
            at = np.repeat(self.first[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[np.unique(self.flat[at])] += 1
        return out


def train(toxic: list[str | None], clean: list[str | None], spec: Spec = Spec()) -> Model:
    """Fit on the texts of toxic and clean documents."""
    vocabulary: dict[bytes, int] = {}
    bags, others = _bags(toxic, vocabulary), _bags(clean, vocabulary)
    words = list(vocabulary)
    share = len(toxic) / max(1, len(toxic) + len(clean))
    flat = Model(np.zeros(DIMS), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (500.0 if share else -500.0))
    none = [np.empty(0, np.int32)]
    often, in_clean_docs = (np.bincount(np.concatenate(x + none), minlength=len(words)) for x in (bags, others))
    doubtful = (often > 0) & (in_clean_docs == 0)
    # Quoted or mislabelled words are in clean documents too: a ratio decides, unless chance may explain it.
    for i in np.flatnonzero((often > 0) & (in_clean_docs > 0) & (in_clean_docs * len(bags) <= RATIO * often * len(others))):
        doubtful[i] = _tail(int(in_clean_docs[i]), int(often[i] + in_clean_docs[i]), len(others) / (len(bags) + len(others))) < CHANCE
    if not doubtful.any() or not in_clean_docs.any():
        return flat
    bags = [b[doubtful[b]] for b in bags]
    give_back()
    grams = _Grams(words)
    in_toxic, in_clean = grams.documents(bags), grams.documents(others)
    # Sequences so much more frequent in toxic documents that chance is ruled out; else the best there are.
    chance = np.log(len(bags) / (len(bags) + len(others)))
    told = (in_toxic * chance < np.log(CHANCE)) & (in_clean / len(others) <= RATIO * in_toxic / len(bags))
    if not told.any():
        only = np.where(in_clean == 0, in_toxic, 0)
        told = (only >= max(2, 0.7 * only.max())) & (only > 0)
    chosen = doubtful & np.logical_or.reduceat(told[grams.flat], grams.first)
    chosen = chosen if chosen.any() else doubtful
    del grams, others, in_toxic, in_clean, told, vocabulary
    rest = _hash_order(w for w, n, d in zip(words, in_clean_docs, doubtful, strict=True) if n and not d)
    negative, rest = rest[: spec.clean_words], sorted(rest[spec.clean_words :])
    marks = [words[i] for i in sorted(np.flatnonzero(chosen), key=lambda i: (-often[i], words[i]))][: spec.landmarks // 2]
    marks += negative[: spec.landmarks - len(marks)]
    give_back()
    w, f, x = features(*_flat(marks))
    z = np.zeros((DIMS, len(marks)), np.float32)
    z[f, w] = x
    k = _kernels(marks, z).astype(np.float64)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    row_of = np.cumsum(doubtful) - 1
    xd = _kernels([words[i] for i in np.flatnonzero(doubtful)], z) @ root.astype(np.float32)
    xn = _kernels(negative, z) @ root.astype(np.float32)
    for turn in range(spec.rounds):
        pos = np.flatnonzero(chosen)
        y = np.concatenate((np.ones(len(pos)), -np.ones(len(xn))))
        weight = np.concatenate((often[pos] / often[pos].sum(), np.full(len(xn), 1 / len(xn))))
        beta, bias = _machine(np.vstack((xd[row_of[pos]], xn)), y, weight, spec.regular)
        decision = np.full(len(words), -np.inf)
        decision[doubtful] = xd @ beta + bias
        if turn < spec.rounds - 1:
            # Clean words that look toxic join the clean ones; toxic documents without a chosen word name their likeliest.
            near = _decide(*_flat(rest), (z @ (root @ beta).astype(np.float32)).astype(np.float64), bias) if rest else np.empty(0)
            hard = [w for _, w in sorted((-v, w) for v, w in zip(near, rest, strict=True) if v > -0.8)]
            if hard:
                xn = np.vstack((xn, _kernels(hard, z) @ root.astype(np.float32)))
                rest = sorted(set(rest) - set(hard))
            kept = chosen & (decision > 0)
            for b in bags:
                if len(b) and not chosen[b].any():
                    best = max(b, key=lambda i: (decision[i], words[i]))
                    if decision[best] > 0.5:
                        kept[best] = True
            chosen = kept if kept.any() else chosen
    weights = (z @ (root @ beta).astype(np.float32)).astype(np.float64)
    scorer = Scorer(Model(weights, bias, 1.0, 0.0))
    d = np.concatenate([scorer.decisions(pa.array([t], pa.string())) for t in (*toxic, *clean)])
    return Model(weights, bias, *_curve(d, len(toxic)))


def _curve(d: np.ndarray, positives: int) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets drawn in as usual for such fits."""
    n = len(d) - positives
    t = np.concatenate((np.full(positives, (positives + 1) / (positives + 2)), np.full(n, 1 / (n + 2))))
    x = np.column_stack((d, np.ones(len(d))))
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t))
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, spec: Spec = Spec()) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fifth, in one task; only the
    model reaches the driver."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order, "doc_id").limit(spec.toxic_docs).union(known.where("toxic <> 1").orderBy(order, "doc_id").limit(spec.clean_docs))
    texts = docs.select("doc_id", "text").where("text is not null")
    rows = texts.join(F.broadcast(sample), "doc_id").select((F.col("toxic") == 1).alias("toxic"), "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((t, x) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        m = train([x for t, x in held if t], [x for t, x in held if not t], spec)
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *[pa.array([float(v)]) for v in (m.bias, m.slope, m.shift)]], ["weights", "bias", "slope", "shift"])

    found = rows.repartition(1).mapInArrow(giving_back(run), "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(found["weights"]), found["bias"], found["slope"], found["shift"]) if found else train([], [], spec)


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (double) and predicted (int)."""
    if clash := {"score", "predicted"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            p = shared.value.probability(scorer.decisions(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema.fields]).add("score", T.DoubleType()).add("predicted", T.IntegerType()))
