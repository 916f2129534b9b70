"""Aligning the tokens that two tokenizers make of the same texts.

A is a byte-level tokenizer of the tokenizers library, B a SentencePiece model; both see a space and the text.
Byte offsets where a token of each ends cut both sequences into groups, and the tokens of a group are linked:
every A token with every B token. Links tell which ids of one vocabulary stand for which of the other; how many
documents hold a pair of ids linked says how sure that is.

Each task holds a DuckDB database. Token intervals are tables there; a join finds the common ends, window sums
number the groups, ASOF joins with a range condition place B's tokens in them, and joins count links and
pairs. Neither tokenizer makes tokens over a space that follows another character, so words with the white space
before them are aligned once a task and remembered; documents are sums over their words. That holds for the
given vocabularies and is checked for any (``Pair.whole``); otherwise each text is one word. Partial
counts of pairs, a task's distinct ones, are merged in Spark.

Tables: the first pass writes one row a document (numbers, digest and its distinct pairs, compressed) and the
partial counts to the shared folder. Counts of frequent pairs, ``HELD`` at most, are sent to every
executor, where each document's pairs are looked up; the other pairs are each in few documents and join by
shuffle, so no hot key is shuffled.

Memory: a task gathers ``CHUNK`` bytes of texts at a time, or one text that is longer, and forgets rare words when it
holds ``REMEMBERED`` of them.

Edge cases: texts that are null or empty, or that either tokenizer doesn't give back byte by byte (a U+2581 in the
text, say), have no tokens: zeros, and an empty string as digest; special tokens' strings are plain text; a
null id is an id like others; repeated rows count as documents of their own; an empty table gives an empty
result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import giving_back, materialize

#: Bytes of text that are aligned at once, words remembered, and pairs whose counts are broadcast at most (17 bytes each).
CHUNK, REMEMBERED, HELD = 2 << 20, 400_000, 1_500_000
#: Length of words that are remembered for long, and links of a group up to which they are listed one by one.
LONG, FEW = 64, 64
#: Distinct pairs of a task after which partial counts are handed on, and what DuckDB may use.
PARTIAL, DATABASE = 1 << 20, "300MB"
_CUT, _ODD = re.compile(r"(?<=\S) "), re.compile(r"\s ")

#: Groups of new words, whose bytes follow each other: window sums number A's tokens by the common ends before
#: them, and an ASOF join finds the group that ends at or after a token of B and begins before it.
_GROUPS = """
CREATE OR REPLACE TEMP TABLE ga AS
  SELECT a.u, a.id, a.s, a.e, count(b.e) OVER (ORDER BY a.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::INTEGER AS g
  FROM ta a LEFT JOIN tb b ON a.e = b.e;
CREATE OR REPLACE TEMP TABLE span AS SELECT g, min(s) AS s, max(e) AS e, min(u) AS u, count(*) AS n FROM ga GROUP BY g;
CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, b.e, x.g FROM tb b ASOF JOIN span x ON b.e <= x.e WHERE b.s >= x.s;
CREATE OR REPLACE TEMP TABLE sizes AS SELECT g, x.u, x.n AS na, y.n AS nb FROM span x JOIN (SELECT g, count(*) AS n FROM gb GROUP BY g) y USING (g);
INSERT INTO words SELECT u, sum(na::DOUBLE), sum(nb::DOUBLE), count(*), sum(na::DOUBLE * nb) FROM sizes GROUP BY u;
INSERT INTO pairs
  SELECT z.u, a.id::BIGINT * {size} + b.id, 1 FROM sizes z JOIN ga a USING (g) JOIN gb b USING (g) WHERE na * nb <= {few};
INSERT INTO pairs
  SELECT u, a.id::BIGINT * {size} + b.id, a.n * b.n
  FROM (SELECT z.u, g, id, count(*) AS n FROM sizes z JOIN ga USING (g) WHERE na * nb > {few} GROUP BY z.u, g, id) a
  JOIN (SELECT g, id, count(*) AS n FROM sizes z JOIN gb USING (g) WHERE na * nb > {few} GROUP BY g, id) b USING (g)"""
#: A chunk's documents: how often each holds each word, then its sums and its distinct pairs. Document and pair share one
#: key. Sums are doubles, exact up to 2^53.
_DOCUMENTS = """
CREATE OR REPLACE TEMP TABLE held AS SELECT (du >> 32)::INTEGER AS d, (du & 4294967295)::INTEGER AS u, count(*)::DOUBLE AS n FROM occurrences GROUP BY du;
CREATE OR REPLACE TEMP TABLE linked AS SELECT (d::BIGINT << 40) | k AS dk, sum(n * m) AS m FROM held JOIN pairs USING (u) GROUP BY dk;
INSERT INTO partial SELECT dk & 1099511627775 AS k, count(*) FROM linked GROUP BY k"""
_SUMS = "SELECT d, sum(n * na)::BIGINT, sum(n * nb)::BIGINT, sum(n * ng)::BIGINT, sum(n * nl)::BIGINT FROM held JOIN words USING (u) GROUP BY d"


def _byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies use for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, from their files."""

    def __init__(self, a: str, b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.size = self.b.get_piece_size()
        byte = _byte_of_character()
        self.a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes], np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        #: Words can't be taken apart: a piece reaches over a space, or A isn't a plain byte-level tokenizer.
        self.whole = any(re.search("[^▁]▁", p) for p in pieces) or self.a.normalizer is not None or not repr(self.a.pre_tokenizer).startswith("ByteLevel(")
        self.end = self.b.encode("a ")[len(self.b.encode("a")) :]  # what a last space becomes

    def words(self, text: str) -> list[str]:
        """The text cut at spaces behind other characters, those spaces left out."""
        if self.whole:
            return [text]
        return _CUT.split(text) if text[0] == " " or _ODD.search(text) else text.split(" ")

    def _one(self, word: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and the word; None if they don't give the bytes back."""
        a = self.a.encode_batch_fast([" " + word], add_special_tokens=False)[0].ids
        b = self.b.encode(word) if word else self.end
        raw = b" " + word.encode()
        return (a, b) if self._bytes(a, b) == (raw, raw) else None

    def _bytes(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))

    def encode(self, words: list[str]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Ids by A and by B of words, each behind a space, one after the other; the order of those words; and each word's
        number of bytes, 0 for those without tokens, which are left out. Words are encoded many at a time, as one text: cutting it
        into words again is exact."""
        joined = [i for i, w in enumerate(words) if not self.whole and w and not w[-1].isspace()]
        ids: list[tuple[list[int], list[int]]] = []
        size = [0] * len(words)
        order: list[int] = []
        parts = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        texts = [" ".join([words[i] for i in x]) for x in parts]
        both = zip(self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1), strict=True) if texts else []
        alone = [x for x in range(len(words)) if self.whole or not words[x] or words[x][-1].isspace()]
        for part, text, (coded, b) in zip(parts, texts, both, strict=True):
            raw, a = b" " + text.encode(), coded.ids
            if self._bytes(a, b) == (raw, raw):
                ids.append((a, b))
                order += part
                for i in part:
                    size[i] = len(words[i].encode()) + 1
            else:
                alone += part
        for i in alone:
            if got := self._one(words[i]):
                ids.append(got)
                order.append(i)
                size[i] = len(words[i].encode()) + 1
        flat = [[x for p in ids for x in p[k]] for k in (0, 1)]
        return flat[0], flat[1], order, size


def _joined(strings: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    """Strings in runs of the given sizes, each run as one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), strings), mark)


class Aligner:
    """A worker's database and the words it remembers. Tasks of a worker follow each other, and use the same one."""

    _own: dict[tuple[str, str], Aligner] = {}

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls._own:
            cls._own[a, b] = cls(Pair(a, b))
        cls._own[a, b].db.execute("CREATE OR REPLACE TABLE partial(k BIGINT, n BIGINT)")  # of a task that was stopped
        return cls._own[a, b]

    def __init__(self, pair: Pair):
        import duckdb

        self.pair, self.db = pair, duckdb.connect(config={"threads": 1, "memory_limit": DATABASE})
        self.decimal = [pa.array([str(i) for i in range(len(x))]) for x in (pair.a_sizes, pair.b_sizes)]
        self.number: dict[str, int] = {}
        self.texts: list[str | None] = []  # groups of each word as text; None if its bytes don't come back
        self.seen = np.empty(0, np.int64)
        self.db.execute("CREATE TABLE partial(k BIGINT, n BIGINT); CREATE TABLE pairs(u INTEGER, k BIGINT, m BIGINT); CREATE TABLE words(u INTEGER, na DOUBLE, nb DOUBLE, ng DOUBLE, nl DOUBLE)")

    def forget(self) -> None:
        """Keep the words that were met most often, at most half of those that may be remembered and none that was
        met once only or is very long."""
        order = np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2]
        words = list(self.number)
        keep = sorted(i for i in order[self.seen[order] > 1].tolist() if len(words[i]) <= LONG)
        self.db.register("moved", pa.table({"u": pa.array(keep, pa.int32()), "v": pa.array(range(len(keep)), pa.int32())}))
        for t, columns in (("pairs", "k, m"), ("words", "na, nb, ng, nl")):
            self.db.execute(f"CREATE TABLE moved_{t} AS SELECT v AS u, {columns} FROM {t} JOIN moved USING (u); DROP TABLE {t}; ALTER TABLE moved_{t} RENAME TO {t}")
        self.db.unregister("moved")
        self.number = {words[i]: k for k, i in enumerate(keep)}
        self.texts, self.seen = [self.texts[i] for i in keep], self.seen[keep]

    def learn(self, new: list[str]) -> None:
        first = len(self.texts)
        a, b, order, size = self.pair.encode(new)
        ends = np.cumsum(np.array([size[i] for i in order], np.int64))
        at = np.array(order, np.int64)
        for name, ids, sizes in (("ta", a, self.pair.a_sizes), ("tb", b, self.pair.b_sizes)):
            ids = np.array(ids, np.int32)
            e = np.cumsum(sizes[ids])
            u = at[np.searchsorted(ends, e)] + first if len(ids) else np.empty(0, np.int64)
            self.db.register(name, pa.table({"u": u.astype(np.int32), "id": ids, "s": e - sizes[ids], "e": e}))
        self.db.execute(_GROUPS.format(size=self.pair.size, few=FEW))
        sides = []
        for t, decimal in zip(("ga", "gb"), self.decimal, strict=True):
            x = self.db.execute(f"SELECT id, g FROM {t} ORDER BY e").fetchnumpy()
            sides.append(_joined(decimal.take(pa.array(x["id"])), np.bincount(x["g"]), ","))
        u = self.db.execute("SELECT u FROM span ORDER BY g").fetchnumpy()["u"]
        cut = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.empty(0, np.int64)
        said = _joined(pc.binary_join_element_wise(*sides, "|"), np.diff(np.append(cut, len(u))), ";").to_pylist()
        self.texts += [None] * len(new)
        for i, text in zip(u[cut].tolist(), said, strict=True):
            self.texts[i] = text
        self.number.update(zip(new, range(first, first + len(new)), strict=True))
        self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int64)))
        self.db.unregister("ta")
        self.db.unregister("tb")

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs) of each text."""
        if len(self.texts) > REMEMBERED:
            self.forget()
        words = [self.pair.words(t) if t else [] for t in texts]
        new = {w for x in words for w in x}.difference(self.number)
        if new:
            self.learn(sorted(new))
        out: list[tuple] = [(0, 0, 0, 0, "", None)] * len(texts)
        docs, numbers = [], []
        number, said = self.number.__getitem__, self.texts.__getitem__
        for d, x in enumerate(words):
            n = list(map(number, x))
            parts = list(map(said, n))
            if n and None not in parts:
                out[d] = (hashlib.sha256(";".join(parts).encode()).hexdigest(),)
                docs.append((d, len(n)))
                numbers += n
        if not docs:
            return out
        u = np.array(numbers, np.int64)
        self.seen += np.bincount(u, minlength=len(self.seen))
        self.db.register("occurrences", pa.table({"du": np.repeat([d for d, _ in docs], [n for _, n in docs]).astype(np.int64) << 32 | u}))
        self.db.execute(_DOCUMENTS)
        self.db.unregister("occurrences")
        x = self.db.execute("SELECT dk, m FROM linked ORDER BY dk").fetchnumpy()
        dk, m = np.asarray(x["dk"]), np.asarray(x["m"]).astype(np.int64)
        d, k = dk >> 40, dk & ((1 << 40) - 1)
        cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        blobs = {int(d[lo]): pack_pairs(k[lo:hi], m[lo:hi]) for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(d)], strict=True)}
        for i, *sums in self.db.execute(_SUMS).fetchall():
            out[i] = (*sums, out[i][0], blobs[i])
        return out

    def partial(self, least: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The counts of pairs so far, if there are more than ``least`` rows of them; they start anew."""
        if self.db.execute("SELECT count(*) FROM partial").fetchall()[0][0] <= least:
            return None
        x = self.db.execute("SELECT k, sum(n)::BIGINT AS n FROM partial GROUP BY k ORDER BY k").fetchnumpy()
        self.db.execute("CREATE OR REPLACE TABLE partial(k BIGINT, n BIGINT)")
        return np.asarray(x["k"]), np.asarray(x["n"])


def pack_pairs(k: np.ndarray, m: np.ndarray) -> bytes:
    """Ascending pair numbers with how often each is linked, compressed."""
    both = np.empty((2, len(k)), np.int64)
    both[0, :1], both[0, 1:], both[1] = k[:1], k[1:] - k[:-1], m
    planes = both.view(np.uint8).reshape(2, len(k), 8).transpose(0, 2, 1)  # equal bytes of all numbers together
    return len(k).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 16 * n, "zstd", asbytes=True), np.uint8)
    both = [np.ascontiguousarray(x.reshape(8, n).T).view(np.int64).ravel() for x in (raw[: 8 * n], raw[8 * n :])]
    return np.cumsum(both[0]), both[1]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _document_rows(rows: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(4)]
    n = len(found)
    return pa.RecordBatch.from_arrays([*rows.columns[:2], *columns, pa.array([f[4] for f in found]), pa.array([f[5] for f in found], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["row", "doc_id", *_NUMBERS, "groups_sha256", "pairs", "k", "n"])


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (row, doc_id, numbers, groups_sha256, pairs), and rows (k, n) of partial counts, the other
    columns null; written once."""
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, id_type = Aligner.of(a, b), None

        def counts(least: int) -> Iterator[pa.RecordBatch]:
            got = one.partial(least)
            if got is not None:
                k, n = got
                none = [pa.nulls(len(k), t) for t in (pa.int64(), id_type, *[pa.int64()] * 4, pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["row", "doc_id", *_NUMBERS, "groups_sha256", "pairs", "k", "n"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.float64)))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK, "right")))
                part = batch.slice(lo, hi - lo)
                yield _document_rows(part, one.align(part.column(2).to_pylist()))
                yield from counts(PARTIAL)
                lo = hi
        yield from counts(0)

    kinds = f"row long, doc_id {kind}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups_sha256 string, pairs binary, k long, n long"
    return materialize(x.mapInArrow(giving_back(run), kinds), "token-alignment")


def pair_counts(aligned: DataFrame, size: int) -> DataFrame:
    """Rows (k, count, best): in how many documents each pair is linked, and whether no other pair of its A id is in
    more. One A id has as many pairs as B has ids, at most."""
    total = aligned.where("k is not null").groupBy("k").agg(F.sum("n").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.floor(F.col("k") / size)))
    return materialize(total.withColumn("best", F.col("count") == top), "pair-counts")


def links(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", held: int = HELD) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of ``docs``. The counts of
    up to ``held`` pairs are broadcast."""
    size = Pair(a, b).size
    aligned = align(docs, a, b, doc_id, text)
    counts = pair_counts(aligned, size)
    least = 1
    while counts.where(F.col("count") >= least).count() > held:
        least *= 2
    often = counts.where(F.col("count") >= least).toArrow()
    order = np.argsort(often.column("k").to_numpy())
    table = (often.column("k").to_numpy()[order], often.column("count").to_numpy()[order], often.column("best").to_numpy()[order])
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = aligned.where("row is not null").drop("k", "n")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def look_up(blob: bytes) -> tuple:
        keys, count, best = shared.value
        k, m = unpack_pairs(blob)
        at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
        known = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        at = at[known]
        return int((m[known] * best[at]).sum()), int((m[known] * count[at]).sum()), k[~known], m[~known]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [look_up(x)[:2] if x else (0, 0) for x in batch.column("pairs").to_pylist()]
            columns = [pa.array([g[c] for g in got], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", *_NUMBERS, "groups_sha256")), *columns], ["row", "doc_id", *_NUMBERS, "groups_sha256", "n_best", "count_sum"])

    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    out = rows.mapInArrow(giving_back(sums), f"row long, doc_id {kind}, {numbers}, groups_sha256 string, n_best long, count_sum long")
    names = ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return out.select(*names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if x:
                    _, _, k, m = look_up(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row, np.int64)), pa.array(k), pa.array(m)], ["row", "k", "m"])

    rare = rows.select("row", "pairs").mapInArrow(giving_back(others), "row long, k long, m long").join(counts.where(F.col("count") < least), "k")
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("m") * F.col("count")).alias("_sum"))
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.join(rare, "row", "left").select("doc_id", *_NUMBERS, add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256")
