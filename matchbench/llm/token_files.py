"""Token-id output in a byte-aligned variable-length format.

A file holds documents in ascending id order. Token ids are replaced by their rank in the corpus'
frequency order, so that frequent ones take one byte. Four ranks share a control byte (two bits
each: length less one); control bytes and data bytes are stored apart, so numpy decodes a block by
looking up the four lengths of each control byte in a table and gathering bytes.

Layout of ``part-NNNNN.tok`` (little-endian): blocks of [u32 header length, header, control bytes,
data bytes]. The header is JSON: counts of documents and ids, bytes of both parts, document ids (as
JSON values) and their numbers of ids. ``ranks.tok`` holds the token id of each rank as u32.

Texts are tokenised piece by piece: between two non-space characters a single space or newline is
always a border for the byte-level pre-tokeniser, so pieces between such borders have the same ids alone
as in the text; each distinct piece is encoded by the tokenizers library when a worker meets it first, or again
after it was long unused. Texts with any other white space are encoded whole.

Recovery: tokenised rows are a Parquet table in the shared folder. A task writes its file under a
temporary name and renames it, so a repeated task replaces it with the same bytes.

Edge cases: null and empty texts have only the end id; null document ids come first; rows with the
same id are ordered by their ids' bytes; an empty table gives no file and an empty result; further
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release

#: Pieces remembered in a worker, pieces in a call of the library, and ids gathered before a block is written.
REMEMBERED, AT_ONCE, BLOCK_IDS = 800_000, 1 << 13, 1 << 18
#: Bytes of text encoded at once, of ids packed at once, and of text for a file.
TEXT_BYTES, PACK_BYTES, FILE_BYTES = 8 << 20, 8 << 20, 32 << 20
#: Texts that are encoded whole: any white space other than single spaces and newlines between words.
_WHOLE = r"[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Marks that may close a word, and a word that they may close.
_MARKS, _LETTERS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", r"\A ?\pL+\z"


class Encoder:
    """Ids of texts, by the tokenizer in a file. One a worker process, so that tasks share its memory.

    Remembered pieces are two Arrow arrays, of the pieces and of their ids' bytes: Arrow looks up a batch's occurrences in
    the one and takes from the other, so Python meets new pieces only."""

    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        #: Pieces that newlines can't tell apart.
        self.known: dict[str, bytes] = {x: self._encode([x])[0] for x in ("", "\n")}
        self.pieces, self.coded = pa.array(self.known.keys(), pa.large_string()), pa.array(self.known.values(), pa.large_binary())
        #: The latest call that used each piece.
        self.used, self.calls = np.zeros(len(self.pieces), np.int64), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> pa.Array:
        """Many pieces in one call: joined by newlines, which are a token of their own between pieces and
        in none of them. If the newlines can't be told, each piece is encoded by itself."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(ids == self.newline)
        if self.newline is None or len(cut) != len(pieces) - 1:
            return pa.array(self._encode(pieces), pa.large_binary())
        ends = np.append(cut - np.arange(len(cut)), len(ids) - len(cut)) * self.dtype.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(np.delete(ids, cut))])

    def _forget(self) -> None:
        """Keep half of the pieces, those used last."""
        rest = np.argpartition(-self.used[2:], REMEMBERED // 2)[: REMEMBERED // 2] + 2
        keep = np.concatenate(([0, 1], np.sort(rest)))
        self.pieces, self.coded, self.used = self.pieces.take(pa.array(keep)), self.coded.take(pa.array(keep)), self.used[keep]

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Remember pieces; their places. Letters followed by closing marks have a border between them as well, so words and
        marks are encoded apart."""
        stem = pc.ascii_rtrim(new, characters=_MARKS)
        cut = pc.and_(pc.not_equal(stem, new), pc.match_substring_regex(stem, _LETTERS))
        stem, marked, whole = stem.filter(cut), new.filter(cut), new.filter(pc.invert(cut))
        marks = pa.array([x[len(s) :] for x, s in zip(marked.to_pylist(), stem.to_pylist(), strict=True)], pa.large_string())
        ends = pa.concat_arrays([stem, marks]).dictionary_encode()
        asked = pa.concat_arrays([self.pieces, whole])
        at = pc.index_in(ends.dictionary, asked)
        first, asked = len(self.pieces), pa.concat_arrays([asked, ends.dictionary.filter(at.is_null())])
        at = _placed(at, np.arange(len(asked) - at.null_count, len(asked)))[ends.indices.to_numpy()]
        coded = pa.concat_arrays([self.coded, *(self._encode_pieces(asked.slice(k, AT_ONCE).to_pylist()) for k in range(first, len(asked), AT_ONCE))])
        words, closing = (coded.take(pa.array(x)) for x in (at[: len(stem)], at[len(stem) :]))
        self.pieces, self.coded = pa.concat_arrays([asked, marked]), pa.concat_arrays([coded, pc.binary_join_element_wise(words, closing, pa.scalar(b"", pa.large_binary()))])
        self.used = np.concatenate((self.used, np.full(len(self.pieces) - first, self.calls)))
        places = np.empty(len(new), np.int64)
        is_cut = cut.to_numpy(zero_copy_only=False)
        places[~is_cut], places[is_cut] = first + np.arange(len(whole)), len(asked) + np.arange(len(marked))
        return places

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids as little-endian integers of ``dtype``."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if len(self.pieces) - 2 > REMEMBERED:
            self._forget()
        self.calls += 1
        odd = pc.match_substring_regex(texts, _WHOLE)
        whole = iter(self._encode(texts.filter(odd).to_pylist()))
        apart = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", "\0\n\0"), " ", "\0 ")
        pieces = pc.split_pattern(apart, "\0")
        each = pieces.flatten()
        at = pc.index_in(each, self.pieces)
        new = each.filter(at.is_null()).dictionary_encode()
        at = _placed(at, self._learn(new.dictionary)[new.indices.to_numpy()] if len(new) else [])
        self.used[at] = self.calls
        ids = self.coded.take(pa.array(at))
        flat, ends = (np.frombuffer(x, t) for x, t in zip((ids.buffers()[2] or b"", ids.buffers()[1] or bytes(8)), (np.uint8, np.int64), strict=True))
        cut = ends[pieces.offsets.to_numpy()].tolist()
        parts = (flat[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False))
        return [next(whole) if x else next(parts) for x in odd.to_pylist()]


def _placed(at: pa.Array, rest: np.ndarray) -> np.ndarray:
    """Places, with those of ``rest`` where there is none."""
    out = at.fill_null(0).to_numpy().astype(np.int64)
    out[at.is_null().to_numpy(zero_copy_only=False)] = rest
    return out


def part_bounds(docs: DataFrame, doc_id: str, parts: int) -> list:
    """Least ids of up to ``parts`` ranges of about equally many rows."""
    ids = docs.select(F.col(f"`{doc_id}`").alias("d")).where("d is not null")
    rows = ids.repartitionByRange(parts, "d").groupBy(F.spark_partition_id().alias("p")).agg(F.min("d").alias("d")).collect()
    return sorted(r["d"] for r in rows)[1:]


def _packed(rows: list[tuple], id_type: pa.DataType) -> bytes:
    """Rows (doc_id, ids) as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) with texts of so many bytes, or one row."""
    ends, lo = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)))), 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenize(docs: DataFrame, tokenizer: str, end: int, bounds: list, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, blob): documents of one range of ids, with the end id, packed by the hundred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        tail = np.array([end], encoder.dtype).tobytes()
        held: dict[int, list] = {}
        size = 0

        def flush(id_type):
            for part, rows in sorted(held.items()):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(rows, id_type)], pa.binary())], ["part", "blob"])

        for batch in batches:
            kind = batch.column(0).type
            for cut in slices(batch, TEXT_BYTES):
                ids = encoder.encode(pc.fill_null(cut.column(1), ""))
                for d, x in zip(cut.column(0).to_pylist(), ids, strict=True):
                    held.setdefault(0 if d is None else bisect_right(bounds, d), []).append((d, x + tail))
                    size += len(x) + len(tail)
                if size >= PACK_BYTES:
                    yield from flush(kind)
                    held, size = {}, 0
        if held:
            yield from flush(kind)

    x = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return x.mapInArrow(run, "part int, blob binary")


def rank_order(tokens: DataFrame, dtype: np.dtype) -> np.ndarray:
    """Token ids from frequent to rare. Their number is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                n = np.bincount(np.frombuffer(b"".join(_unpacked(blob).column("ids").to_pylist()), dtype))
                if len(n) > len(total):
                    n, total = total, n
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "n"])

    rows = tokens.select("blob").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "token"], ascending=[False, True])["token"].to_numpy(np.uint32)


# --- the format -----------------------------------------------------------------------------------

_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks (u32)."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.ones(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size
    code = (padded - 1).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    every = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), every[np.arange(4) < size[:, None]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start = np.cumsum(size) - size
    d = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    out = d[start]
    for k in range(1, 4):
        longer = size > k
        out[longer] |= d[start[longer] + k] << np.uint32(8 * k)
    return out


def write_blocks(docs: Iterable[tuple[object, bytes]], rank_of: np.ndarray, dtype: np.dtype) -> Iterator[bytes]:
    """Blocks of documents (id, token ids)."""
    held: list[tuple[object, bytes]] = []
    size = 0

    def block() -> bytes:
        control, data = encode_block(rank_of[np.frombuffer(b"".join(x for _, x in held), dtype)])
        head = json.dumps({"docs": len(held), "ids": size, "control": len(control), "data": len(data), "doc_id": [d for d, _ in held], "n": [len(x) // dtype.itemsize for _, x in held]}).encode()
        return struct.pack("<I", len(head)) + head + control + data

    for d, x in docs:
        held.append((d, x))
        size += len(x) // dtype.itemsize
        if size >= BLOCK_IDS:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def read_blocks(file, token_of: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Documents (id, token ids) of an open file."""
    while len(raw := file.read(4)) == 4:
        head = json.loads(file.read(struct.unpack("<I", raw)[0]))
        control, data = file.read(head["control"]), file.read(head["data"])
        ids = token_of[decode_block(control, data, head["ids"])]
        at = 0
        for d, n in zip(head["doc_id"], head["n"], strict=True):
            yield d, ids[at : at + n]
            at += n


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}") if not uri.startswith("file:/") or uri.startswith("file://") else pafs.FileSystem.from_uri("file://" + uri[5:])


def write_files(tokens: DataFrame, uri: str, order: np.ndarray, dtype: np.dtype) -> DataFrame:
    """Write the documents of ``tokens``, a file for each part. Returns (part, file, docs, ids)."""
    spark = tokens.sparkSession
    fs, root = _files(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.tok") as f:
        f.write(order.astype("<u4").tobytes())
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(key, rows):
        import uuid

        part = key[0].as_py()
        every = pa.concat_tables(_unpacked(b) for b in rows.column("blob").to_pylist())
        every = every.take(pc.sort_indices(every, [("doc_id", "ascending"), ("ids", "ascending")], null_placement="at_start"))
        fs, root = _files(uri)
        name = f"part-{part:05d}.tok"
        temporary = f"{root}/{name}.{uuid.uuid4().hex}"
        pairs = (x for b in every.to_batches(max_chunksize=1024) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        with fs.open_output_stream(temporary) as f:
            for block in write_blocks(pairs, shared.value, dtype):
                f.write(block)
        fs.move(temporary, f"{root}/{name}")
        ids = pc.sum(pc.binary_length(every.column("ids"))).as_py() // dtype.itemsize
        return pa.table({"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([len(every)], pa.int64()), "ids": pa.array([ids], pa.int64())})

    return tokens.groupBy("part").applyInArrow(run, "part int, file string, docs long, ids long")


def read_files(spark: SparkSession, uri: str, listing: DataFrame, id_type: str = "long") -> DataFrame:
    """Rows (part, doc_id, at, n_tokens, ids_crc32), ``at`` counted within the file. One task reads
    one file, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(uri)
        token_of = None
        for batch in batches:
            for part, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if token_of is None:
                    with fs.open_input_stream(f"{root}/ranks.tok") as f:
                        token_of = np.frombuffer(f.read(), "<u4")
                with fs.open_input_stream(f"{root}/{name}") as f:
                    at, rows = 0, []
                    for d, ids in read_blocks(f, token_of):
                        rows.append((part, d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        part, d, at, n, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(d), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = max(1, listing.count())
    dealt = listing.select("part", "file").repartition(files, "part")
    return dealt.mapInArrow(run, f"part int, doc_id {id_type}, at long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise and write ``docs``; the listing (part, file, docs, ids), written beside the files."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = part_bounds(docs, "doc_id", max(1, -(-int(size) // file_bytes)))
    tokens = materialize(tokenize(docs, tokenizer, end, bounds), "tokens")
    dtype = Encoder.of(tokenizer).dtype
    listing = materialize(write_files(tokens, uri, rank_order(tokens, dtype), dtype), "token-listing")
    release(tokens)
    return listing


def digest(docs: DataFrame, uri: str, tokenizer: str, end: int) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32. The listing has one row for each file, so its running sum is small."""
    from pyspark.sql import Window

    listing = write_tokens(docs, uri, tokenizer, end)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = listing.select("part", before.alias("before"))
    rows = read_files(docs.sparkSession, uri, listing, docs.schema["doc_id"].dataType.simpleString())
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
