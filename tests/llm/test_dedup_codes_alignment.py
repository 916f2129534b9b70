"""Exact duplicates, vector codes and token alignment against brute force, and on awkward tables."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchbench.llm import exact_dedup, token_alignment, vector_codes

WORDS = "the of and water Über naïve 東京 don't x1 1,000 -- ... mañana 🙂🙂 a\tb".split(" ")


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


# --- exact duplicates ------------------------------------------------------------------------------------

COPIES = (
    [(i, "the hot text") for i in range(300)] + [(300 + i, prose(9, i % 7)) for i in range(40)] + [(None, prose(9, 3)), (None, "lone"), (None, None), (400, None), (401, ""), (402, " "), (403, "É"), (404, "é"), (405, "É")]
    + [(500, "again"), (500, "again"), (500, "other"), (None, "nulls"), (None, "nulls"), (600, "long " * 200_000), (601, "long " * 200_000), (-5, "neg"), (-9, "neg"), (2**62, "big"), (-(2**63), "big")]
)


def brute_groups(rows, largest, fold=lambda t: t):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[fold(t or "")].append(i)
    best = {t: (max if largest else min)([x for x in ids if x is not None], default=None) for t, ids in groups.items()}
    return sorted(((i, best[fold(t or "")], len(groups[fold(t or "")]), hashlib.sha256(fold(t or "").encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_groups_equal_brute_force(spark, largest, parts, monkeypatch):
    """40 partitions take two rounds; slices of a few rows meet again in each."""
    monkeypatch.setattr(exact_dedup, "FLUSH", 8)
    docs = spark.createDataFrame(COPIES, "doc_id long, text string").withColumn("run", F.lit(1)).withColumn("digest", F.lit("x")).repartition(parts)
    rows = exact_dedup.resolve(docs, largest=largest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == brute_groups(COPIES, largest)
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in COPIES})
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    once = exact_dedup.deduplicate(docs, largest=largest)
    assert once.columns == docs.columns
    best = {h: k for _, k, _, h in brute_groups(COPIES, largest)}
    got = sorted((hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["doc_id"]) for r in once.collect() if r["doc_id"] is not None)
    assert got == sorted((h, k) for h, k in best.items() if k is not None)
    assert once.where("doc_id is null").count() == 2


def test_normalised_groups_and_rounds(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "a  b"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.resolve(docs, normalise=F.lower).collect())
    assert got == brute_groups(rows, False, str.lower)
    assert exact_dedup.resolve(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0
    assert [exact_dedup.rounds_for(*x) for x in ((1, 0), (16, 5), (17, 5), (257, 5), (1, 1 << 30))] == [1, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        exact_dedup.resolve(docs.withColumn("doc_id", F.lit("a")))


def test_equal_digests_of_different_texts_stay_apart():
    """Entries are one only if lengths and second hashes agree as well."""
    x = np.zeros((3, 11), np.uint64)
    x[:, exact_dedup._COUNT] = x[:, exact_dedup._RUNS] = 1
    x[:, exact_dedup._ID] = [5, 3, 4]
    x[1, exact_dedup._CHECK] = 9
    out, runs = exact_dedup.merge_runs(x, np.array([2, 2, 2], np.int32), False)
    assert out[:, exact_dedup._ID].tolist() == [4, 3] and out[:, exact_dedup._COUNT].tolist() == [2, 1] and runs.tolist() == [2, 2]


# --- vector codes ----------------------------------------------------------------------------------------


def brute_codes(rows, spec):
    kept = sorted((i, [int(np.floor(np.float64(x) * spec.scale)) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v))
    w = len(kept[0][1]) // spec.parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(spec.parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    book = [[cut(v)[p] for _, v, _ in kept[: spec.entries]] for p in range(spec.parts)]
    nearest = lambda: [[min(range(len(book[p])), key=lambda e: (dist(part, book[p][e]), e)) for p, part in enumerate(cut(v))] for _, v, _ in kept]
    for _ in range(spec.rounds):
        at = nearest()
        for p in range(spec.parts):
            for e in range(len(book[p])):
                mine = [cut(v)[p] for (_, v, _), a in zip(kept, at, strict=True) if a[p] == e]
                if mine:
                    book[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = nearest()
    error = [sum(dist(part, book[p][a[p]]) for p, part in enumerate(cut(v))) for (_, v, _), a in zip(kept, at, strict=True)]
    of = collections.Counter()
    for (_, _, lab), e in zip(kept, error, strict=True):
        of[lab] += e
    return [(i, bytes(a).hex(), e, of[lab]) for (i, _, lab), a, e in zip(kept, at, error, strict=True)], book


@pytest.mark.parametrize("scale, coarse", [(256, False), (256, True), (1 << 24, False)])
def test_codes_equal_brute_force(spark, scale, coarse):
    """Coarse vectors make ties; a scale of 2^24 makes components that float32 can't hold."""
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (300, 8)) if not coarse else r.integers(-1, 2, (300, 8)) / 256
    rows = [(1000 - i, x.tolist(), [None, 1, 2, 2][i % 4]) for i, x in enumerate(v)]
    rows += [(1, None, 1), (2, [1.0, None] * 4, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, 1), (5, [], 1), (6, [-1e-9] * 8, None), (7, rows[0][1], 2)]
    spec = vector_codes.Spec(parts=4, entries=16, scale=scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("q", F.lit(1)).withColumn("code", F.lit(1)).repartition(3)
    codes, book = vector_codes.compress(df, spec)
    want, brute = brute_codes(rows, spec)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.collect()) == want
    assert book.tolist() == brute
    assert vector_codes.book_digest(book) == hashlib.sha256(",".join(str(x) for p in brute for e in p for x in e).encode()).hexdigest()
    i, code, error, _ = want[-1]
    own = next(np.floor(np.array(v) * scale) for j, v, _ in rows if j == i)
    assert int(((vector_codes.decode(code, book) - own) ** 2).sum()) == error


def test_screen_never_loses_the_nearest():
    """Parts between two entries, far from the origin, where float32 can't tell the distances apart."""
    r = np.random.default_rng(1)
    for far in (0, 1 << 10, 1 << 20, 1 << 26):
        book = far + r.integers(-3, 4, (2, 40, 4))
        q = far + r.integers(-3, 4, (500, 8))
        numbers, errors = vector_codes.assign(q, book)
        d = ((q.reshape(500, 2, 1, 4) - book[None]) ** 2).sum(3)
        assert (numbers == d.argmin(2)).all() and (errors == d.min(2)).all()
    may = vector_codes.screen(vector_codes._cut(q, 2), book)
    assert may.sum() > 1000  # the bound is wide where float32 is


def test_vectors_that_do_not_fit(spark, monkeypatch):
    kind = "vec_id long, embedding array<float>, label string"
    spec = vector_codes.Spec(parts=2, entries=4)
    codes, book = vector_codes.compress(spark.createDataFrame([(3, [1.0] * 4, "a"), (1, [1.0] * 3, "a"), (2, [1.0] * 6, "b"), (4, [2.0] * 4, "b"), (None, [2.0] * 4, None), (4, [2.0] * 4, "b")], kind), spec)
    assert sorted((r["vec_id"], r["code"]) for r in codes.collect()) == [(2, "0000")] and book.shape == (2, 1, 3)
    codes, book = vector_codes.compress(spark.createDataFrame([(1, None, "a")], kind), spec)
    assert codes.count() == 0 and book is None and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert vector_codes.book_digest(None) == hashlib.sha256(b"").hexdigest()
    rows = [(i, [float(i % 5)] * 4, "hot" if i % 3 else f"l{i}") for i in range(60)] + [(None, [9.0] * 4, None)]
    want = vector_codes.compress(spark.createDataFrame(rows, kind), spec)[0].collect()
    monkeypatch.setattr(vector_codes, "small", lambda df: df)  # too many labels for a broadcast
    monkeypatch.setattr(vector_codes, "HOT", 4)
    assert sorted(map(repr, vector_codes.compress(spark.createDataFrame(rows, kind), spec)[0].collect())) == sorted(map(repr, want)) and len(want) == 61
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, "a")], kind), spec)[0].count()


# --- token alignment -------------------------------------------------------------------------------------

TEXTS = (
    [prose(30, i) for i in range(20)]
    + ["plain words here", "plain words here", " lead", "tail ", "  two  spaces ", " ", "a\nb\n\nc", "x \n y", "tab\t after", "ünïcode ﬁ　　z", "<|endoftext|> </s><s> <0x41> <unk>", "▁marked", "mixed ▁ mark", "\x00zero \x1c odd", "é é", "don't we'll I'M", "=" * 700, "東京都" * 50]
    + ["", None, "no" * 3000, "word nbsp word  em", "12345 67,890.12 3", "\r\n line\r\n", "🙂" * 40, "a " * 500]
)


def brute_alignment(texts, a_file, b_file):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    byte = token_alignment._byte_of_character()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)]
        raw = [[bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], []]
        for i in ids[1]:
            p = b.id_to_piece(i)
            raw[1].append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
        if any(b"".join(r) != (" " + t).encode() for r in raw):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in cuts:
            groups.append([[i for i, e in zip(ids[k], ends[k], strict=True) if last < e <= c] for k in (0, 1)])
            last = c
        docs.append((ids, groups))
    count = collections.Counter()
    for d in docs:
        if d:
            count.update({(x, y) for g in d[1] for x in g[0] for y in g[1]})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in d[1] for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in d[1])
        out.append((len(d[0][0]), len(d[0][1]), len(d[1]), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def files():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held, chunk, remembered", [(10**6, 1 << 22, 10**6), (40, 100, 50), (0, 1 << 22, 10**6)])
def test_alignment_equals_brute_force(spark, files, monkeypatch, held, chunk, remembered):
    """With all pairs broadcast; with a few, texts a few at a time and words forgotten; with all pairs joined."""
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    monkeypatch.setattr(token_alignment, "REMEMBERED", remembered)
    monkeypatch.setattr(token_alignment, "PARTIAL", remembered)
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, pairs string").repartition(3)
    got = sorted(tuple(r[c] for c in ["doc_id", *NUMBERS]) for r in token_alignment.links(docs, *files, held=held).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_alignment(TEXTS, *files))]


def test_alignment_of_awkward_tables(spark, files):
    kind = "doc_id string, text string"
    assert token_alignment.links(spark.createDataFrame([], kind), *files).count() == 0
    rows = [("a", "same text"), ("a", "same text"), (None, "same text"), (None, None)]
    got = sorted((tuple(r[c] for c in ["doc_id", *NUMBERS]) for r in token_alignment.links(spark.createDataFrame(rows, kind), *files).collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute_alignment([t for _, t in rows], *files), strict=True)), key=repr)
    assert [g[6] for g in got if g[1]] == [6, 6, 6]  # two links a document, each held by three documents


def test_words_that_can_not_be_cut(files, monkeypatch):
    """Whole texts give the same as words."""
    pair = token_alignment.Pair(*files)
    assert not pair.whole
    one = token_alignment.Aligner(pair).align(TEXTS)
    monkeypatch.setattr(pair, "whole", True)
    assert token_alignment.Aligner(pair).align(TEXTS) == one


def test_pairs_round_trip():
    k, m = np.array([0, 5, 2**40]), np.array([1, 300, 7])
    assert [x.tolist() for x in token_alignment.unpack_pairs(token_alignment.pack_pairs(k, m))] == [k.tolist(), m.tolist()]
    assert [len(x) for x in token_alignment.unpack_pairs(token_alignment.pack_pairs(k[:0], m[:0]))] == [0, 0]
    assert pa.__version__
