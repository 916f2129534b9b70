"""Benchmark decontamination by winnowing.

Texts become words (A-Z lower-cased, anything but ASCII letters, digits and non-ASCII characters
separates). A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if it has
fewer. Of every run of ``WINDOW - K + 1`` consecutive K-gram hashes the least is kept as a
fingerprint, in documents and items alike. Any shared run of ``WINDOW`` words holds the same K-gram
hashes in both texts, hence the same least one, so each occurrence of a window shares a fingerprint:
joining fingerprints misses nothing. Only documents with a shared fingerprint are read again; there
each shared K-gram is extended to both sides word by word, which decides exactly.

Items of fewer than ``WINDOW`` words are found by hashes of their whole length (winnowing with a run
of one).

Texts are cut into overlapping blocks of 512 words, so that work per block is bounded and that of a
text grows with its length. Within a block, places with equal words around them are extended once, and
an item's places likewise, so texts of few different words cost no more than others.

Scale: a document's fingerprints never leave its row unless they join; the item side is broadcast by
the planner when small and shuffled otherwise. Copies of one text share their hits by the text's
digest, so a large group of copies costs one small row, and the join back is on that digest, split by
skew handling. Nothing is collected.

Edge cases: null and empty texts have no words and are clean; an item without words is ignored;
repeated item or document rows don't change counts; if there are no items all documents are clean;
further columns pass through (``annotate``), with new ones that may not clash (``ValueError``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, small

WINDOW, K = 10, 5
#: Words of a block; blocks overlap by two windows, so each occurrence of a window is whole in one of them.
BLOCK, OVERLAP = 512, 2 * WINDOW
#: What stands between words: splitting there takes a seventh of the time of extracting the words.
BETWEEN = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEW = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words(text: str) -> str:
    return f"coalesce(array_remove(split({text}, '{BETWEEN}', -1), ''), cast(array() as array<string>))"


def exact_words(text: str) -> str:
    return _words(f"translate({text}, '{UPPER}', '{LOWER}')")


def _grams(words: str, k: int) -> str:
    terms = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({k}, {terms})), cast(array() as array<bigint>))"


def _minima(grams: str, run: int) -> str:
    """The least hash of each run of ``run`` hashes."""
    if run == 1:
        return grams
    terms = ", ".join(f"{grams}[j + {i}]" for i in range(run))
    return f"if(size({grams}) >= {run}, transform(sequence(0, size({grams}) - {run}), j -> least({terms})), cast(array() as array<bigint>))"


class Family:
    """Items found by the same K-grams: k, the run, and the words to compare before and after."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.run = length, k, length - k + 1
        self.left = self.run - 1

    def with_grams(self, df: DataFrame, words: str) -> DataFrame:
        return df.withColumn(f"_g{self.length}", F.expr(_grams(words, self.k)))

    def fingerprints(self) -> str:
        return f"array_distinct({_minima(f'_g{self.length}', self.run)})"

    def context(self, words: str, at: str) -> str:
        """The words around a K-gram at ``at`` that windows with it can hold, and the K-gram's place among them."""
        return f"named_struct('w', slice({words}, greatest({at} - {self.left}, 0) + 1, {self.length} + least({at}, {self.left})), 'o', least({at}, {self.left}))"

    def starts(self, own: str, item: str) -> str:
        """Starts, relative to a shared K-gram, of the windows around it that agree word for word."""
        n = self.length
        return (
            f"filter(sequence(-{self.left}, 0), s -> s + {own}.o >= 0 and s + {item}.o >= 0 and s + {own}.o + {n} <= size({own}.w) and s + {item}.o + {n} <= size({item}.w) "
            f"and slice({own}.w, s + {own}.o + 1, {n}) = slice({item}.w, s + {item}.o + 1, {n}))"
        )


def _families(items: DataFrame) -> list[Family]:
    """The long items' family, and one for each length under WINDOW that occurs (at most 9)."""
    found = items.select(F.least(F.size("iw"), F.lit(WINDOW)).alias("n")).distinct().collect()
    return [Family(n, K if n == WINDOW else n) for n in sorted(r["n"] for r in found) if n > 0]


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each distinct text with a hit: th (its md5), spans (array of start and len, in
    words) and items (array of item ids as strings)."""
    items = materialize(items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.expr(exact_words(f"`{item_text}`")).alias("iw")), "decontam-items")
    families = _families(items)
    own = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumn("th", F.md5("text"))
    if not families:
        return own.select("th", F.expr("cast(array() as array<struct<start:int,len:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")).limit(0)
    # Item side: every K-gram that is a fingerprint, once for each of its contexts.
    sides = []
    for f in families:
        x = items.where(F.least(F.size("iw"), F.lit(WINDOW)) == f.length)
        x = f.with_grams(x, "iw").withColumn("_fp", F.expr(f.fingerprints()))
        x = x.select("item", "iw", F.posexplode(f"_g{f.length}").alias("q", "fp"), "_fp").where("array_contains(_fp, fp)")
        sides.append(x.select(F.lit(f.length).alias("family"), "fp", "item", F.expr(f.context("iw", "q")).alias("theirs")))
    side = sides[0]
    for x in sides[1:]:
        side = side.unionByName(x)
    side = materialize(side.distinct(), "decontam-fingerprints")
    # Document side: values only.
    x = _blocks(own)
    for f in families:
        x = f.with_grams(x, "w")
    x = x.select("th", "b", F.explode(F.expr(f"concat({', '.join(f.fingerprints() for f in families)})")).alias("fp"))
    shared = x.join(side.select("fp").distinct(), "fp").groupBy("th", "b").agg(F.collect_set("fp").alias("mv"))
    shared = materialize(shared, "decontam-shared")
    # Extension of the shared K-grams, in the blocks that have any. Places with equal words around them are extended as one.
    texts = own.join(small(shared.select("th").distinct()), "th", "left_semi").dropDuplicates(["th"])
    x = _blocks(texts).join(small(shared), ["th", "b"])
    hits = []
    for f in families:
        g = f"_g{f.length}"
        y = f.with_grams(x, "w")
        places = f"filter(sequence(0, size({g}) - 1), i -> array_contains(mv, {g}[i]))"
        y = y.select("th", "b", F.expr(f"if(size({g}) > 0, transform({places}, i -> named_struct('p', i, 'fp', {g}[i], 'own', {f.context('w', 'i')})), null)").alias("at"))
        y = y.select("th", "b", "at", F.explode(F.expr("array_distinct(transform(at, x -> struct(x.fp as fp, x.own as own)))")).alias("d"))
        y = y.select("th", "b", "d.fp", "d.own", F.expr("transform(filter(at, x -> x.fp = d.fp and x.own = d.own), x -> x.p)").alias("ps"))
        y = y.join(side.where(F.col("family") == f.length).drop("family"), "fp")
        y = y.select("th", "b", "item", "ps", F.explode(F.expr(f.starts("own", "theirs"))).alias("s")).groupBy("th", "b", "ps", "s").agg(F.collect_set("item").alias("items"))
        y = y.select("th", "items", F.expr(f"transform(ps, p -> cast(b * {BLOCK} + p + s as bigint) * 16 + {f.length})").alias("spans"))
        hits.append(y)
    found = hits[0]
    for y in hits[1:]:
        found = found.unionByName(y)
    # Spans as numbers: distinct arrays of structs aren't found by hashing.
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    spans = F.transform(flat("spans"), lambda x: F.struct(F.shiftright(x, 4).cast("int").alias("start"), (x % 16).cast("int").alias("len")))
    return found.groupBy("th").agg(spans.alias("spans"), flat("items").alias("items"))


def _blocks(own: DataFrame) -> DataFrame:
    """Rows (th, b, w): the words of each text in overlapping blocks, each a text of its own to what follows."""
    x = own.select("th", F.expr(exact_words("text")).alias("all"))  # no filter on it: it would be pushed down and the words cut twice
    cut = f"if(size(all) <= {BLOCK}, array(all), transform(sequence(0, (size(all) - 1) div {BLOCK}), b -> slice(all, cast(b * {BLOCK} + 1 as int), {BLOCK + OVERLAP})))"
    return x.select("th", F.posexplode(F.expr(cut)).alias("b", "w"))


def covered(spans: str) -> str:
    """Words in the union of spans."""
    return (
        f"aggregate(array_sort({spans}), named_struct('e', 0, 'n', 0L), (a, s) -> named_struct("
        "'e', greatest(a.e, s.start + s.len), 'n', a.n + greatest(0, s.start + s.len - greatest(a.e, s.start))), a -> a.n)"
    )


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """``docs`` with the columns of ``NEW``."""
    if clash := set(NEW) & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    th, h, n, ids = fresh(docs, "th", "n_hit", "n_items", "ids")
    hits = find_hits(docs, items, text, **names).select(
        F.col("th").alias(th), F.expr(covered("spans")).alias(h), F.size("items").cast("long").alias(n),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias(ids),
    )
    hits = materialize(hits, "decontam-hits")
    t = F.col(f"`{text}`")
    n_words = F.size(F.expr(_words(f"`{text}`"))).cast("long")
    out = docs.withColumn("n_words", n_words).withColumn(th, F.md5(t)).join(small(hits), th, "left")
    out = out.withColumn("n_hit", F.coalesce(h, F.lit(0)).cast("long")).withColumn("n_items", F.coalesce(n, F.lit(0)).cast("long"))
    out = out.withColumn("items_sha256", F.coalesce(ids, F.sha2(F.lit(""), 256))).withColumn("contaminated", F.col("n_hit") > 0)
    return out.select(*[f"`{c}`" for c in docs.columns], *NEW)


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` without a hit."""
    hits = materialize(find_hits(docs, items, text, **names).select("th"), "decontam-hits")
    (th,) = fresh(docs, "th")
    return docs.withColumn(th, F.md5(F.col(f"`{text}`"))).join(small(hits.withColumnRenamed("th", th)), th, "left_anti").drop(th)
