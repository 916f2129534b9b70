"""Queries over the driver's tables, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact_dedup, html_text, media, mixing, ngram_join, pii, sharding, token_alignment, token_files, toxicity, vector_codes
from .common import shared_path, table

#: Production setting of sharding: 64 shards, 1,024 slots for each.
SHARDS, SLOTS = 64, 65537
#: Id after each document.
END_ID = 2


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.count_copies(docs, mixing.MixSpec()).drop("text")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.annotate(docs, table(spark, sf_dir, "benchmark")).drop("text")


#: A conversation whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op4_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKED).alias("text")
    )
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(own)
    return chat.digest(chat.format_turns(turns))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.digest(docs, shared_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def render_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so each row of ``embeddings`` is drawn as one: 16 x 16 fields, 4 pixels wide,
    whose brightness are fixed random projections of the vector. Rows whose id is divisible by 50 have an edited copy as well, cropped on all sides
    and brightened, under the id -1 - vec_id. Copies are what the operator should find."""
    import numpy as np
    import pyarrow as pa

    project = np.random.Generator(np.random.PCG64(1)).normal(0, 1, (256, 64))

    def draw(batches):
        for batch in batches:
            ids, pictures = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.resize(np.nan_to_num(np.array(v or [0.0], np.float32)), 64)
                gray = np.kron(np.clip(128 + 55 * (project @ v), 0, 255).reshape(16, 16), np.ones((4, 4)))
                ids.append(i)
                pictures.append(media.encode(gray))
                if i is not None and i % 50 == 0:
                    ids.append(-1 - i)
                    pictures.append(media.encode(gray[3:62, 5:60] * 0.9 + 12))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pictures, pa.binary())], ["media_id", "media"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(draw, "media_id long, media binary")


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_copies(render_media(spark, sf_dir))


#: Key of the surrogates; in production it comes from a secret store.
PII_KEY = "matchbench-surrogates"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "n_private", F.col("private_text").alias("text"))


def op9_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, SLOTS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.annotate(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(table(spark, sf_dir, "documents").select("doc_id", "text"), largest=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.book_digest(book)).alias("codebooks_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_decontaminate": op3_decontaminate,
        "op4_format_chats": op4_format_chats,
        "op5_token_files": op5_token_files,
        "op6_html_text": op6_html_text,
        "op7_media_copies": op7_media_copies,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_shard_lookup": op9_shard_lookup,
        "op10_toxicity": op10_toxicity,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_vector_codes": op12_vector_codes,
        "op13_token_alignment": op13_token_alignment,
    }


def _mix_sql(spec: mixing.MixSpec, docs: str = "documents") -> str:
    """One bisection step a row of the recursive query; then budgets, a running sum over the whole
    permutation of each source, and the copies."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, md5('{spec.seed}|' || coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS t
  FROM {docs}),
s AS MATERIALIZED (SELECT source, sum(t)::BIGINT AS n FROM d GROUP BY source),
p AS MATERIALIZED (SELECT n / sum(n) OVER ()::DOUBLE AS share FROM s WHERE n > 0),
bisect(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT b.i + 1, CASE WHEN b.good THEN b.lo ELSE b.mid END, CASE WHEN b.good THEN b.mid ELSE b.hi END
  FROM (
    SELECT x.i, x.lo, x.hi, (x.lo + x.hi) / 2 AS mid,
      (SELECT ln(sum(power(share, (x.lo + x.hi) / 2)))
            - (x.lo + x.hi) / 2 * sum(power(share, (x.lo + x.hi) / 2) * ln(share)) / sum(power(share, (x.lo + x.hi) / 2))
            <= {spec.entropy} * ln(count(*)) + 1e-12
            AND power(max(share) / min(share), 1 - (x.lo + x.hi) / 2) <= {spec.max_epochs} FROM p) AS good
    FROM bisect x WHERE x.i < 50) b),
a AS MATERIALIZED (SELECT round(hi, 9) AS alpha FROM bisect WHERE i = 50),
z AS MATERIALIZED (SELECT any_value(alpha) AS alpha, sum(power(share, alpha)) AS z, power(max(share), 1 - any_value(alpha)) AS least FROM p, a),
w AS MATERIALIZED (
  SELECT s.source, s.n, round(round(power(s.n / t.total, z.alpha) / z.z, 9) * (t.total * z.least * z.z))::BIGINT AS budget
  FROM s, z, (SELECT sum(n)::DOUBLE AS total FROM s) t),
e AS MATERIALIZED (
  SELECT source, CASE WHEN n > 0 THEN budget // n ELSE 1 END AS epochs, CASE WHEN n > 0 THEN budget - (budget // n) * n ELSE 0 END AS rest FROM w),
k AS (SELECT source, h, sum(sum(t)) OVER (PARTITION BY source ORDER BY h) - sum(t) AS before FROM d GROUP BY source, h)
SELECT d.doc_id, d.source, (e.epochs + CASE WHEN k.before < e.rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
       JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h"""


#: Shingles as words between single spaces; every pair that shares one is counted; links are followed until no new document is reached.
NEAR_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Each document is matched as a string of words between single spaces, so that a window is found by
#: plain substring search; items of ten words or more are cut into their windows.
DECONTAM_SQL = r"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\#<]')) + length(role) + len(regexp_extract_all(role, '[\\#<:]')) + 14 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


#: The article element of each page, its tags turned into line ends, character references decoded.
HTML_SQL = r'''
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '\s+', ' ', 'g'), '</?(?:p|h1|br|div|li|ul)>', chr(10), 'g') AS body FROM pages),
b AS (SELECT page_id, url, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(line, '<[^>]*>', '', 'g')) AS line FROM b),
d AS (
  SELECT page_id, url, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(line, '&#x27;', chr(39)), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS line FROM c WHERE line <> '')
SELECT p.page_id, p.url, coalesce(string_agg(d.line, chr(10) ORDER BY i), '') AS text, length(coalesce(string_agg(d.line, chr(10) ORDER BY i), ''))::BIGINT AS n_chars
FROM pages p LEFT JOIN d ON p.page_id = d.page_id GROUP BY p.page_id, p.url'''


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def _codes_sql(spec: vector_codes.Spec) -> str:
    """Components as rows; each stage measures every part against every entry of its codebook."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, label, embedding AS x, len(embedding) // {spec.parts} AS w FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding))",
        f"q AS MATERIALIZED (SELECT vec_id, label, (i - 1) // w AS part, (i - 1) % w AS pos, floor({spec.scale} * x[i]::DOUBLE)::BIGINT AS y FROM v, unnest(range(1, len(x) + 1)) AS t(i))",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {spec.entries})",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, y FROM q JOIN first USING (vec_id))",
    ]
    for k in range(spec.rounds + 1):
        ctes.append(f"d{k} AS (SELECT vec_id, part, entry, sum((q.y - c.y) * (q.y - c.y))::BIGINT AS d FROM q JOIN c{k} c USING (part, pos) GROUP BY vec_id, part, entry)")
        ctes.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM d{k} GROUP BY vec_id, part)")
        if k < spec.rounds:
            ctes.append(f"m{k} AS (SELECT part, entry, pos, sum(y)::BIGINT AS s, count(*) AS n FROM q JOIN a{k} USING (vec_id, part) GROUP BY part, entry, pos)")
            ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c.y ELSE (s - ((s % n) + n) % n) // n END AS y FROM c{k} c LEFT JOIN m{k} USING (part, entry, pos))")
    last = spec.rounds
    ctes.append(f"e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY vec_id)")
    ctes.append(f"b AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{last})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), b"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": _mix_sql(mixing.MixSpec()),
        "op2_ngram_jaccard_join": NEAR_SQL,
        "op3_decontaminate": DECONTAM_SQL,
        "op4_format_chats": CHAT_SQL,
        "op6_html_text": HTML_SQL,
        "op11_exact_dedup": EXACT_SQL,
        "op12_vector_codes": _codes_sql(vector_codes.Spec()),
    }
