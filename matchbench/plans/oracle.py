"""DuckDB SQL for the queries of ``queries.py``, written on its own from the operators' definitions."""

from ..operators.numbering import PRIME, permutation_steps
from .oracle_kernels import KERNELS, deviate

ORACLE: dict[str, str] = {}

#: Captures, gallery, probes.
_C = """
c AS (SELECT vec_id AS sample_id, 'S' || lpad((label + 1)::VARCHAR, 3, '0') AS subject_id,
      CASE vec_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 15.0::DOUBLE ELSE -15.0::DOUBLE END AS pose_yaw,
      CASE vec_id % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'strong' WHEN 2 THEN 'dark' ELSE 'side' END AS illumination,
      embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT subject_id, min(sample_id) AS sample_id, arg_min(v, sample_id) AS v FROM c WHERE pose_yaw = 0 AND illumination = 'normal' GROUP BY subject_id),
p AS (SELECT * FROM c WHERE sample_id NOT IN (SELECT sample_id FROM g))"""


def _cos(a: str, b: str) -> str:
    n = lambda x: f"(sqrt(list_sum(list_transform({x}, lambda e: e * e))) + 1e-12)"
    return f"round(list_sum(list_transform(list_zip({a}, {b}), lambda e: e[1] * e[2])) / ({n(a)} * {n(b)}), 9)"


_S = f"s AS MATERIALIZED (SELECT p.sample_id AS probe_id, g.sample_id AS gallery_id, p.subject_id AS truth, g.subject_id AS guess, {_cos('p.v', 'g.v')} AS score FROM p, g)"
_R = "r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, gallery_id) AS rank FROM s)"
_D = "d AS MATERIALIZED (SELECT probe_id, truth, arg_min(guess, rank) AS predicted, min(rank) FILTER (guess = truth) AS true_rank FROM r GROUP BY probe_id, truth)"
_ID = f"WITH {_C}, {_S}, {_R}, {_D}"
_V = f"""
v AS MATERIALIZED (SELECT sample_id, subject_id, v FROM c),
sc AS MATERIALIZED (SELECT a.sample_id AS a, b.sample_id AS b, {_cos('a.v', 'b.v')} AS score, (a.subject_id = b.subject_id)::INT AS y FROM v a JOIN v b ON a.sample_id < b.sample_id)"""
_PAIRS = f"WITH {_C}, {_V}"
_TIES = "WITH sc AS MATERIALIZED (SELECT doc_id, n_chars::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id))"
_RUN = """
k AS MATERIALIZED (SELECT score, sum(y)::DOUBLE AS t, sum(1 - y)::DOUBLE AS f FROM sc GROUP BY score),
run AS MATERIALIZED (SELECT *, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM k WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT sum(y)::DOUBLE AS P, sum(1 - y)::DOUBLE AS N FROM sc)"""
_ROC = f"""{_RUN},
near AS (SELECT *, lead(tp) OVER w AS tp2, lag(tp) OVER w AS tp0, lead(fp) OVER w AS fp2, lag(fp) OVER w AS fp0 FROM run WINDOW w AS (ORDER BY score DESC)),
roc AS MATERIALIZED (
  SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
  UNION ALL SELECT score, fp / N, tp / P FROM near, tot WHERE tp2 IS NULL OR tp0 IS NULL OR tp2 - 2 * tp + tp0 <> 0 OR fp2 - 2 * fp + fp0 <> 0)"""
_EER = f"""{_ROC},
o AS (SELECT *, fpr - (1 - tpr) AS d, lead(threshold) OVER w AS thr2, lead(fpr) OVER w AS fpr2, lead(fpr - (1 - tpr)) OVER w AS d2 FROM roc WINDOW w AS (ORDER BY fpr, tpr)),
x AS (SELECT * FROM o WHERE d < 0 AND d2 >= 0 ORDER BY fpr, tpr LIMIT 1)
SELECT round(fpr + d / (d - d2) * (fpr2 - fpr), 6) AS eer,
       round(CASE WHEN threshold IS NULL THEN ((SELECT max(score) FROM sc WHERE y = 0) + (SELECT min(score) FROM sc WHERE y = 1)) / 2 ELSE threshold + d / (d - d2) * (thr2 - threshold) END, 6) AS eer_threshold FROM x"""
_G = "px AS MATERIALIZED (SELECT vec_id AS sample_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS z FROM embeddings, range(1, 65) t(i))"


def _d(z: str, along: str) -> str:
    w = f"(PARTITION BY sample_id, {'y' if along == 'x' else 'x'} ORDER BY {along})"
    return f"CASE WHEN lag({z}) OVER {w} IS NULL THEN lead({z}) OVER {w} - {z} WHEN lead({z}) OVER {w} IS NULL THEN {z} - lag({z}) OVER {w} ELSE (lead({z}) OVER {w} - lag({z}) OVER {w}) / 2 END"


_GRAD = f"WITH {_G}, gr AS MATERIALIZED (SELECT *, {_d('z', 'x')} AS zx, {_d('z', 'y')} AS zy FROM px)"

ORACLE["manifest_project"] = f"""WITH {_C} SELECT 'toy' AS dataset, subject_id, sample_id::VARCHAR AS sample_id, CASE WHEN sample_id % 5 <> 0 THEN 'img/' || sample_id || '.png' END AS path_2d,
 pose_yaw, illumination, CASE WHEN sample_id % 7 <> 0 THEN 64 END::INT AS orig_w, sample_id % 5 <> 0 AS has_2d, false AS has_3d, false AS detect_ok, '' AS quality_flag, 'synthetic_toy' AS data_modality FROM c"""
ORACLE["manifest_validate"] = f"""WITH {_C} SELECT * FROM (
 SELECT 'blank_sample_id' AS rule, count(*) FILTER (sample_id % 50 = 1) AS n FROM c
 UNION ALL SELECT 'subject_id', count(*) FILTER (sample_id % 60 = 2) FROM c
 UNION ALL SELECT 'illumination', count(*) FILTER (sample_id % 70 = 3) FROM c
 UNION ALL SELECT 'data_modality', count(*) FILTER (sample_id % 80 = 5) FROM c
 UNION ALL SELECT 'numeric_pose_yaw', count(*) FILTER (sample_id % 90 = 6) FROM c
 UNION ALL SELECT 'numeric_orig_w', 0)"""
ORACLE["manifest_audit"] = f"""WITH {_C}, b AS (SELECT subject_id, count(*) AS n, count(*) FILTER (sample_id % 5 = 0) AS no2, count(*) FILTER (sample_id % 3 = 0) AS no3 FROM c GROUP BY 1)
 SELECT sum(n)::BIGINT AS n_samples, count(*) AS n_subjects, min(n) AS min_per_subject, max(n) AS max_per_subject, sum(no2)::BIGINT AS missing_2d, sum(no3)::BIGINT AS missing_3d, min(n) >= 2 AS has_genuine_pairs FROM b"""
ORACLE["audit_pivot"] = f"""WITH {_C} SELECT pose_yaw, {', '.join(f"count(*) FILTER (illumination = '{x}') AS {x}" for x in ('normal', 'strong', 'dark', 'side'))} FROM c GROUP BY 1"""
ORACLE["id_regex_extract"] = r"""SELECT page_id, regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([a-z-]+)\.', 1) AS host, try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number FROM pages"""
ORACLE["condition_label"] = f"""WITH {_C} SELECT sample_id, 'yaw' || CASE WHEN pose_yaw >= 0 THEN '+' ELSE '' END || pose_yaw::BIGINT || '_' || illumination AS condition FROM c"""
ORACLE["anonymize_subject"] = """SELECT c_custkey, 'S' || array_to_string(list_transform(range(1, 9), lambda i: ((strpos('0123456789abcdef', sha256(c_name)[i]) - 1) % 10)::VARCHAR), '') AS subject_id FROM customer"""
ORACLE["duplicate_content"] = "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"
ORACLE["quality_flags"] = f"""WITH {_C}, q AS (SELECT sample_id, sample_id % 5 <> 0 AS has_2d, sample_id % 3 <> 0 AS has_3d, sample_id % 7 <> 0 AS d, sample_id % 11 <> 0 AS n FROM c)
 SELECT sample_id, CASE WHEN d THEN '' ELSE 'rejected' END AS flag_2d, CASE WHEN n THEN '' ELSE 'rejected' END AS flag_3d,
 CASE WHEN (NOT has_2d OR d) AND (NOT has_3d OR n) THEN '' ELSE 'rejected' END AS flag_both FROM q"""
ORACLE["cache_antijoin"] = "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0"
ORACLE["mesh_photo_join"] = """WITH ph AS (SELECT c_custkey AS participant, c_name AS photo FROM customer WHERE c_custkey % 3 <> 0)
 SELECT o_custkey AS participant, o_orderkey::VARCHAR AS capture, '3d' AS kind, photo IS NOT NULL AS paired FROM orders LEFT JOIN ph ON o_custkey = participant
 UNION ALL SELECT participant, photo, '2d', true FROM ph"""
ORACLE["gallery_select"] = f"WITH {_C} SELECT subject_id, sample_id FROM g"
ORACLE["gallery_fallback"] = r"""WITH e AS (SELECT user_id::VARCHAR AS subject_id, event_id AS sample_id, 'yale:' || CASE WHEN event_id % 4 = 0 THEN 'A+010E+05' ELSE (event_id * 7 % 64)::VARCHAR END AS illumination FROM events)
 SELECT subject_id, sample_id, illumination FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY try_cast(regexp_extract(illumination, '^yale:(-?\d+)$', 1) AS BIGINT) NULLS LAST, sample_id) AS r FROM e) WHERE r = 1"""
ORACLE["split_p1"] = f"WITH {_C} SELECT sample_id, subject_id, CASE WHEN sample_id IN (SELECT sample_id FROM g) THEN 'gallery' ELSE 'probe' END AS role FROM c"
ORACLE["split_p2"] = f"""WITH {_C}, u AS (SELECT DISTINCT subject_id FROM c), o AS (SELECT subject_id, row_number() OVER (ORDER BY md5('0|' || subject_id), subject_id) AS r, count(*) OVER () AS n FROM u)
 SELECT subject_id, CASE WHEN r <= greatest(1, floor(0.4 * n)) THEN 'background' ELSE 'evaluation' END AS part FROM o"""
ORACLE["pairs_genuine"] = f"WITH {_C} SELECT a.sample_id AS a, b.sample_id AS b FROM c a JOIN c b USING (subject_id) WHERE a.sample_id < b.sample_id"


def _impostor_sql(ratio: int, seed: int = 0) -> str:
    """Numbers of pairs by window sums; the permutation one round a subquery; numbers that are none are passed over."""
    v = "SELECT i, i AS v0, e.* FROM e, range(0, least(a * b, least(n, want) + a * b - n)) r(i)"
    for turn, c in enumerate(permutation_steps(2, seed)[2]):
        side = f"v{turn} % b" if turn % 2 == 0 else f"v{turn} // b"
        poly = f"{c[0]}::BIGINT"
        for x in c[1:]:
            poly = f"(({poly} * (({side}) % {PRIME}) + {x}) % {PRIME})"
        new = f"((v{turn} // b + {poly}) % a) * b + v{turn} % b" if turn % 2 == 0 else f"(v{turn} // b) * b + (v{turn} % b + {poly}) % b"
        v = f"SELECT i, {new} AS v{turn + 1}, n, want, a, b FROM ({v})"
    last = f"v{len(permutation_steps(2, seed)[2])}"
    return f"""WITH {_C}, o AS (SELECT sample_id, subject_id, row_number() OVER (ORDER BY subject_id, sample_id) - 1 AS j FROM c),
 s AS (SELECT subject_id, min(j) AS s, count(*) AS c FROM o GROUP BY subject_id), f AS (SELECT s, s * c AS pairs, (sum(s * c) OVER (ORDER BY s) - s * c)::BIGINT AS first FROM s),
 t AS (SELECT sum(s * c)::BIGINT AS n, ({ratio} * sum(c * (c - 1) // 2))::BIGINT AS want FROM s), d AS (SELECT n, want, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM t), e AS MATERIALIZED (SELECT n, want, a, (n + a - 1) // a AS b FROM d),
 x AS (SELECT {last} AS v, row_number() OVER (ORDER BY i) AS r, want FROM ({v}) WHERE {last} < n), q AS (SELECT (v - first) % s AS i, s + (v - first) // s AS j FROM x JOIN f ON v >= first AND v < first + pairs WHERE r <= want)
 SELECT least(y.sample_id, z.sample_id) AS a, greatest(y.sample_id, z.sample_id) AS b FROM q JOIN o y ON y.j = q.i JOIN o z ON z.j = q.j"""


ORACLE["pairs_impostor"] = _impostor_sql(3)
ORACLE["pairs_impostor_20"] = _impostor_sql(20)
ORACLE["leakage_audit"] = f"""WITH {_C}, sp AS (SELECT sample_id, subject_id, CASE WHEN sample_id IN (SELECT sample_id FROM g) THEN 'gallery' ELSE 'probe' END AS role FROM c),
 sx AS (SELECT * FROM sp UNION ALL SELECT sample_id, subject_id, 'probe' FROM sp WHERE role = 'gallery' AND sample_id % 24 = 0)
 SELECT 'gallery_and_probe' AS rule, count(*) AS n FROM (SELECT sample_id FROM sx GROUP BY 1 HAVING count(DISTINCT role) = 2)
 UNION ALL SELECT 'background_in_evaluation', count(*) FROM sx WHERE subject_id IN ('S001', 'S004')
 UNION ALL SELECT 'self_pair', count(*) FROM c WHERE sample_id < 7
 UNION ALL SELECT 'pair_outside_split', 3 UNION ALL SELECT 'empty_gallery', count(*) FROM (SELECT 1 FROM sx HAVING count(*) FILTER (role = 'gallery') = 0)
 UNION ALL SELECT 'empty_probe', count(*) FROM (SELECT 1 FROM sx HAVING count(*) FILTER (role = 'probe') = 0)"""
ORACLE["run_dedupe"] = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"
ORACLE["score_cosine"] = ORACLE["score_cosine_columns"] = f"WITH {_C}, {_S} SELECT probe_id, gallery_id, score FROM s"
ORACLE["score_l2"] = f"WITH {_C} SELECT p.sample_id AS probe_id, g.sample_id AS gallery_id, round(-sqrt(list_sum(list_transform(list_zip(p.v, g.v), lambda e: (e[1] - e[2]) * (e[1] - e[2])))), 9) AS score FROM p, g"
ORACLE["score_chi2"] = f"""WITH {_C}, pa AS (SELECT sample_id, list_transform(v, lambda e: abs(e)) AS v FROM p), ga AS (SELECT sample_id, list_transform(v, lambda e: abs(e)) AS v FROM g)
 SELECT pa.sample_id AS probe_id, ga.sample_id AS gallery_id, round(-list_sum(list_transform(list_zip(pa.v, ga.v), lambda e: CASE WHEN e[1] + e[2] > 0 THEN (e[1] - e[2]) * (e[1] - e[2]) / (e[1] + e[2]) ELSE 0 END)), 9) AS score FROM pa, ga"""
ORACLE["score_pairs"] = f"WITH {_C} SELECT a.sample_id AS a, b.sample_id AS b, {_cos('a.v', 'b.v')} AS score FROM c a JOIN c b USING (subject_id) WHERE a.sample_id < b.sample_id"
ORACLE["score_pairs_all"] = f"WITH {_C} SELECT a.sample_id AS a, b.sample_id AS b, {_cos('a.v', 'b.v')} AS score FROM c a JOIN c b USING (subject_id) WHERE a.sample_id < b.sample_id"
ORACLE["rank_matrix_topk"] = f"WITH {_C}, {_S}, {_R} SELECT probe_id, gallery_id, rank, score FROM r WHERE rank <= 5"
_N = f"WITH {_C}, {_S}, m AS (SELECT avg(score) AS mean, stddev_pop(score) AS std, min(score) AS lo, max(score) AS hi FROM s) SELECT probe_id, gallery_id, round({{}}, 6) AS score FROM s, m"
ORACLE["norm_zscore"] = _N.format("(score - mean) / std")
ORACLE["norm_minmax"] = _N.format("(score - lo) / (hi - lo)")
ORACLE["norm_tanh"] = _N.format("(tanh((score - mean) / (2 * std)) + 1) * 0.5")
_H = f"WITH {_C}, h AS MATERIALIZED (SELECT p.sample_id AS probe_id, g.sample_id AS gallery_id, p.subject_id AS truth, g.subject_id AS guess, {_cos('p.v[1:32]', 'g.v[1:32]')} AS a, {_cos('p.v[33:64]', 'g.v[33:64]')} AS b FROM p, g)"
ORACLE["fuse_sum"] = f"{_H} SELECT probe_id, gallery_id, round(a + b, 6) AS score FROM h"
ORACLE["fuse_product"] = f"{_H} SELECT probe_id, gallery_id, round(a * b, 6) AS score FROM h"
ORACLE["fuse_weighted"] = f"{_H} SELECT probe_id, gallery_id, round(0.3::DOUBLE * a + (1 - 0.3::DOUBLE) * b, 6) AS score FROM h"
ORACLE["weight_sweep"] = f"""{_H}, w AS (SELECT round(i / 20.0::DOUBLE, 2) AS weight FROM range(0, 21) t(i)),
 x AS (SELECT weight, probe_id, truth, guess, row_number() OVER (PARTITION BY weight, probe_id ORDER BY round(weight * a + (1 - weight) * b, 9) DESC, gallery_id) AS r FROM h, w)
 SELECT weight, round(avg((truth = guess)::INT), 6) AS rank1 FROM x WHERE r = 1 GROUP BY weight"""
ORACLE["concat_features"] = f"""WITH {_C}, u AS (SELECT sample_id, v, greatest(sqrt(list_sum(list_transform(v[1:32], lambda e: e * e))), 1e-8) AS n1, greatest(sqrt(list_sum(list_transform(v[33:64], lambda e: e * e))), 1e-8) AS n2 FROM c)
 SELECT sample_id, i - 1 AS i, round(v[i] / CASE WHEN i <= 32 THEN n1 ELSE n2 END, 6) AS value FROM u, range(1, 65) t(i)"""
ORACLE["ident_metrics"] = f"""{_ID}, n AS (SELECT count(DISTINCT subject_id)::DOUBLE AS n FROM g)
 SELECT count(*) AS n_probe, any_value(n)::BIGINT AS n_gallery, round(avg((true_rank <= 1)::INT), 6) AS rank1, round(avg((true_rank <= 5)::INT), 6) AS rank5, round(avg((true_rank <= 10)::INT), 6) AS rank10,
 round(avg(1.0::DOUBLE / true_rank), 6) AS mrr, round(avg((predicted = truth)::INT), 6) AS accuracy, round(1.0::DOUBLE / any_value(n), 6) AS chance, round(avg((true_rank <= 1)::INT) * any_value(n), 6) AS ratio FROM d, n"""
ORACLE["cmc"] = f"{_ID} SELECT k, round(avg((true_rank <= k)::INT), 6) AS rate FROM d, range(1, 21) t(k) GROUP BY k"
_PRF = f"""{_ID}, t AS (SELECT g.subject_id, count(*) FILTER (truth = g.subject_id) AS support, count(*) FILTER (predicted = g.subject_id) AS guessed, count(*) FILTER (truth = g.subject_id AND predicted = g.subject_id) AS tp FROM g, d GROUP BY 1),
 q AS (SELECT subject_id, support, CASE WHEN guessed > 0 THEN tp::DOUBLE / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall FROM t),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q)"""
ORACLE["prf_per_class"] = f"{_PRF} SELECT subject_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f"
ORACLE["prf_macro"] = f"{_PRF} SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}_macro, round(sum({m} * support) / sum(support), 6) AS {m}_weighted" for m in ("precision", "recall", "f1")) + " FROM f"
ORACLE["confusion"] = f"{_ID} SELECT truth, predicted, count(*) AS n FROM d GROUP BY 1, 2"
ORACLE["confusion_norm"] = f"{_ID} SELECT truth, predicted, round(count(*) / sum(count(*)) OVER (PARTITION BY truth)::DOUBLE, 6) AS share FROM d GROUP BY 1, 2"
ORACLE["ident_per_condition"] = f"""{_ID} SELECT 'yaw' || CASE WHEN pose_yaw >= 0 THEN '+' ELSE '' END || pose_yaw::BIGINT || '_' || illumination AS condition, round(avg((predicted = truth)::INT), 6) AS rank1, count(*) AS n
 FROM d JOIN c ON probe_id = sample_id GROUP BY 1"""
ORACLE["roc_points"] = f"{_TIES}, {_ROC} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc"
ORACLE["roc_points_pairs"] = f"{_PAIRS}, {_ROC} SELECT threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM roc"
ORACLE["eer"] = f"{_PAIRS}, {_EER}"
ORACLE["eer_ties"] = f"{_TIES}, {_EER}"
ORACLE["auc"] = f"{_PAIRS}, {_RUN} SELECT round(sum(f * (2 * tp - t) / 2) / (sum(t) * sum(f)), 6) AS auc FROM run"
ORACLE["auc_ties"] = f"{_TIES} SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM sc a, sc b WHERE a.y = 1 AND b.y = 0"
ORACLE["tar_at_far"] = f"""{_PAIRS}, i AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS k, count(*) OVER () AS n FROM sc WHERE y = 0),
 l AS (SELECT unnest([0.1, 0.01, 0.001])::DOUBLE AS far), th AS (SELECT far, score AS threshold FROM i, l WHERE k = least(greatest(ceil(far * n), 1), n))
 SELECT far, round(threshold, 6) AS threshold, round(avg((score >= threshold)::INT), 6) AS tar FROM th, sc WHERE y = 1 GROUP BY 1, 2"""
_M = "avg(score) FILTER (y = {0}) AS {1}_mean, stddev_pop(score) FILTER (y = {0}) AS {1}_std, count(*) FILTER (y = {0}) AS n_{1}"
ORACLE["score_moments"] = f"""{_PAIRS}, m AS (SELECT {_M.format(1, 'genuine')}, {_M.format(0, 'impostor')} FROM sc)
 SELECT n_genuine, n_impostor, round(genuine_mean, 6) AS genuine_mean, round(genuine_std, 6) AS genuine_std, round(impostor_mean, 6) AS impostor_mean, round(impostor_std, 6) AS impostor_std,
 round(abs(genuine_mean - impostor_mean) / sqrt(greatest((genuine_std * genuine_std + impostor_std * impostor_std) / 2, 1e-12)), 6) AS dprime FROM m"""
ORACLE["det_far_frr"] = f"{_TIES}, {_ROC} SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS far, round(1 - tpr, 6) AS frr FROM roc"
ORACLE["pr_curve"] = f"{_TIES}, {_RUN} SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM run, tot"
ORACLE["avg_precision"] = f"{_TIES}, {_RUN} SELECT round(sum(t * tp / (tp + fp)) / any_value(P), 6) AS average_precision FROM run, tot"
ORACLE["score_hist"] = f"""{_PAIRS}, e AS (SELECT y, min(score) AS lo, max(score) AS hi FROM sc GROUP BY y)
 SELECT y, least(floor((score - lo) / ((hi - lo) / 40)), 39)::BIGINT AS bin, count(*) AS n FROM sc JOIN e USING (y) GROUP BY 1, 2"""
_CUM = []
_p, _t = 0.36787944117144233, 0.0
for _k in range(8):
    _t += _p
    _CUM.append(f"(u >= {_t!r}::DOUBLE)::INT")
    _p /= _k + 1
ORACLE["bootstrap_ci"] = f"""{_TIES}, u AS (SELECT i, score, y, ('0x' || substr(md5('0|' || i || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sc, range(0, 50) t(i)),
 w AS (SELECT i, score, y, {' + '.join(_CUM)} AS w FROM u), k AS (SELECT i, score, sum(y * w)::DOUBLE AS t, sum((1 - y) * w)::DOUBLE AS f FROM w WHERE w > 0 GROUP BY 1, 2),
 r AS (SELECT *, sum(t) OVER (PARTITION BY i ORDER BY score DESC) AS tp FROM k), a AS (SELECT i, sum(f * (2 * tp - t) / 2) / (sum(t) * sum(f)) AS auc FROM r GROUP BY i)
 SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a"""
ORACLE["bootstrap_ci_1000"] = f"""{_TIES}, u AS (SELECT i, score, y, ('0x' || substr(md5('0|' || i || '|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM sc, range(0, 1000) t(i)),
 w AS (SELECT i, score, y, {' + '.join(_CUM)} AS w FROM u), k AS (SELECT i, score, sum(y * w)::DOUBLE AS t, sum((1 - y) * w)::DOUBLE AS f FROM w WHERE w > 0 GROUP BY 1, 2),
 r AS (SELECT *, sum(t) OVER v AS tp, sum(f) OVER v AS fp FROM k WINDOW v AS (PARTITION BY i ORDER BY score DESC)), n AS (SELECT i, sum(t) AS P, sum(f) AS N FROM k GROUP BY i),
 a AS (SELECT i, sum(f * (2 * tp - t) / 2) / (sum(t) * sum(f)) AS auc FROM r GROUP BY i HAVING sum(t) * sum(f) > 0),
 z AS (SELECT i, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr FROM n UNION ALL SELECT i, fp / N, tp / P FROM r JOIN n USING (i) WHERE P * N > 0),
 o AS (SELECT i, fpr, tpr, fpr - (1 - tpr) AS d, lead(fpr) OVER v AS fpr2, lead(fpr - (1 - tpr)) OVER v AS d2 FROM z WINDOW v AS (PARTITION BY i ORDER BY fpr, tpr)),
 e AS (SELECT fpr + d / (d - d2) * (fpr2 - fpr) AS eer FROM o WHERE d < 0 AND d2 >= 0)
 SELECT 'auc' AS metric, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a
 UNION ALL SELECT 'eer', round(quantile_cont(eer, 0.025), 6), round(quantile_cont(eer, 0.975), 6) FROM e"""
ORACLE["field_gradient"] = f"{_GRAD} SELECT sample_id, y, x, round(zx, 6) AS zx, round(zy, 6) AS zy FROM gr"
ORACLE["normals"] = f"{_GRAD} SELECT sample_id, y, x, round(-zx / sqrt(zx * zx + zy * zy + 1), 6) AS nx, round(-zy / sqrt(zx * zx + zy * zy + 1), 6) AS ny, round(1 / sqrt(zx * zx + zy * zy + 1), 6) AS nz FROM gr"
ORACLE["curvature"] = f"""{_GRAD}, g2 AS (SELECT *, {_d('zx', 'x')} AS zxx, {_d('zx', 'y')} AS zxy, {_d('zy', 'y')} AS zyy, 1 + zx * zx + zy * zy AS q FROM gr),
 hk AS (SELECT *, ((1 + zx * zx) * zyy - 2 * zx * zy * zxy + (1 + zy * zy) * zxx) / (2 * q * sqrt(q)) AS h, (zxx * zyy - zxy * zxy) / (q * q) AS k FROM g2)
 SELECT sample_id, y, x, round(h, 6) AS h, round(k, 6) AS k, round(2 / pi() * atan2(2 * h, 2 * sqrt(greatest(h * h - k, 0)) + 1e-12), 6) AS shape_index FROM hk"""
ORACLE["curv_hist"] = f"""WITH {_G}, e AS (SELECT sample_id, quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM px GROUP BY 1),
 b AS (SELECT sample_id, least(floor((z - lo) / (hi - lo) * 16), 15)::INT AS bin FROM px JOIN e USING (sample_id) WHERE z >= lo AND z <= hi)
 SELECT sample_id, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY sample_id)::DOUBLE, 6) AS share FROM b GROUP BY 1, 2"""
_RN = f"WITH {_G}, e AS (SELECT sample_id, quantile_cont(z, 0.5) AS mid, stddev_pop(z) AS sd, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS span FROM px GROUP BY 1) SELECT sample_id, y, x, round((z - mid) / {{}}, 6) AS z FROM px JOIN e USING (sample_id)"
ORACLE["range_normalize_std"], ORACLE["range_normalize_p5p95"] = _RN.format("sd"), _RN.format("span")
ORACLE["histeq"] = f"""WITH {_G}, q AS (SELECT sample_id, y, x, least(round_even(round(abs(z), 6) * 255, 0), 255)::INT AS level FROM px),
 k AS (SELECT sample_id, level, count(*) AS n FROM q GROUP BY 1, 2), m AS (SELECT sample_id, level, sum(n) OVER w AS cdf, first(n) OVER w AS lo FROM k WINDOW w AS (PARTITION BY sample_id ORDER BY level))
 SELECT sample_id, y, x, round(round_even((cdf - lo) * (255.0::DOUBLE / (64 - lo)), 0) / 255, 6) AS z FROM q JOIN m USING (sample_id, level)"""
_OC = f"WITH {_G}, e AS (SELECT sample_id, quantile_cont(z, 0.5) AS mid FROM px GROUP BY 1)"
ORACLE["occlude_block"] = f"""{_OC}, o AS (SELECT *, (('0x' || substr(md5('y' || sample_id), 1, 8))::BIGINT % 5) AS t, (('0x' || substr(md5('x' || sample_id), 1, 8))::BIGINT % 5) AS l FROM px JOIN e USING (sample_id))
 SELECT sample_id, y, x, round(CASE WHEN y >= t AND y < t + 4 AND x >= l AND x < l + 4 THEN mid ELSE z END, 6) AS z FROM o"""
ORACLE["occlude_sunglasses"] = f"{_OC} SELECT sample_id, y, x, round(CASE WHEN y >= 2 AND y < 3 AND x >= 0 AND x < 7 THEN mid ELSE z END, 6) AS z FROM px JOIN e USING (sample_id)"
ORACLE["block_mean"] = f"WITH {_G} SELECT sample_id, (y // 4)::INT AS y, (x // 4)::INT AS x, round(avg(z), 6) AS z FROM px GROUP BY 1, 2, 3"
_PT = "pt AS (SELECT vec_id AS sample_id, i, embedding[3 * i + 1]::DOUBLE AS px, embedding[3 * i + 2]::DOUBLE AS py, embedding[3 * i + 3]::DOUBLE AS pz FROM embeddings, range(0, 5) t(i))"
ORACLE["lmk_distances"] = f"""WITH {_PT}, d AS (SELECT a.sample_id, a.i, b.i AS j, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS d FROM pt a JOIN pt b ON a.sample_id = b.sample_id AND a.i < b.i)
 SELECT sample_id, i, j, round(d / max(CASE WHEN i = 0 AND j = 1 THEN d END) OVER (PARTITION BY sample_id), 6) AS d FROM d"""
ORACLE["bbox_landmarks"] = f"""WITH {_PT}, b AS (SELECT sample_id, min(px * 1000) AS x0, max(px * 1000) AS x1, min(py * 1000) AS y0, max(py * 1000) AS y1 FROM pt GROUP BY 1),
 h AS (SELECT *, greatest(x1 - x0, y1 - y0) / 2 * 1.35::DOUBLE AS half FROM b) SELECT sample_id, trunc((x0 + x1) / 2 - half)::INT AS x, trunc((y0 + y1) / 2 - half)::INT AS y, trunc(half * 2)::INT AS side FROM h"""
ORACLE["box_landmarks"] = """WITH f AS (SELECT * FROM (VALUES (0, 0.32, 0.38), (1, 0.68, 0.38), (2, 0.5, 0.55), (3, 0.36, 0.73), (4, 0.64, 0.73)) t(i, u, v))
 SELECT vec_id AS sample_id, i::BIGINT AS i, round((vec_id % 7)::DOUBLE + u::DOUBLE * (vec_id % 11), 6) AS px, round((vec_id % 5)::DOUBLE + v::DOUBLE * (vec_id % 13), 6) AS py FROM embeddings, f"""
ORACLE["classify_knn"] = f"""WITH {_C}, t AS (SELECT * FROM c WHERE pose_yaw = 0 AND illumination = 'normal'), q AS (SELECT * FROM c ANTI JOIN t USING (sample_id)),
s AS (SELECT q.sample_id AS probe_id, t.sample_id AS gallery_id, t.subject_id, round(-sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda e: (e[1] - e[2]) * (e[1] - e[2])))), 9) AS score FROM q, t),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, gallery_id) AS rank FROM s),
n AS (SELECT probe_id, subject_id, count(*) AS n FROM r WHERE rank <= 3 GROUP BY ALL)
SELECT probe_id, subject_id AS predicted FROM n QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY n DESC, subject_id) = 1"""
ORACLE["cloud_crop"] = """WITH q AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity::DOUBLE AS px, (l_discount * 100)::DOUBLE AS py, l_tax::DOUBLE AS pz FROM lineitem),
 b AS (SELECT l_returnflag, quantile_cont(px, 0.5) AS mx, quantile_cont(py, 0.5) AS my, greatest(quantile_cont(px, 0.95) - quantile_cont(px, 0.05), quantile_cont(py, 0.95) - quantile_cont(py, 0.05), 1e-4) * 0.85::DOUBLE AS reach FROM q GROUP BY 1),
 x AS (SELECT l_returnflag, l_orderkey, l_linenumber, px - mx AS px, py - my AS py, pz, abs(px - mx) <= reach AND abs(py - my) <= reach AS inside FROM q JOIN b USING (l_returnflag)),
 k AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY l_returnflag) AS kept FROM x)
 SELECT l_returnflag, l_orderkey, l_linenumber, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM k WHERE inside OR kept < 100"""
ORACLE["cloud_crop_huge"] = ORACLE["cloud_crop"]
ORACLE["range_image_pixels"] = f"SELECT sample_id, i, value FROM ({KERNELS['range_image']})"
_NEAR = """n AS (SELECT h.sample_id, h.y, h.x, arg_min(k.z, [(h.y - k.y) * (h.y - k.y) + (h.x - k.x) * (h.x - k.x), k.y, k.x]) AS z
      FROM {0} h JOIN {0} k USING (sample_id) WHERE h.z IS NULL AND k.z IS NOT NULL GROUP BY ALL)
 SELECT {0}.sample_id, {0}.y, {0}.x, round(coalesce({0}.z, n.z), 6) AS z FROM {0} LEFT JOIN n USING (sample_id, y, x)"""
ORACLE["fill_nearest"] = f"WITH {_G}, q AS MATERIALIZED (SELECT sample_id, y, x, CASE WHEN z >= 0 THEN z END AS z FROM px), {_NEAR.format('q')}"
_MESH = f"""WITH {_G}, c AS (SELECT sample_id, y * 8 + x AS k, x + 0.25::DOUBLE * z AS px, y::DOUBLE AS py, z FROM px),
 v AS MATERIALIZED (SELECT sample_id, k, px * (15 / 7.0::DOUBLE) AS u, py * (15 / 7.0::DOUBLE) AS v, z AS w FROM c),
 f AS (SELECT k * 2 + n AS face, k + CASE n WHEN 0 THEN 0 ELSE 1 END AS a, k + CASE n WHEN 0 THEN 1 ELSE 9 END AS b, k + 8 AS c FROM range(0, 56) t(k), range(0, 2) s(n) WHERE k % 8 < 7),
 t AS (SELECT a.sample_id, face, a.u AS u0, a.v AS v0, a.w AS w0, b.u AS u1, b.v AS v1, b.w AS w1, c.u AS u2, c.v AS v2, c.w AS w2
       FROM f JOIN v a ON a.k = f.a JOIN v b ON b.k = f.b AND b.sample_id = a.sample_id JOIN v c ON c.k = f.c AND c.sample_id = a.sample_id),
 e AS (SELECT *, (v1 - v2) * (u0 - u2) + (u2 - u1) * (v0 - v2) AS area FROM t),
 h AS (SELECT sample_id, face, y::INT AS y, x::INT AS x, ((v1 - v2) * (x - u2) + (u2 - u1) * (y - v2)) / area AS sa, ((v2 - v0) * (x - u2) + (u0 - u2) * (y - v2)) / area AS sb, w0, w1, w2
       FROM e, range(0, 16) p(y), range(0, 16) q(x) WHERE abs(area) >= 1e-12),
 i AS (SELECT sample_id, y, x, arg_max(sa * w0 + sb * w1 + (1 - sa - sb) * w2, face) AS z FROM h WHERE sa >= -1e-9 AND sb >= -1e-9 AND 1 - sa - sb >= -1e-9 GROUP BY ALL),
 g AS MATERIALIZED (SELECT sample_id, y::INT AS y, x::INT AS x, z FROM (SELECT sample_id, y, x FROM (SELECT DISTINCT sample_id FROM v), range(0, 16) p(y), range(0, 16) q(x)) LEFT JOIN i USING (sample_id, y, x))"""
ORACLE["mesh_interpolate"] = f"{_MESH} SELECT sample_id, y, x, round(z, 6) AS z FROM g"
ORACLE["mesh_to_depth"] = f"{_MESH}, {_NEAR.format('g')}"
_RUNS = "WITH runs AS (SELECT event_type AS arm, user_id % 5 AS seed, value::DOUBLE AS rank1 FROM events), b AS (SELECT arm, seed, avg(rank1) AS rank1, max(rank1) AS top, count(*) AS n FROM runs GROUP BY 1, 2)"
ORACLE["seed_mean_std"] = f"{_RUNS} SELECT arm, count(*) AS n, round(avg(rank1), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(rank1) END, 6) AS std FROM b GROUP BY 1"
ORACLE["seed_summary"] = f"{_RUNS} SELECT arm, round(avg(rank1), 6) AS rank1_mean, round(stddev_samp(rank1), 6) AS rank1_std, round(avg(top), 6) AS top_mean, round(stddev_samp(top), 6) AS top_std FROM b GROUP BY 1"
ORACLE["render_t1"] = f"{_RUNS} SELECT arm, printf('%.2f', avg(rank1)) || '±' || printf('%.2f', stddev_samp(rank1)) AS rank1 FROM b GROUP BY 1"
ORACLE["chance_ratio"] = f"{_RUNS}, a AS (SELECT arm, avg(rank1) AS rank1, count(DISTINCT seed) AS gallery_size FROM runs GROUP BY 1) SELECT arm, gallery_size, round(rank1, 6) AS rank1, round(1.0::DOUBLE / gallery_size, 6) AS chance, round(rank1 * gallery_size, 6) AS ratio FROM a"
ORACLE["robustness_rollup"] = f"{_RUNS} SELECT seed, arm AS condition, round(rank1, 6) AS rank1, n FROM b"
ORACLE["timing_table"] = f"{_RUNS} SELECT arm, round(quantile_cont(rank1, 0.5), 6) AS median_ms, round(avg(rank1), 6) AS mean_ms, round(stddev_pop(rank1), 6) AS std_ms, count(rank1) AS n FROM runs GROUP BY 1"
ORACLE["json_metrics"] = "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, round(avg(k), 6) AS mean FROM (SELECT event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events) GROUP BY 1"
ORACLE["pareto_frontier"] = """SELECT DISTINCT p_size AS accuracy, p_retailprice::DOUBLE AS cost FROM part a
 WHERE NOT EXISTS (SELECT 1 FROM part b WHERE (b.p_size > a.p_size AND b.p_retailprice <= a.p_retailprice) OR (b.p_size = a.p_size AND b.p_retailprice < a.p_retailprice))"""

ORACLE |= KERNELS
ORACLE["det_deviates"] = f"""{_TIES}, {_ROC} SELECT round(fpr, 6) AS far, round(1 - tpr, 6) AS frr, round({deviate('fpr')}, 6) AS far_deviate, round({deviate('(1 - tpr)')}, 6) AS frr_deviate FROM roc"""
