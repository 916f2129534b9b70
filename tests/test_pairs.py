"""Every pair, folded where it is scored, against the rows of ``scoring.all_pairs``."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbench.operators import fields, pairs, sampling, scoring, splits, verification

METRICS = {"auc": verification.auc, "eer": verification.eer, "tar": verification.tar_at_far, "roc": verification.roc}


@pytest.fixture(scope="module")
def templates(spark):
    """Subjects of 1 to 300 rows, with copies and a zero vector."""
    r = np.random.default_rng(1)
    of = np.repeat(np.arange(40), [300, 90, *[3] * 30, *[1] * 8])
    v = np.round(r.normal(size=(len(of), 6)) + (of[:, None] % 7 == 0), 1)
    v[5:9], v[40] = v[4], 0
    rows = [(int(i), f"S{k:03}", [float(x) for x in w]) for i, (k, w) in enumerate(zip(of, v, strict=True))]
    return spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "sample_id long, subject_id string, embedding array<float>").repartition(3).persist()


@pytest.fixture(scope="module")
def scored(templates):
    return scoring.all_pairs(templates).persist()


def rows_of(df):
    return sorted((tuple(None if v is None else round(v, 8) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"dense": 1 << 27, "few": 100}, {"dense": 1 << 16, "few": 30000}, {"limit": 0}], ids=["whole", "dense", "few", "tiles"])
def test_curves_of_pairs(templates, scored, how, monkeypatch):
    monkeypatch.setattr(pairs, "ROWS", 64)
    monkeypatch.setattr(pairs, "COLUMNS", 100)
    monkeypatch.setattr(pairs, "DEALT", 250)
    c = pairs.curve(templates, **how)
    assert sorted(c.counts.collect(), key=repr) == sorted(verification.running_counts(scored).collect(), key=repr)
    for f in METRICS.values() if not how else ():
        assert rows_of(f(c)) == rows_of(f(scored))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_moments_and_histograms_of_pairs(templates, scored, limit):
    assert rows_of(pairs.moments(templates, limit=limit)) == rows_of(verification.moments(scored))
    assert rows_of(pairs.histogram(templates, limit=limit)) == rows_of(verification.histogram(scored).select("y", "bin", "n"))


def test_many_pairs_of_one_score_and_none(spark, templates):
    """A cell whose pairs may pass 32 bits is a range of its own."""
    cells = [(9, 5, 5), (8, 1 << 40, 3), (7, 1, 1), (2, 0, 4)]
    got = pairs.cut(cells, dense=1 << 30)
    assert [(r.wide, r.inside, r.above) for r in got] == [(False, (5, 5), (0, 0)), (True, (1 << 40, 3), (5, 5)), (False, (1, 5), (5 + (1 << 40), 8))]
    assert [r.below for r in got[:2]] == [got[1].lo, 7 * pairs.CELL - pairs.ONE - pairs.CELL] and got[2].below == got[2].lo
    assert pairs.curve(templates.limit(0)).counts.count() == 0 and pairs.curve(templates.limit(1)).genuine == 0


def test_genuine_pairs_by_blocks(spark, templates, scored):
    """Subjects of many blocks; ids in letters; the same pairs and scores."""
    want = rows_of(scored.where("y = 1").select("a", "b", "score"))
    assert rows_of(splits.genuine_pairs(templates, block=16)) == [w[:2] for w in want]
    assert rows_of(scoring.score_genuine(templates, block=16)) == want
    twice = templates.unionByName(templates.where("sample_id % 7 = 0")).withColumn("sample_id", templates["sample_id"].cast("string"))
    assert sorted(tuple(r) for r in scoring.score_genuine(twice, block=50).select("a", "b").collect()) == sorted(tuple(r) for r in splits.genuine_pairs(twice, block=7).collect())
    assert scoring.score_genuine(templates.limit(0)).count() == 0 and splits.genuine_pairs(templates.limit(0)).count() == 0
    sizes = [r["count"] for r in splits.genuine_pairs(templates, block=16).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) * 0.5  # one subject has nine tenths of all pairs


def test_impostor_pairs_without_a_shuffle(spark, templates):
    """Looked up or joined, the same pairs; the plan of the former moves nothing."""
    for t in (templates, templates.withColumn("sample_id", templates["sample_id"].cast("string"))):
        one, two = splits.impostor_pairs(t, 5000, 3), splits.impostor_pairs(t, 5000, 3, limit=0)
        assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in two.collect()) and one.count() == 5000
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_clouds_are_not_joined_in_a_task_each(spark):
    """Points meet their cloud's bounds without a shuffle by cloud, however small automatic broadcasts are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = spark.range(3000).selectExpr("id % 3 as c", "cast(id % 50 as double) as px", "cast(id % 11 as double) as py", "0.0D as pz")
        x = fields.crop_cloud(p, ["c"])
        assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString() and x.count() == fields.crop_cloud(p, ["c"], huge=True).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_best_rows_of_a_large_gallery(spark, templates):
    """Scores held at once don't grow with the gallery; the best are the same."""
    assert all(scoring.rows_at_once(n) * n <= max(n, scoring.AT_ONCE) for n in (1, 2000, 51_282, 10**7)) and scoring.rows_at_once(0) > 0
    want = rows_of(scoring.score_blocks(templates, templates, "l2", top=3))
    assert rows_of(scoring.score_blocks(templates, templates, "l2", top=500).groupBy("probe_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "gallery_id"))).alias("r")).select("probe_id", F.explode(F.slice("r", 1, 3)).alias("r")).select("probe_id", "r.gallery_id", (-F.col("r.d")).alias("score"))) == want


def test_replicates_draw_once_a_row(spark):
    """A row's draw is not repeated in a filter, and replicates aren't shuffled beyond the deal of their numbers."""
    s = spark.range(50).selectExpr("id as doc_id", "cast(id % 7 as double) as score", "cast(id % 2 as int) as y")
    draw = sampling.poisson_draw(0, F.col("replicate").cast("string"), F.col("doc_id").cast("string"))
    plan = verification._replicates(s, draw, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_figures_of_a_few_scores_count_no_others(templates, scored, limit, monkeypatch):
    """Crossing and rates at levels come from cells of scores, however far the corners are; memory isn't that of all scores."""
    c = pairs.curve(templates, limit=limit)
    monkeypatch.setattr(type(c), "counts", property(lambda self: pytest.fail("all counts are made")))
    for beside in (1, 1 << 16):
        monkeypatch.setattr(verification, "BESIDE", beside)
        assert rows_of(verification.eer(c)) == rows_of(verification.eer(scored))
    assert rows_of(verification.tar_at_far(c)) == rows_of(verification.tar_at_far(scored))


def test_crossing_before_the_first_score(spark):
    t = spark.createDataFrame([(i, "ab"[i < 4], [1.0, float(i >= 4)]) for i in range(8)], "sample_id long, subject_id string, embedding array<double>")
    s = scoring.all_pairs(t)
    assert rows_of(verification.eer(pairs.curve(t))) == rows_of(verification.eer(s))


def test_small_counters_hold_any_number(monkeypatch):
    monkeypatch.setattr(pairs, "TOGETHER", 500)
    r = np.random.default_rng(2)
    z = np.concatenate([r.integers(0, 3000, 20000), np.full(70000, 17), np.full(255, 5), np.full(256, 6)])
    for total in (1, 3000 * 24 + 1, 1 << 60):
        x = pairs._Tally(3000, total)
        for part in np.array_split(r.permutation(z), 300):
            x.add(part.astype(np.int32))
        assert np.array_equal(np.concatenate([x.cut(0, 1000), x.cut(1000, 3000)]), np.bincount(z, minlength=3000))
    assert pairs._Tally(100, 2400).n.dtype == np.uint8


@pytest.mark.parametrize("text", [False, True])
def test_genuine_pairs_are_scored_without_a_shuffle(templates, scored, text):
    """Broadcast or in blocks by a shuffle, the same pairs and scores; the plan of the former moves nothing."""
    t = templates.withColumn("sample_id", F.col("sample_id").cast("string")) if text else templates
    sorted_rows = lambda df: sorted((r["a"], r["b"], round(r["score"], 8)) for r in df.collect())
    want = sorted_rows(scoring.all_pairs(t).where("y = 1").select("a", "b", "score"))
    one = scoring.score_genuine(t, block=16)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString() and sorted_rows(one) == want
    assert sorted_rows(scoring.score_genuine(t, limit=0)) == want and sorted_rows(scoring.score_genuine(t, block=100, limit=0)) == want
    twice = t.unionByName(t.where("cast(sample_id as long) % 7 = 0"))
    pairs_ = [sorted((r["a"], r["b"]) for r in scoring.score_genuine(twice, block=50, limit=k).collect()) for k in (0, 1 << 20)]
    assert pairs_[0] == pairs_[1] and scoring.score_genuine(t.limit(0), limit=-1).count() == 0


def _neighbours(rows):
    """Share of rows that have an id of the row before them."""
    return sum(bool({x["a"], x["b"]} & {y["a"], y["b"]}) for x, y in zip(rows, rows[1:], strict=False)) / (len(rows) - 1)


@pytest.mark.parametrize("text", [False, True])
def test_all_impostor_pairs_come_tile_by_tile(spark, templates, text, monkeypatch):
    """Where every pair is drawn, each comes once, beside others of its ids: written, they take few bytes."""
    monkeypatch.setattr(splits, "BEFORE", 64, raising=False)
    monkeypatch.setattr(splits, "AFTER", 150, raising=False)
    monkeypatch.setattr(splits, "AT_ONCE", 1000, raising=False)
    t = templates.withColumn("sample_id", templates["sample_id"].cast("string")) if text else templates
    got = splits.impostor_pairs(t, 10**9, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, splits.impostor_pairs(t, 10**9, 3, limit=0).collect()))
    assert len(set(map(tuple, got))) == len(got) == 488 * 487 // 2 - 300 * 299 // 2 - 90 * 89 // 2 - 30 * 3 and _neighbours(got) > 0.9
    assert splits.impostor_pairs(t.where("subject_id = 'S000'"), 9, 3).count() == 0


@pytest.mark.parametrize("text", [False, True])
def test_many_drawn_impostor_pairs_come_tile_by_tile(spark, templates, text, monkeypatch):
    """A third of all pairs: the same as by joins, and beside others of their ids."""
    for name, value in (("BEFORE", 64), ("AFTER", 150), ("AT_ONCE", 1000)):
        monkeypatch.setattr(splits, name, value, raising=False)
    t = templates.withColumn("sample_id", templates["sample_id"].cast("string")) if text else templates
    got = splits.impostor_pairs(t, 23000, 3).collect()
    assert len(got) == 23000 and sorted(map(tuple, got)) == sorted(map(tuple, splits.impostor_pairs(t, 23000, 3, limit=0).collect())) and _neighbours(got) > 0.9


def test_curves_of_large_templates_shuffle_no_scores(templates, scored, monkeypatch):
    """Beyond what is broadcast at once templates come in pieces: counts are those of the rows, made in the task of a range."""
    monkeypatch.setattr(pairs, "DEALT", 100)
    monkeypatch.setattr(verification, "running_counts", lambda *a: pytest.fail("counts by score are shuffled"))
    c = pairs.curve(templates, limit=0, dense=1 << 16, few=30000).counts
    assert "Exchange" not in c._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    assert sorted(c.collect(), key=repr) == sorted(verification.running_counts(scored).collect(), key=repr)
