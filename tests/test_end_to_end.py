"""From files to reports by the command line, and the parts in between."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbench import cli
from matchbench.functions import kernels as K
from matchbench.plans import config, experiments, preprocess
from matchbench.sources import files, images, results, toy


def test_files_to_report(spark, tmp_path, capsys):
    root = ["--data-root", str(tmp_path / "data"), "--results-root", str(tmp_path / "results")]
    configs = tmp_path / "configs" / "experiments"
    configs.mkdir(parents=True)
    (configs / "X1.json").write_text(json.dumps({
        "id": "X1", "dataset": "toy", "protocols": ["P1_closed"], "seeds": [0], "arms": [{"key": "2D", "feature": "hog", "matcher": "nn_cosine"}],
        "robustness": {"type": "occlusion", "conditions": [{"name": "glasses", "kind": "sunglasses", "fraction": 0.2}, {"name": "block_40", "kind": "block", "fraction": 0.4}]},
    }))
    assert cli.main(["dataset-build", *root, "--subjects", "4", "--samples", "6"]) == 0
    assert cli.main(["ingest", *root]) == 0 and cli.main(["preprocess", *root]) == 0
    interim = spark.read.parquet(str(tmp_path / "data/interim/toy"))
    assert {(r["kind"], r["count"]) for r in interim.groupBy("kind").count().collect()} == {("image", 24), ("depth", 24), ("landmarks", 24)} and interim.where("not ok").isEmpty()
    cli.main(["preprocess", *root])
    assert spark.read.parquet(str(tmp_path / "data/interim/toy")).count() == 72  # nothing was stale
    flagged = spark.read.parquet(str(tmp_path / "data/processed/toy/flagged"))
    assert flagged.where("detect_ok and nosetip_ok and quality_flag = '' and has_2d and has_3d").count() == 24
    assert cli.main(["splits", *root, "--protocol", "P2_disjoint"]) == 0
    split = results.read_split(spark, str(tmp_path / "data/processed/toy/splits/protocol=P2_disjoint/seed=0"), "P2_disjoint")
    n = {r["kind"]: r["n"] for r in results.summary(split).collect()}
    assert n == {"train_subject": 1, "eval_subject": 3, "gallery": 3, "probe": 15, "genuine": 45, "impostor": 108}
    run = ["run", *root, "--exp", "X1", "--configs-root", str(tmp_path / "configs"), "--replicates", "20"]
    cli.main(run)
    runs = files.read_runs(spark, str(tmp_path / "results/runs"))
    r = runs.first()
    ident, verif = r["identification"], r["verification"]
    assert r["data_modality"] == "synthetic_toy" and ident["rank1"] > 0.5 and ident["n_probe"] == 20 and ident["n_gallery"] == 4
    assert len(ident["cmc"]) == 20 and ident["cmc"][0] == ident["rank1"] and set(ident["per_class"]) == {"S001", "S002", "S003", "S004"} and sum(x["n"] for x in ident["per_condition"].values()) == 20
    assert verif["auc"] > 0.5 and verif["eer_ci95"][0] <= verif["eer_ci95"][1] and set(verif["tar_at_far"]) == {"0.1", "0.01", "0.001"} and verif["n_genuine"] == 60
    assert set(r["robustness"]) == {"glasses", "block_40"} and all(x["n"] == 20 and x["rank1"] <= 1 for x in r["robustness"].values())
    cli.main(run)
    assert "skipping X1" in capsys.readouterr().out and files.read_runs(spark, str(tmp_path / "results/runs")).count() == 1
    cli.main(["aggregate", *root])
    assert "| toy | synthetic_toy | X1 | 2D | P1_closed |" in (tmp_path / "results/RESULTS.md").read_text()
    assert len(json.loads((tmp_path / "results/tables/sweep.json").read_text())) == 2


def test_missing_arrays_and_mixed_data_are_errors(spark):
    m = spark.createDataFrame([("a", True, False, "real"), ("b", True, False, "real")], "sample_id string, has_2d boolean, has_3d boolean, data_modality string")
    arrays = spark.createDataFrame([("a", "image", [1.0])], "sample_id string, kind string, data array<double>")
    with pytest.raises(ValueError, match="1 captures have no image"):
        preprocess.captures(m, arrays, ("image",))
    with pytest.raises(ValueError, match="mix"):
        preprocess.captures(m.withColumn("data_modality", F.col("sample_id")), arrays, ("image",))


def test_leaks_are_errors(spark, tmp_path):
    rows = [("train_subject", "S001", None), ("eval_subject", "S001", None), ("gallery", "x", None), ("probe", "x", None), ("probe", "y", None), ("genuine", "x", "x")]
    results.write_split(spark.createDataFrame(rows, "kind string, a string, b string"), str(tmp_path / "s"))
    with pytest.raises(ValueError, match="gallery_and_probe: 1.*self_pair: 1.*subject_in_both_parts: 1"):
        results.read_split(spark, str(tmp_path / "s"), "P2_disjoint")
    nested = {"protocol": "P1_closed", "seed": 0, "train_subjects": ["S001"], "eval_subjects": ["S001"], "gallery_ids": ["a"], "probe_ids": ["b", "c"], "gallery_selection": "normal_frontal", "verification": {"genuine": [["a", "b"]], "impostor": []}}
    (tmp_path / "s.json").write_text(json.dumps(nested, indent=2))
    assert {r["kind"]: r["n"] for r in results.summary(results.split_from_json(spark, str(tmp_path / "s.json"))).collect()} == {"train_subject": 1, "eval_subject": 1, "gallery": 1, "probe": 2, "genuine": 1}


def test_configuration(tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}
    assert config.settings("yaleb")["2d"]["illum"]["method"] == "clahe" and config.settings("toy", {"3d": {"range": {"size": 32}}})["3d"]["range"] == {"size": 32, "fill": "nearest", "z_norm": "std"}
    base = {"id": "Q", "dataset": "toy", "protocols": ["P1_closed"], "seeds": [0], "arms": []}
    for bad in ({k: v for k, v in base.items() if k != "arms"}, base | {"colour": 1}):
        with pytest.raises(ValueError):
            config.resolve(bad)
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        config.load(tmp_path / "list.json")
    with pytest.raises(KeyError):
        config.experiment("E99")


def test_photos():
    r = np.random.default_rng(1)
    colour = r.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert np.array_equal(images.decode(images.encode_png(colour)), colour) and np.array_equal(images.decode(images.encode_png(colour[..., 0])), colour[..., 0])
    assert np.array_equal(images.decode(b"P6 7 9 255\n" + colour.tobytes()), colour)
    with pytest.raises(ValueError):
        images.decode(b"GIF89a")
    p = {k: (lo + hi) / 2 for k, (lo, hi) in toy.SHAPE.items()} | {"pose_yaw": 0.0, "pose_pitch": 0.0, "illumination": "normal", "noise": 0}
    value, depth, seen = toy.render(p)
    a, ok, how = preprocess.photo(images.encode_png(value), seen, config.settings("toy")["2d"])
    assert ok and how == "ground_truth" and a.shape == (64, 64) and a.std() > 0.05
    assert preprocess.photo(images.encode_png(value), None, config.settings("toy")["2d"])[1:] == (False, "none")
    assert preprocess.photo(images.encode_png(value), None, config.settings("yaleb")["2d"])[2] == "whole"
    moved = K.move(np.array(preprocess.TEMPLATE_112), np.eye(2), 1.0, np.array([3.0, 4.0]))
    flat = np.zeros((130, 130), np.uint8)
    flat[24:30, 39:45] = 255
    there = K.warp(flat / 255.0, *K.similarity(moved, np.array(preprocess.TEMPLATE_112)), 112)
    assert there[20:26, 36:42].min() > 0.99  # three pixels to the left, four up
    points = toy.spatial(seen, depth)
    assert preprocess.landmark_quality(points) == {"n_points": 5, "detect_ok": True, "nosetip_ok": True} and preprocess.nose_tip(points)[2] > 0
    points[2, 2] = np.nan
    with pytest.raises(ValueError):
        preprocess.nose_tip(points)
    assert np.allclose(preprocess.shrink(np.arange(16.0).reshape(4, 4), 2), [[2.5, 4.5], [10.5, 12.5]])


def test_experiments_name_what_they_read():
    assert experiments.kinds(experiments.EXPERIMENTS["E02"]) == ("depth", "landmarks") and experiments.kinds(experiments.EXPERIMENTS["E08"]) == ("image",)
