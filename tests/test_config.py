"""Experiment files: named settings and parameters of arms."""

import json

import numpy as np
import pytest

from matchbench.functions import kernels as K
from matchbench.plans import config, experiments


@pytest.fixture
def root(tmp_path):
    def write(name, what):
        path = tmp_path / f"{name}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(what))

    write("base", {"preprocess": {"illum": {"method": "histeq"}, "range": {"z_norm": "p5p95"}, "else": 1}})
    write("datasets/yaleb", {"name": "yaleb", "preprocess_2d": "dark", "preprocess_3d": "deep"})
    write("preprocess/dark", {"illum": {"method": "tantriggs"}})
    write("preprocess/deep", {"range": {"size": 32}})
    write("preprocess/other", {"align": {"size_64": 48}})
    return tmp_path


RAW = {"id": "X", "dataset": "yaleb", "protocols": ["P1_closed"], "seeds": [0], "arms": [{"key": "a", "feature": "hog", "matcher": "nn_cosine"}]}


def of(root, **more):
    return config.resolve(RAW | more, root)


def test_named_settings(root):
    p = of(root).settings["preprocess"]
    assert p["2d"]["illum"]["method"] == "tantriggs" and p["3d"]["range"] == {"size": 32, "fill": "nearest", "z_norm": "p5p95"} and "else" not in p["2d"]
    p = of(root, preprocess={"2d": "other", "3d": {"range": {"size": 16}}}).settings["preprocess"]
    assert p["2d"]["align"] == {"size_112": 112, "size_64": 48} and p["2d"]["illum"]["method"] == "histeq" and p["3d"]["range"]["size"] == 16
    with pytest.raises(FileNotFoundError, match="nowhere"):
        of(root, preprocess={"2d": "nowhere"})
    with pytest.raises(FileNotFoundError):
        config.resolve(RAW | {"preprocess": {"2d": "dark"}})
    with pytest.raises(ValueError, match="4d"):
        of(root, preprocess={"4d": {}})
    assert config.resolve(RAW).settings["preprocess"]["2d"]["illum"]["method"] == "clahe"


def test_parameters_of_arms(root):
    arm = RAW["arms"][0]
    e = of(root, arms=[arm | {"feature_params": {"pixels_per_cell": [4, 4]}}, arm | {"matcher": "svm_rbf", "matcher_params": {"gamma": "scale", "C": 2}}])
    assert e.arms[0].feature_params == {"pixels_per_cell": [4, 4]} and experiments.arguments(experiments.MATCHER_PARAMETERS, "svm_rbf", e.arms[1].matcher_params) == {"gamma": None, "c": 2.0}
    for bad in ({"feature_params": {"colour": 1}}, {"matcher_params": {"k": 1}}, {"feature_params": {"pixels_per_cell": [4, 8]}}, {"more": 1}):
        with pytest.raises(ValueError):
            of(root, arms=[arm | bad])
    with pytest.raises(ValueError, match="lacks"):
        of(root, arms=[{"key": "a"}])


def test_parameters_reach_templates(spark):
    r = np.random.default_rng(0)
    m = r.random((6, 64))
    rows = spark.createDataFrame([(i, f"S{i % 3}", v.tolist()) for i, v in enumerate(m)], "sample_id long, subject_id string, image array<double>")
    made = lambda f, **p: {x["sample_id"]: x["template"] for x in experiments.feature_of(experiments.Arm("x", f, "nn_cosine", p))(rows, rows, "image", 8).collect()}
    assert np.allclose(made("hog", pixels_per_cell=[4, 4])[0], K.hog(m[0].reshape(8, 8), cell=4))
    assert np.allclose(made("lbp", blocks=2)[1], K.lbp(m[1].reshape(8, 8), blocks=2))
    whole, fewer = made("pca", variance_keep=1.0), made("pca", variance_keep=1.0, max_components=3, drop_first_k=1)
    assert all(np.allclose(fewer[i], whole[i][1:3]) for i in range(6))
    assert len(made("curv_hist", bins=4)[0]) == 12 and len(made("normal_hog", cells_per_block=1, pixels_per_cell=4)[0]) == 36
    with pytest.raises(ValueError, match="dropped"):
        made("pca", drop_first_k=10)
