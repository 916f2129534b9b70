"""Features as ML stages."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from matchbench.functions import kernels as K
from matchbench.operators import estimators, stages


@pytest.fixture(scope="module")
def rows(spark):
    m = np.random.default_rng(1).random((12, 64))
    return m, spark.createDataFrame([(i, f"S{i % 3}", f"x{i}", v.tolist()) for i, v in enumerate(m)], "sample_id long, subject_id string, more string, image array<double>").persist()


def templates(df, out="template"):
    return {r["sample_id"]: r[out] for r in df.collect()}


def test_components_equal_the_operator(rows):
    _, t = rows
    got = stages.PrincipalComponents(0.8, inputCol="image").fit(t).transform(t)
    assert got.columns == [*t.columns, "template"]
    want = templates(estimators.fit_pca(t, "image", 0.8).transform(t, "image"))
    assert all(np.allclose(v, want[k]) for k, v in templates(got).items()) and len(want) == 12


def test_a_saved_pipeline_gives_equal_templates(spark, rows, tmp_path):
    m, t = rows
    p = Pipeline(stages=[stages.FixedFeature("gabor", 8, inputCol="image", outputCol="waves"), stages.PrincipalComponents(1.0, 5, inputCol="waves", outputCol="short"), stages.Discriminants(inputCol="short", outputCol="template")])
    fitted = p.fit(t)
    fitted.write().overwrite().save(f"{tmp_path}/model")
    p.write().overwrite().save(f"{tmp_path}/pipeline")
    again = PipelineModel.load(f"{tmp_path}/model")
    a, b, c = (templates(x.transform(t)) for x in (fitted, again, Pipeline.load(f"{tmp_path}/pipeline").fit(t)))
    assert all(np.array_equal(a[k], b[k]) and np.allclose(a[k], c[k]) for k in range(12)) and len(a[0]) == 2
    assert [s.uid for s in again.stages] == [s.uid for s in fitted.stages]
    assert np.allclose(templates(again.stages[0].transform(t), "waves")[3], np.ravel(K.gabor(m[3].reshape(8, 8))))
    with pytest.raises(Exception, match="too small"):
        stages.FixedFeature("hog", 8, inputCol="image").transform(t).collect()


def test_edges(rows):
    _, t = rows
    holes = t.withColumn("image", F.when(F.col("sample_id") != 4, F.col("image")))
    model = stages.PrincipalComponents(inputCol="image").fit(holes)
    got = templates(model.transform(holes))
    assert got[4] is None and got[5] is not None and model.transform(t.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        model.transform(t.withColumn("template", F.lit(1)))
    with pytest.raises(KeyError):
        stages.FixedFeature("eyes")
    with pytest.raises(ValueError, match="no rows"):
        stages.PrincipalComponents(inputCol="image").fit(t.limit(0))
