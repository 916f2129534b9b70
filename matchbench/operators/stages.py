"""Features as Spark ML stages: fitted on a table, applied by ``transform`` (which adds a column and keeps all others), put in a
``Pipeline``, and saved by its writer to any file system that Spark knows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.columns import doubles
from .estimators import Projection, fit_lda, fit_pca
from .scoring import _matrix

#: Features without a fit, of images given row by row.
FIXED = {"hog": K.hog, "lbp": K.lbp, "gabor": K.gabor}


def _added(df: DataFrame, column: str, out: str, make) -> DataFrame:
    """``df`` with ``make`` of the rows' matrix as one more column; rows without a vector get null."""
    if out in df.columns:
        raise ValueError(f"the table has a column {out!r} already")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.num_columns - 1)
            here = np.flatnonzero(v.is_valid())
            made: list = [None] * len(b)
            if len(here):
                for i, row in zip(here, make(_matrix(v.take(pa.array(here)))), strict=True):
                    made[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.list_(pa.float64()))], schema.names)

    return df.select("*", doubles(F.col(column)).alias(out)).mapInArrow(run, schema)


class _Columns(HasInputCol, HasOutputCol):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="embedding", outputCol="template")


def _described(kernel, image: np.ndarray) -> list[float]:
    v = np.ravel(kernel(image))
    if not len(v):
        raise ValueError(f"images of {image.shape[0]} x {image.shape[1]} are too small for the feature")
    return v.tolist()


class FixedFeature(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A feature of ``FIXED`` of square images in row-major order."""

    feature = Param(Params._dummy(), "feature", "name of the feature", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "width of the images", TypeConverters.toInt)

    def __init__(self, feature: str = "hog", width: int = 64, **columns: str) -> None:
        super().__init__()
        if feature not in FIXED:
            raise KeyError(f"unknown feature {feature!r}; known: {', '.join(sorted(FIXED))}")
        self._set(feature=feature, width=width, **columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        kernel, n = FIXED[self.getOrDefault("feature")], self.getOrDefault("width")
        return _added(df, self.getInputCol(), self.getOutputCol(), lambda m: [_described(kernel, a.reshape(-1, n)) for a in m])


class ProjectionModel(Model, _Columns, MLReadable, MLWritable):
    """Templates on fitted axes."""

    def __init__(self, projection: Projection | None = None) -> None:
        super().__init__()
        self.projection = projection

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.projection.mean, self.projection.axes))
        return _added(df, self.getInputCol(), self.getOutputCol(), lambda m: ((m - shared.value[0]) @ shared.value[1]).tolist())

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ProjectionModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.projection.save(f"{path}/projection", self.sparkSession)


class _Reader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ProjectionModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(Projection.load(f"{path}/projection", self.sparkSession))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Fitted(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    most = Param(Params._dummy(), "most", "components at most", TypeConverters.toInt)

    def _model(self, projection: Projection) -> ProjectionModel:
        model = ProjectionModel(projection)
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class PrincipalComponents(_Fitted):
    """``estimators.fit_pca`` of the rows that have a vector."""

    keep = Param(Params._dummy(), "keep", "share of the variance", TypeConverters.toFloat)

    def __init__(self, keep: float = 0.95, most: int = 150, **columns: str) -> None:
        super().__init__()
        self._set(keep=keep, most=most, **columns)

    def _fit(self, df: DataFrame) -> ProjectionModel:
        column = self.getInputCol()
        return self._model(fit_pca(df.where(F.col(column).isNotNull()), column, self.getOrDefault("keep"), self.getOrDefault("most")))


class Discriminants(_Fitted):
    """``estimators.fit_lda`` of the rows that have a vector, by their ``subject_id``."""

    def __init__(self, most: int = 50, **columns: str) -> None:
        super().__init__()
        self._set(most=most, **columns)

    def _fit(self, df: DataFrame) -> ProjectionModel:
        column = self.getInputCol()
        return self._model(fit_lda(df.where(F.col(column).isNotNull()), column, self.getOrDefault("most")))
