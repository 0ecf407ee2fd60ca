"""RBF-kernel SVM with probabilities, distributed.

The RBF kernel exp(-gamma |x - y|^2) is the mean of cos(w.x + b) cos(w.y + b)
times two over w ~ N(0, 2 gamma) and a uniform phase b, so a linear SVM over
``sqrt(2/D) cos(w_j.x + b_j)``, j < D, approximates the kernel machine; the
error of one kernel value falls with 1/sqrt(D) (standard deviation below
1/sqrt(D)).  A row's features depend on that row alone: no kernel matrix, and
every fit is MLlib's distributed one.

Probabilities are Platt's: a logistic curve over margins of rows that the model
did not learn from.  Folds follow a hash of the features, so copies share one.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.functions.scalar import HASH_DIGITS
from tracefuse.operators.models import without_summary
from tracefuse.session import cut_lineage


def hash_uniforms(key: str) -> tuple[float, float]:
    """Two numbers in (0, 1) from the MD5 of a text."""
    digest, unit = hashlib.md5(key.encode()).hexdigest(), float(16 ** HASH_DIGITS)
    return tuple((int(digest[i * HASH_DIGITS:(i + 1) * HASH_DIGITS], 16) + 0.5) / unit for i in (0, 1))


@functools.lru_cache(maxsize=8)
def projection(dims: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(dims x size weights, size phases); feature j's numbers depend on (seed, j, dimension) alone."""
    weights = np.empty((dims, size))
    phases = np.empty(size)
    for j in range(size):
        for i in range(dims):
            u, v = hash_uniforms(f"{seed}:{j}:{i}")
            weights[i, j] = math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * v)
        phases[j] = 2.0 * math.pi * hash_uniforms(f"{seed}:{j}:phase")[0]
    return weights * math.sqrt(2.0 * gamma), phases


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``sqrt(2/D) cos(w_j.x + b_j)`` of a vector column, Arrow batches times one small matrix."""

    size = Param(Params._dummy(), "size", "number of features D", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width; 0: one over the number of inputs", typeConverter=TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the weights", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, gamma=0.0, seed=42):
        super().__init__()
        self._setDefault(size=256, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in (self.size, self.gamma, self.seed))

        @F.pandas_udf("array<double>")
        def features(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            weights, phases = projection(x.shape[1], size, gamma or 1.0 / x.shape[1], seed)
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(x @ weights + phases)))

        return df.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(F.col(self.getInputCol())))))


class PlattScaling(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` = logistic curve of the raw margin (built-in functions)."""

    slope = Param(Params._dummy(), "slope", "slope of the curve", typeConverter=TypeConverters.toFloat)
    offset = Param(Params._dummy(), "offset", "offset of the curve", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, slope=1.0, offset=0.0):
        super().__init__()
        self._setDefault(slope=1.0, offset=0.0)
        self._set(**self._input_kwargs)

    def probability(self, margin) -> F.Column:
        a, b = self.getOrDefault(self.slope), self.getOrDefault(self.offset)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * margin + F.lit(b))))

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.probability(vector_to_array(F.col("rawPrediction"))[1])
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


def fit_platt(margins: DataFrame, margin: str, label: str) -> PlattScaling:
    """Platt's curve over held-out margins.

    Targets are (n1 + 1)/(n1 + 2) for class 1 and 1/(n0 + 2) for class 0; a
    fractional target t is the row once as class 1 with weight t and once as
    class 0 with weight 1 - t, which has the same likelihood.
    """
    y = F.col(label).cast("int")
    n1, n0 = margins.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    target = F.when(y == 1, F.lit((n1 + 1.0) / (n1 + 2.0))).otherwise(F.lit(1.0 / (n0 + 2.0)))
    sides = F.array(F.struct(F.lit(1.0).alias("side"), target.alias("share")),
                    F.struct(F.lit(0.0).alias("side"), (F.lit(1.0) - target).alias("share")))
    rows = margins.filter(y.isin(0, 1)).select(F.col(margin).cast("double").alias("margin"), F.inline(sides))
    curve = Pipeline(stages=[
        VectorAssembler(inputCols=["margin"], outputCol="margins"),
        LogisticRegression(featuresCol="margins", labelCol="side", weightCol="share", regParam=0.0, standardization=False,
                           maxIter=200, tol=1e-12)]).fit(rows).stages[-1]
    return PlattScaling(slope=float(curve.coefficients[0]), offset=float(curve.intercept))


class KernelSVM(Estimator):
    """Standardise, random Fourier features, weighted linear SVM, Platt probabilities.

    ``c`` is the usual penalty: MLlib averages the hinge loss by weight, so its
    regParam is 1 / (c * sum of weights).  ``gamma`` 0 is one over the number of
    inputs (their variance is one after scaling).  ``folds`` models are fitted
    for the held-out margins, then one on all rows.
    """

    def __init__(self, feature_cols: Sequence[str], label: str, weight_col: str | None = "weight", size: int = 256,
                 gamma: float = 0.0, c: float = 1.0, folds: int = 3, max_iter: int = 100, tol: float = 1e-4,
                 seed: int = 42):
        super().__init__()
        self.feature_cols, self.label, self.weight_col = list(feature_cols), label, weight_col
        self.size, self.gamma, self.c, self.folds, self.max_iter, self.seed = size, gamma, c, folds, max_iter, seed
        self.tol = tol

    def _fit(self, df: DataFrame) -> PipelineModel:
        prepared = Pipeline(stages=[
            VectorAssembler(inputCols=self.feature_cols, outputCol="raw_features", handleInvalid="keep"),
            StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
            RandomFourierFeatures(inputCol="scaled", outputCol="features", size=self.size, gamma=self.gamma, seed=self.seed),
        ]).fit(df)
        weight = F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        fold = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in self.feature_cols]), F.lit(self.folds))
        rows = prepared.transform(df).select("features", F.col(self.label).cast("int").alias("y"), weight.alias("w"),
                                             fold.alias("fold"))

        def machine(part: DataFrame):
            total = part.agg(F.sum("w")).first()[0]
            return without_summary(LinearSVC(featuresCol="features", labelCol="y", weightCol="w", standardization=False,
                             maxIter=self.max_iter, tol=self.tol, regParam=1.0 / (self.c * total)).fit(part))

        held = None
        for k in range(self.folds):
            out = machine(rows.filter(F.col("fold") != k)).transform(rows.filter(F.col("fold") == k)).select(
                "y", vector_to_array(F.col("rawPrediction"))[1].alias("margin"))
            held = out if held is None else held.unionByName(out)
        platt = fit_platt(cut_lineage(held), "margin", "y")
        return PipelineModel(stages=[*prepared.stages, machine(rows), platt])


def kernel_svm(feature_cols: Sequence[str], label: str, **settings) -> KernelSVM:
    return KernelSVM(feature_cols, label, **settings)
