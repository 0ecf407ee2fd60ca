"""Distributed model fitting and scoring with MLlib."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import HasTrainingSummary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.functions.scalar import predict
from tracefuse.operators.forest import Forest, ForestModel
from tracefuse.operators.metrics import confusion, roc_auc, with_rates
from tracefuse.session import cut_lineage


def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """w_c = N / (n_classes * n_c) as a column (L2); class sizes are one row per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    from pyspark.sql import Window
    sizes = sizes.withColumns({"_n": F.sum("_n_c").over(Window.partitionBy()),
                               "_k": F.count(F.lit(1)).over(Window.partitionBy())})
    w = (F.col("_n") / (F.col("_k") * F.col("_n_c"))).alias(weight_col)
    # one row per class (bounded by the number of classes) -> broadcast
    # NULL-safe: rows without a label are a class of their own, as in the split, not lost rows
    sizes = sizes.select(F.col(label).alias("_label"), w)
    return df.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def _assembler(feature_cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="keep")


def standardise(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(x - mean) / population sd`` of every column, as the linear models see it (L1)."""
    n = df.count()
    stages = logistic_regression(cols, "", n_rows=n).getStages()[:-1]
    out = Pipeline(stages=stages).fit(df).transform(df)
    v = vector_to_array(F.col("features"))
    return out.select(*keep, *[v[i].alias(c) for i, c in enumerate(cols)])


def logistic_regression(feature_cols: Sequence[str], label: str, weight_col: str | None = "weight",
                        n_rows: int | None = None, max_iter: int = 1000) -> Pipeline:
    """Standardise then L2 logistic regression (L1, L3).

    C = 1 in the reference objective corresponds to regParam = 1 / sum(weights);
    balanced weights sum to N, so regParam = 1 / N when ``n_rows`` is given.
    MLlib's scaler divides by the sample standard deviation; with ``n_rows``
    a constant factor sqrt(n / (n - 1)) turns that into the population one,
    so the penalty acts on the same scale as in the reference.
    """
    stages = [_assembler(feature_cols, "raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="scaled" if n_rows and n_rows > 1 else "features",
                             withMean=True, withStd=True)]
    if n_rows and n_rows > 1:
        factor = math.sqrt(n_rows / (n_rows - 1))
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(feature_cols)),
                                         inputCol="scaled", outputCol="features"))
    stages.append(LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                                     regParam=(1.0 / n_rows) if n_rows else 0.0, elasticNetParam=0.0,
                                     standardization=False,
                                     **({"weightCol": weight_col} if weight_col else {})))
    return Pipeline(stages=stages)


def random_forest(feature_cols: Sequence[str], label: str, weight_col: str | None = "weight",
                  num_trees: int = 200, max_depth: int = 30, seed: int = 42, bootstrap: bool = True,
                  subset: str = "sqrt") -> Pipeline:
    """Random forest on raw features, sqrt(p) features per split (L4).

    Depth 30 is MLlib's cap, and MLlib merges sibling leaves that predict the
    same class, so a tree's probability there is that of the merged leaf.
    Forests that may not fit the driver are grown and kept by the executors.
    """
    rf = Forest(featuresCol="features", labelCol=label, numTrees=num_trees,
                maxDepth=max_depth, featureSubsetStrategy=subset, seed=seed, bootstrap=bootstrap,
                **({"weightCol": weight_col} if weight_col else {}))
    return Pipeline(stages=[_assembler(feature_cols), rf])


def gradient_boosting(feature_cols: Sequence[str], label: str, max_iter: int = 100,
                      max_depth: int = 3, step: float = 0.1, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees candidate."""
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step, seed=seed)
    return Pipeline(stages=[_assembler(feature_cols), gbt])


def linear_svm(feature_cols: Sequence[str], label: str, max_iter: int = 100,
               weight_col: str | None = "weight") -> Pipeline:
    """Linear SVM candidate on standardised inputs with balanced weights (L6; ``kernel.kernel_svm`` has the RBF kernel)."""
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    svm = LinearSVC(featuresCol="features", labelCol=label, maxIter=max_iter,
                    **({"weightCol": weight_col} if weight_col else {}))
    return Pipeline(stages=[_assembler(feature_cols, "raw_features"), scaler, svm])


def without_summary(model):
    """The model (or pipeline model) without its training summaries.

    A summary holds the session.  MLlib sends it to the tasks with the model,
    which Spark 4.1 cannot do once the session has collected an observation.
    """
    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, HasTrainingSummary) and stage.hasSummary:
            stage._java_obj.setSummary(SparkContext.getOrCreate()._jvm.scala.Option.empty())
    return model


def fill_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every input column of the model: added as 0 where absent, NULL and NaN to 0."""
    present = set(df.columns)
    fills = {}
    for c in model.stages[0].getInputCols():
        v = F.col(f"`{c}`").cast("double") if c in present else F.lit(None).cast("double")
        fills[c] = F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))
    return df.withColumns(fills)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], label: str,
          threshold: float = 0.5, out: str = "p", strict: bool = False) -> DataFrame:
    """Batch scoring: p = P(class 1) and its class (L8): ``p >= t``, or ``p > t`` when ``strict``.

    Missing feature columns and values count as 0.  Models without probabilities (linear SVM) expose the raw margin instead,
    which is rank-equivalent for ROC-AUC.
    """
    filled = fill_features(model, df)
    if isinstance(model.stages[-1], ForestModel):  # its rows are frozen: without the features
        assembled = PipelineModel(stages=model.stages[:-1]).transform(filled)
        scored = model.stages[-1].predict_rows(assembled, list(dict.fromkeys([*keep, label])))
    else:
        scored = without_summary(model).transform(filled)
    if "probability" in scored.columns:
        p = vector_to_array(F.col("probability"))[1]
        pred = predict(p, threshold, strict=strict)
    else:
        p = vector_to_array(F.col("rawPrediction"))[1]
        pred = F.col("prediction").cast("int")
    return scored.select(*keep, F.col(label).cast("int").alias("y"), p.alias(out),
                         pred.alias("pred"))


def evaluate(scored: DataFrame, model_name: str, p: str = "p") -> DataFrame:
    """Metrics row for one scored set: rates + exact ROC-AUC.

    The narrow scored table is frozen once so the confusion counts and the AUC
    do not each re-run the model over the features."""
    # the name is frozen with it: a literal join key would be folded into a nested-loop join
    scored = cut_lineage(scored.withColumn("model", F.lit(model_name)))
    m = with_rates(confusion(scored, "y", "pred", ["model"]))
    auc = roc_auc(scored, "y", p, ["model"]).select("model", "roc_auc")
    return m.join(auc, "model", "left")


def candidate_sweep(train: DataFrame, test: DataFrame, feature_cols: Sequence[str], label: str,
                    candidates: dict[str, Pipeline], keep: Sequence[str] = (),
                    fitted: dict[str, PipelineModel] | None = None) -> DataFrame:
    """Fit every candidate (each fit distributed), score the test split and
    return one metrics row per candidate with fit seconds and ordinal (L7, A17).
    ``fitted`` receives the fitted models by name."""
    spark = train.sparkSession
    rows = None
    for i, (name, pipe) in enumerate(candidates.items()):
        t0 = time.time()
        model = pipe.fit(train)
        fit_s = time.time() - t0
        if fitted is not None:
            fitted[name] = model
        m = evaluate(score(model, test, keep, label), name).withColumns(
            {"ordinal": F.lit(i), "fit_seconds": F.lit(round(fit_s, 3))})
        rows = m if rows is None else rows.unionByName(m)
    return rows


def feature_importance(spark: SparkSession, model: PipelineModel, feature_cols: Sequence[str],
                       k: int = 20) -> DataFrame:
    """Top-k importances (trees) or absolute coefficients (linear).
    The vector lives in the driver-side model already; it has one entry per feature."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
        kind = "importance"
    else:
        vals = [abs(v) for v in last.coefficients.toArray().tolist()]
        kind = "abs_coefficient"
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(feature_cols, vals)],
                               "feature string, value double")
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(kind)).orderBy(F.desc("value"), F.asc("feature"))
    return (df.withColumn("kind", F.lit(kind)).withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k))


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
