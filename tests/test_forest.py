"""Forests grown by the executors against MLlib's in the driver, and the queries that fit them."""

import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import functions as F

import __spark_entry__ as E
from tracefuse.operators import forest
from tracefuse.operators import models as MD

COLS = [f"x{i}" for i in range(6)]


def _rows(spark, n=400):
    """Noisy classes over features with few and with many values, one of them constant."""
    x = [((F.col("id") * k + 11) % m / m).alias(c) for c, k, m in zip(COLS, (7, 31, 57, 101, 13, 1), (199, 3, 307, 97, 40, 1))]
    y = ((F.col("id") * 7 % 199 + F.col("id") * 131 % 150) > 170).cast("int").alias("y")
    return MD.balanced_weights(spark.range(n).select("id", y, *x), "y").cache()


@pytest.fixture
def refused(monkeypatch):
    """No forest is fitted in the driver."""
    def fit(self, dataset):
        raise AssertionError("fitted in the driver")
    monkeypatch.setattr(RandomForestClassifier, "_fit", fit)
    monkeypatch.setattr(forest, "DRIVER_NODES", 0)


def _scored(model, df):
    return {r.id: (r.p, r.pred) for r in MD.score(model, df, ["id"], "y").collect()}


@pytest.mark.parametrize("depth, task_rows", [(30, 1 << 18), (30, 60), (4, 60)])
def test_one_tree_without_chance_is_mllibs(spark, monkeypatch, depth, task_rows):
    df = _rows(spark)
    pipe = MD.random_forest(COLS, "y", num_trees=1, max_depth=depth, bootstrap=False, subset="all")
    monkeypatch.setattr(forest, "DRIVER_NODES", 1 << 40)
    theirs = pipe.fit(df)
    monkeypatch.setattr(forest, "DRIVER_NODES", 0)
    monkeypatch.setattr(forest, "TASK_ROWS", task_rows)
    ours = pipe.fit(df)
    assert isinstance(theirs.stages[-1], RandomForestClassificationModel) and isinstance(ours.stages[-1], forest.ForestModel)
    a, b = _scored(theirs, df), _scored(ours, df)
    assert a.keys() == b.keys() and all(abs(a[i][0] - b[i][0]) < 1e-12 and a[i][1] == b[i][1] for i in a)
    assert ours.stages[-1].featureImportances.toArray() == pytest.approx(theirs.stages[-1].featureImportances.toArray(), abs=1e-9)


@pytest.mark.parametrize("task_rows", [1 << 18, 60])
def test_many_trees_are_alike_and_the_same_again(spark, monkeypatch, task_rows):
    df = _rows(spark)
    pipe = MD.random_forest(COLS, "y", num_trees=16, max_depth=30)
    monkeypatch.setattr(forest, "DRIVER_NODES", 1 << 40)
    theirs = _scored(pipe.fit(df), df)
    monkeypatch.setattr(forest, "DRIVER_NODES", 1000)
    monkeypatch.setattr(forest, "TASK_ROWS", task_rows)
    model = pipe.fit(df)
    ours = _scored(model, df)
    assert model.stages[-1].getNumTrees == 16 and len(model.stages[-1].trees_at_once) == (1 if task_rows > 400 else 2)
    assert ours == _scored(pipe.fit(df), df)
    off = [ours[i][0] - theirs[i][0] for i in theirs]
    assert abs(sum(off)) / len(off) < 0.03 and sum(abs(d) for d in off) / len(off) < 0.1
    assert sum(ours[i][1] == theirs[i][1] for i in theirs) > 0.95 * len(off)


def test_bootstrap_counts_are_poisson(spark):
    import numpy as np
    times = np.stack([forest._times(np.arange(20000), t, 42, True) for t in range(5)])
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.05 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(times) - np.eye(5)).max() < 0.03


def test_small_forests_stay_with_mllib(spark):
    model = MD.random_forest(COLS, "y", num_trees=3, max_depth=4).fit(_rows(spark))
    assert isinstance(model.stages[-1], RandomForestClassificationModel)


def test_saved_forest_scores_the_same(spark, refused, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "TASK_ROWS", 120)
    df = _rows(spark)
    model = MD.random_forest(COLS, "y", num_trees=9).fit(df)
    MD.save_model(model, str(tmp_path / "m"))
    again = MD.load_model(str(tmp_path / "m"))
    assert _scored(again, df) == _scored(model, df)
    assert again.stages[-1].featureImportances == model.stages[-1].featureImportances
    assert set(again.transform(df).columns) >= {*df.columns, "rawPrediction", "probability", "prediction"}


@pytest.mark.parametrize("column", ["x0", "y"])
def test_missing_values_are_refused_as_in_mllib(spark, monkeypatch, column):
    df = _rows(spark).withColumn(column, F.when(F.col("id") != 5, F.col(column)))
    for most in (1 << 40, 0):
        monkeypatch.setattr(forest, "DRIVER_NODES", most)
        with pytest.raises(Exception, match="MUST NOT"):
            MD.random_forest(COLS, "y", num_trees=2).fit(df)


@pytest.fixture
def embeddings(spark, tmp_path):
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("id") * 37 + i * F.col("id") % 53) % 101 / 101).cast("float"))
    spark.range(150).select(F.col("id").alias("vec_id"), v.alias("embedding"), (F.col("id") * 7 % 10).cast("int").alias("label")) \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_feature_importance_without_trees_in_the_driver(spark, refused, embeddings):
    rows = E.queries()["feature_importance"](spark, embeddings).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 21)) and all(0 < r.value < 1 for r in rows)


def test_candidate_sweep_without_trees_in_the_driver(spark, refused):
    df, fitted = _rows(spark), {}
    cands = {"random_forest": MD.random_forest(COLS, "y", num_trees=100, max_depth=30), "svm": MD.linear_svm(COLS, "y", max_iter=5)}
    rows = {r.model: r for r in MD.candidate_sweep(df, df, COLS, "y", cands, keep=["id"], fitted=fitted).collect()}
    assert len(rows) == 2 and rows["random_forest"].accuracy > 0.95
    assert isinstance(fitted["random_forest"].stages[-1], forest.ForestModel)


def test_overfit_gap_without_trees_in_the_driver(spark, refused, embeddings):
    row = E.queries()["overfit_gap"](spark, embeddings).collect()[0]
    assert row.train_accuracy > 0.9 and row.gap == row.train_accuracy - row.test_accuracy


def test_rf_scores_without_trees_in_the_driver(spark, refused, embeddings):
    rows = E.queries()["rf_scores"](spark, embeddings).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == 30 and all(0 <= r.p <= 1 and r.pred == int(r.p >= 0.5) for r in rows)
