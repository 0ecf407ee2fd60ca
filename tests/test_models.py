"""MLlib fitting, scoring, importances and persistence on a small separable set."""

import tempfile

from pyspark.sql import functions as F

from tracefuse.operators import models as MD
from tracefuse.operators.metrics import best_model


def _data(spark, n=200):
    rows = [(i, int(i % 2), float(i % 2) * 2 + (i % 7) / 10, float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, y int, x1 double, x2 double")


def test_lr_rf_scores_and_weights(spark):
    df = MD.balanced_weights(_data(spark), "y")
    w = {r.y: r.weight for r in df.select("y", "weight").distinct().collect()}
    assert w == {0: 1.0, 1: 1.0}
    lr = MD.logistic_regression(["x1", "x2"], "y", n_rows=200, max_iter=50).fit(df)
    s = MD.score(lr, df, ["id"], "y")
    assert s.filter((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
    m = MD.evaluate(s, "lr").first()
    assert m.accuracy == 1.0 and m.roc_auc == 1.0
    rf = MD.random_forest(["x1", "x2"], "y", num_trees=10, max_depth=5).fit(df)
    imp = MD.feature_importance(spark, rf, ["x1", "x2"], k=1).first()
    assert imp.feature == "x1" and imp["rank"] == 1


def test_candidate_sweep_and_best(spark):
    df = MD.balanced_weights(_data(spark), "y")
    cands = {"svm": MD.linear_svm(["x1", "x2"], "y", max_iter=20),
             "gbt": MD.gradient_boosting(["x1", "x2"], "y", max_iter=5)}
    res = MD.candidate_sweep(df, df, ["x1", "x2"], "y", cands, keep=["id"])
    assert res.count() == 2
    assert best_model(res).first().model in {"svm", "gbt"}


def test_save_load_round_trip(spark):
    df = _data(spark)
    m = MD.random_forest(["x1", "x2"], "y", weight_col=None, num_trees=5, max_depth=3).fit(df)
    path = tempfile.mkdtemp(prefix="tf-model-") + "/rf"
    MD.save_model(m, path)
    again = MD.load_model(path)
    a = sorted(r.p for r in MD.score(m, df, ["id"], "y").collect())
    b = sorted(r.p for r in MD.score(again, df, ["id"], "y").collect())
    assert a == b


def test_population_std_scaling(spark):
    rows = [(float(x), int(x > 2)) for x in range(6)]
    df = spark.createDataFrame(rows, "x double, y int")
    pipe = MD.logistic_regression(["x"], "y", weight_col=None, n_rows=6, max_iter=5)
    model = pipe.fit(df)
    scaled = model.stages[2].transform(model.stages[1].transform(model.stages[0].transform(df)))
    vals = sorted(r.features[0] for r in scaled.collect())
    mean = sum(range(6)) / 6
    pop = (sum((x - mean) ** 2 for x in range(6)) / 6) ** 0.5
    assert all(abs(v - (x - mean) / pop) < 1e-9 for v, x in zip(vals, range(6)))
