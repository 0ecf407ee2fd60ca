"""RBF-kernel SVM: kernel approximation, probabilities, persistence; counter-based noise."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tracefuse.functions.scalar import hash_normal, hash_uniform
from tracefuse.operators import kernel, models
from tracefuse.operators.sweeps import robustness_sweep


def _vectors(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    return df.select("id", array_to_vector("v").alias("x")).repartition(3)


def test_features_approximate_the_kernel(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(40, 5))
    for gamma in (0.05, 0.2):
        out = kernel.RandomFourierFeatures(inputCol="x", outputCol="z", size=4096, gamma=gamma).transform(_vectors(spark, x))
        z = np.array([r.z for r in out.orderBy("id").select(vector_to_array("z").alias("z")).collect()])
        exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        # standard deviation below 1/sqrt(4096) = 0.016: five of them
        assert np.abs(z @ z.T - exact).max() < 0.08


def _rings(spark, n=600):
    rnd = np.random.default_rng(2)
    angle, y = rnd.uniform(0, 2 * math.pi, n), np.arange(n) % 2
    radius = 1.0 + 1.5 * y + rnd.normal(scale=0.15, size=n)
    rows = [(i, float(r * math.cos(a)), float(r * math.sin(a)), int(c)) for i, (r, a, c) in enumerate(zip(radius, angle, y))]
    return models.balanced_weights(spark.createDataFrame(rows, "id int, a double, b double, y int"), "y")


def test_rings_and_round_trip(spark, tmp_path):
    df = _rings(spark)
    model = kernel.kernel_svm(["a", "b"], "y", size=128, folds=2).fit(df)
    scored = models.score(model, df, ["id"], "y")
    m = models.evaluate(scored, "kernel").first()
    linear = models.evaluate(models.score(models.linear_svm(["a", "b"], "y").fit(df), df, ["id"], "y"), "linear").first()
    assert m.roc_auc > 0.99 and m.accuracy > 0.97 and linear.roc_auc < 0.7
    assert scored.filter("p < 0 or p > 1 or p is null").count() == 0
    models.save_model(model, str(tmp_path / "m"))
    again = models.score(models.load_model(str(tmp_path / "m")), df, ["id"], "y")
    assert sorted(r.p for r in again.collect()) == sorted(r.p for r in scored.collect())


def test_platt_is_the_maximum_likelihood_curve(spark):
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=400)
    y = (rnd.uniform(size=400) < 1 / (1 + np.exp(-(1.7 * m - 0.4)))).astype(int)
    curve = kernel.fit_platt(spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "m double, y int"), "m", "y")
    a, b = curve.getOrDefault(curve.slope), curve.getOrDefault(curve.offset)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    gap = 1 / (1 + np.exp(-(a * m + b))) - t
    assert abs(gap.sum()) < 1e-4 and abs((gap * m).sum()) < 1e-4  # the gradient is zero
    assert a == pytest.approx(1.7, abs=0.5)


def test_hash_numbers(spark):
    rows = spark.range(20000).select(hash_uniform(F.col("id").cast("string")).alias("u"), hash_normal(F.col("id").cast("string")).alias("z"))
    s = rows.agg(F.avg("u").alias("u"), F.avg("z").alias("z"), F.stddev("z").alias("sd"), F.avg((F.abs("z") < 1).cast("int")).alias("in1")).first()
    assert s.u == pytest.approx(0.5, abs=0.01) and s.z == pytest.approx(0, abs=0.03)
    assert s.sd == pytest.approx(1, abs=0.02) and s.in1 == pytest.approx(0.6827, abs=0.01)
    got = [r[0] for r in spark.range(5).select(hash_uniform(F.col("id").cast("string"))).collect()]
    assert got == [kernel.hash_uniforms(str(i))[0] for i in range(5)]


def test_noise_does_not_follow_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 > 0).cast("int").alias("y"), (F.col("id") * 7919 % 1000 / 1000).alias("p_sys"),
                                  (F.col("id") * 104729 % 1000 / 1000).alias("p_net"))
    runs = []
    for d in (df.repartition(1), df.repartition(7, "p_sys"), df.orderBy(F.desc("id"))):
        for key in ("id", None):
            runs.append((key, sorted(robustness_sweep(d, noise=True, key=key).collect())))
    assert len({str(r) for k, r in runs if k}) == 1 and len({str(r) for k, r in runs if not k}) == 1
    plain = sorted(robustness_sweep(df).collect())
    noisy = runs[0][1]
    assert plain != noisy and plain[-1] == noisy[-1]  # at scale 1 there is no noise
    other = sorted(robustness_sweep(df, noise=True, key="id", seed=43).collect())
    assert other != noisy


def test_wide_grid(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 500).alias("p_sys"), ((500 - F.col("id")) / 500).alias("p_net"))
    grid = [(i, 0.25 + i / 100) for i in range(27)]
    got = {r.n_window: r for r in robustness_sweep(df, grid=grid).collect()}
    assert set(got) == set(range(27))
    for i in (0, 19, 20, 26):
        assert robustness_sweep(df, grid=[grid[i]]).first() == got[i]
