"""Metrics: exact AUC, ROC points, separation, class report, window recommendation."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from tracefuse.operators import metrics as M
from tracefuse.sources.readers import read_csv


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_network_rf_golden(spark):
    df = read_csv(spark, fixture_path("network_synthetic_validation.csv"),
                  "label_bin int, pred int, p_net double")
    df = df.withColumn("p05", (F.col("p_net") >= 0.5).cast("int"))
    c = M.with_rates(M.confusion(df, "label_bin", "p05")).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (458, 42, 45, 455)
    assert round(c.accuracy, 3) == 0.913 and round(c.f1, 6) == 0.912738
    auc = M.roc_auc(df, "label_bin", "p_net").first()
    assert round(auc.roc_auc, 6) == 0.972244


def test_580_row_auc_and_separation(spark):
    df = read_csv(spark, fixture_path("hybrid_synthetic_probs_test.csv"),
                  "scenario string, y_true int, p_sys double, p_net double")
    st = df.select("y_true", "p_sys", "p_net").unpivot(["y_true"], ["p_sys", "p_net"], "model", "score")
    auc = {r.model: round(r.roc_auc, 6) for r in M.roc_auc(st, "y_true", "score", ["model"]).collect()}
    sep = {r.model: round(r.separation, 6) for r in M.separation_gap(st, "y_true", "score", ["model"]).collect()}
    assert auc == {"p_sys": 0.904855, "p_net": 0.898116}
    assert sep == {"p_sys": 0.441444, "p_net": 0.50285}


def test_auc_matches_brute_force_with_ties(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 12) / 12) for _ in range(300)] + [(1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "y int, s double")
    got = M.roc_auc(df, "y", "s").first().roc_auc
    clean = [(y, s) for y, s in rows if s is not None and s == s]
    assert got == pytest.approx(brute_auc(clean), abs=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert M.roc_auc(df, "y", "s").first().roc_auc is None


def test_roc_points_brute_force(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    pts = sorted((r.fpr, r.tpr) for r in M.roc_points(df, "y", "s", drop_intermediate=False).collect())
    thresholds = sorted({s for _, s in rows}, reverse=True)
    want = [(0.0, 0.0)]
    for t in thresholds:
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        want.append((fp / 3, tp / 3))
    assert pts == sorted(want)


def test_class_report_and_distribution(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)], "y int, p int")
    rep = {r.class_name: r for r in M.class_report(df, "y", {"m": "p"}).collect()}
    assert rep["1"].precision == pytest.approx(2 / 3) and rep["1"].recall == pytest.approx(2 / 3)
    assert rep["0"].support == 3 and rep["weighted avg"].support == 6
    assert rep["accuracy"].f1 == pytest.approx(4 / 6) and rep["accuracy"].precision is None
    dist = {r.label: (r.n, r.share) for r in M.class_distribution(df, "y").collect()}
    assert dist == {0: (3, 0.5), 1: (3, 0.5)}


def test_zero_division_rates(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = M.with_rates(M.confusion(df, "y", "p")).first()
    assert (r.precision, r.recall, r.f1, r.fnr, r.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def test_recommended_window(spark):
    m = spark.createDataFrame([("N3", 0.6, 0.5), ("N5", 0.75, 0.45), ("N10", 0.9, 0.6), ("full", 0.95, 0.7)],
                              "window_tag string, f1 double, separation double")
    secs = {"N3": 3, "N5": 5, "N10": 10, "N15": 15, "full": None}
    assert M.recommended_window(m, secs).first()[0] == 5
    none = m.withColumn("f1", F.lit(0.1))
    assert M.recommended_window(none, secs).first()[0] == 15


def test_row_breakdown_and_summary(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 1, 0), ("c", 1, 1)], "k string, y int, p int")
    rows = {r.k: r for r in M.row_breakdown(df, ["k"], "y", "p").collect()}
    assert (rows["a"].fp, rows["a"].fn, rows["a"].verdict) == (1, 0, "MALICIOUS")
    assert (rows["b"].fn, rows["b"].true_label, rows["b"].predicted) == (1, "Malicious", "Benign")
    s = M.accuracy_summary(df, "y", "p").first()
    assert (s.correct, s.total) == (1, 3) and s.accuracy_pct == pytest.approx(100 / 3)


def test_roc_points_drop_intermediate(spark):
    # groups (desc): 0.9 (1,0), 0.8 (1,0), 0.7 (1,0), 0.2 (0,1), 0.1 (0,1): equal steps are thinned
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.2), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = sorted((r.threshold is None, r.threshold, r.fpr, r.tpr) for r in M.roc_points(df, "y", "s").collect())
    kept = sorted(t for n, t, _, _ in got if not n)
    assert kept == [0.1, 0.7, 0.9]  # second differences: only 0.7 changes the step


def test_shipped_validation_confusions(spark):
    net = read_csv(spark, fixture_path("network_validation.csv"), "label_bin int, pred int, p_net double")
    c = M.confusion(net, "label_bin", "pred").first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1380, 3, 0, 1470)
    assert round(M.with_rates(M.confusion(net, "label_bin", "pred")).first().accuracy, 5) == 0.99895
    sysv = read_csv(spark, fixture_path("syscall_synthetic_validation.csv"), "label int, pred int, p_sys double")
    c = M.confusion(sysv, "label", "pred").first()
    assert (c.tn, c.fp, c.fn, c.tp) == (50, 0, 0, 50)


def test_null_group_in_roc_and_window_metrics(spark):
    rows = [(None, 1, 0.9), (None, 0, 0.2), (None, 1, 0.4), ("w", 1, 0.8), ("w", 0, 0.1)]
    df = spark.createDataFrame(rows, "window_tag string, y int, p double").withColumn(
        "pred", (F.col("p") >= 0.5).cast("int"))
    pts = M.roc_points(df, "y", "p", ["window_tag"])
    assert pts.filter("window_tag is null").count() == 1 + 3
    wm = {r.window_tag: r for r in M.window_metrics(df, "y", "pred", "p").collect()}
    assert wm[None].roc_auc == 1.0 and wm["w"].roc_auc == 1.0


def test_auc_by_digits_equals_pair_count(spark):
    """Negative, tiny, huge, infinite and signed-zero scores; NULL groups; many ties."""
    import itertools
    import random
    from tracefuse.operators.metrics import roc_auc
    rnd = random.Random(12)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 0.1, 0.1 + 2**-56, 0.5, 1.0, -1.0]
    rows = [(rnd.choice(["a", None]), rnd.randint(0, 1), rnd.choice(odd) if rnd.random() < 0.5 else rnd.gauss(0, 1)) for _ in range(500)]
    rows += [("one", 1, 0.3), ("a", 1, None), ("a", 0, float("nan")), ("a", None, 0.2)]
    got = {r.g: r for r in roc_auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    for g in ("a", None):
        pos = [s for k, y, s in rows if k == g and y == 1 and s is not None and s == s]
        neg = [s for k, y, s in rows if k == g and y == 0 and s is not None and s == s]
        u2 = sum(2 * (p > n) + (p == n) for p, n in itertools.product(pos, neg))
        assert (got[g].n_pos, got[g].n_neg) == (len(pos), len(neg)) and got[g].roc_auc == u2 / (2 * len(pos) * len(neg))
    assert got["one"].roc_auc is None
    plan = roc_auc(spark.range(9).selectExpr("cast(id % 2 as int) y", "id / 9 as s"), "y", "s")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
