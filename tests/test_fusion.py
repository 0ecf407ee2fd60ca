"""Fusion rule: truth table, legacy rule, the 580-row evaluation golden."""

from pyspark.sql import functions as F

from conftest import fixture_path
from tracefuse.functions.fusion import CURRENT_RULE, LEGACY_RULE, fuse, probability_band
from tracefuse.operators.metrics import detector_metrics
from tracefuse.sources.readers import read_csv

PROBS = "scenario string, y_true int, p_sys double, p_net double"

TRUTH = [  # p_sys, p_net, fused, rule
    (0.85, 0.10, 1, "syscall_dominant"),
    (0.05, 0.65, 0, "none"),
    (0.15, 0.65, 1, "network_corroborates"),
    (0.85, 0.65, 1, "syscall_dominant"),
    (0.05, 0.10, 0, "none"),
    (0.55, 0.10, 0, "none"),
    (0.60, 0.00, 1, "syscall_dominant"),
    (0.10, 0.50, 1, "network_corroborates"),
    (float("nan"), 0.99, 0, "none"),
    (None, 0.99, 0, "none"),
    (0.20, float("nan"), 0, "none"),
    (0.20, None, 0, "none"),
]


def test_truth_table(spark):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(TRUTH)],
                               "i int, p_sys double, p_net double")
    got = {r.i: (r.pred_hybrid, r.fired_rule) for r in fuse(df).collect()}
    for i, (_, _, want, rule) in enumerate(TRUTH):
        assert got[i] == (want, rule), (i, TRUTH[i], got[i])


def _probs(spark, name="hybrid_synthetic_probs_test.csv"):
    return read_csv(spark, fixture_path(name), PROBS if "with_preds" not in name else PROBS + ", y_pred int")


def test_evaluation_table_golden(spark):
    df = fuse(_probs(spark))
    m = {r.model: r for r in detector_metrics(df, "y_true", {
        "syscall": "pred_syscall", "network": "pred_network", "hybrid": "pred_hybrid"}).collect()}
    golden = {  # evaluation_table.csv
        "syscall": (0.6517, 1.0, 0.5609, 0.7187, 0.0, 0.4391, 120, 0, 202, 258),
        "network": (0.7828, 1.0, 0.7261, 0.8413, 0.0, 0.2739, 120, 0, 126, 334),
        "hybrid": (0.8534, 1.0, 0.8152, 0.8982, 0.0, 0.1848, 120, 0, 85, 375),
    }
    for name, g in golden.items():
        r = m[name]
        got = tuple(round(x, 4) for x in (r.accuracy, r.precision, r.recall, r.f1, r.fpr, r.fnr))
        assert got == g[:6]
        assert (r.tn, r.fp, r.fn, r.tp) == g[6:]


def test_per_scenario_rules(spark):
    df = fuse(_probs(spark))
    rows = (df.groupBy("scenario").agg(
        F.sum(F.when(F.col("fired_rule") == "syscall_dominant", 1).otherwise(0)).alias("r1"),
        F.sum(F.when(F.col("fired_rule") == "network_corroborates", 1).otherwise(0)).alias("r2"),
        F.sum("pred_hybrid").alias("fused"),
        F.sum(LEGACY_RULE.decide("p_sys", "p_net")).alias("old")).collect())
    got = {r.scenario: (r.r1, r.r2, r.fused, r.old) for r in rows}
    assert got == {"BB": (0, 0, 0, 0), "BM_override": (0, 25, 25, 60),
                   "BM_suppressed": (0, 35, 35, 0), "MB": (101, 0, 101, 120),
                   "MM": (120, 0, 120, 120), "borderline": (0, 94, 94, 90)}


def test_legacy_rule_reproduces_shipped_predictions(spark):
    df = _probs(spark, "hybrid_synthetic_probs_with_preds.csv")
    bad = df.filter(LEGACY_RULE.decide("p_sys", "p_net") != F.col("y_pred")).count()
    assert df.count() == 580 and bad == 0


def test_bands_cover_expected_cases(spark):
    df = spark.createDataFrame([(0.85, 0.1), (0.05, 0.65), (0.15, 0.65), (0.85, 0.65),
                                (0.05, 0.1), (0.05, 0.55), (0.3, 0.2)], "p_sys double, p_net double")
    got = [r.b for r in df.select(probability_band("p_sys", "p_net").alias("b")).collect()]
    assert got == ["A", "B", "C", "D", "E", None, None]


def test_band_cases_on_580_rows(spark):
    from tracefuse.operators.pairing import first_per_key
    df = _probs(spark).coalesce(1).withColumn("ordinal", F.monotonically_increasing_id())
    banded = df.withColumn("band", probability_band("p_sys", "p_net")).filter("band is not null")
    first = first_per_key(banded, ["band"], ["ordinal"], ["p_sys", "p_net"])
    got = {r.band: r.pred for r in first.select("band", CURRENT_RULE.decide("p_sys", "p_net").alias("pred")).collect()}
    assert got == {"A": 1, "B": 0, "C": 1, "D": 1, "E": 0}
