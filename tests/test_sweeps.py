"""Sweeps: noise-free robustness goldens, threshold grid vs brute force, rule agreement."""

import itertools
import random

from conftest import fixture_path
from tracefuse.functions.fusion import CURRENT_RULE, LEGACY_RULE
from tracefuse.operators.sweeps import (best_thresholds, robustness_sweep, rule_agreement,
                                        threshold_sweep)
from tracefuse.sources.readers import read_csv


def _probs(spark):
    return read_csv(spark, fixture_path("hybrid_synthetic_probs_test.csv"),
                    "scenario string, y_true int, p_sys double, p_net double")


def test_noise_free_robustness_golden(spark):
    got = {r.n_window: (round(r.f1_syscall, 4), round(r.f1_network, 4), round(r.f1_hybrid, 4))
           for r in robustness_sweep(_probs(spark), y="y_true").collect()}
    assert got == {5: (0.7187, 0.8413, 0.8739), 10: (0.7187, 0.8413, 0.934),
                   15: (0.7187, 0.8413, 0.9616), 30: (0.7187, 0.8413, 0.8982)}


def test_noisy_mode_runs(spark):
    rows = robustness_sweep(_probs(spark), y="y_true", noise=True).collect()
    assert len(rows) == 4 and all(0 <= r.f1_hybrid <= 1 for r in rows)


def test_threshold_grid_golden(spark):
    sw = threshold_sweep(_probs(spark), y="y_true")
    assert sw.count() == 21 ** 3
    assert sw.filter("tp = 460 and fp = 0").count() == 46
    best = best_thresholds(sw).first()
    assert (best.tp, best.fp, best.recall) == (460, 0, 1.0)
    assert (best.sys_hi, best.net_hi, best.sys_floor) == (0.55, 0.45, 0.0)


def _brute(rows, steps=4):
    out = {}
    for a, b, f in itertools.product(range(steps + 1), repeat=3):
        ta, tb, tf = a / steps, b / steps, f / steps
        tp = fp = 0
        for y, s, n in rows:
            s_ok = lambda t: s is not None and s >= t
            hit = s_ok(ta) or (n is not None and n >= tb and s_ok(tf))
            tp += int(hit and y == 1)
            fp += int(hit and y == 0)
        out[(ta, tb, tf)] = (tp, fp)
    return out


def test_threshold_sweep_brute_force_with_nulls(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), rnd.choice([None, rnd.randint(0, 8) / 8, rnd.random()]),
             rnd.choice([None, rnd.randint(0, 8) / 8, rnd.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p_sys double, p_net double")
    got = {(r.sys_hi, r.net_hi, r.sys_floor): (r.tp, r.fp) for r in threshold_sweep(df, steps=4).collect()}
    assert got == _brute(rows)


def test_rule_agreement(spark):
    got = {(r.pred_a, r.pred_b): r.n for r in rule_agreement(_probs(spark), rule_a=CURRENT_RULE,
                                                             rule_b=LEGACY_RULE).collect()}
    assert sum(got.values()) == 580
    assert got.get((1, 0), 0) + got.get((1, 1), 0) == 375
    assert got.get((0, 1), 0) + got.get((1, 1), 0) == 390


def test_missing_scores_stay_missing_in_sweep(spark):
    from tracefuse.functions.scalar import clip01
    df = spark.createDataFrame([(1, None, 0.9), (1, float("nan"), 0.9), (0, 1.7, -0.2)],
                               "y int, p_sys double, p_net double")
    got = [(r.a, r.b) for r in df.select(clip01("p_sys").alias("a"), clip01("p_net").alias("b")).collect()]
    assert got == [(None, 0.9), (None, 0.9), (1.0, 0.0)]
    r = {x.n_window: x for x in robustness_sweep(df).collect()}
    # with p_sys missing, neither the syscall branch nor the corroboration can fire
    assert r[30].f1_syscall == 0.0 and r[30].f1_hybrid == 0.0
