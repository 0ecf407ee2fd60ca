"""Bridge pairing: the six-container runtime golden and skew-safe first-per-key."""

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from tracefuse.functions.scalar import base_name
from tracefuse.operators.metrics import detector_metrics
from tracefuse.operators.pairing import first_per_key, pair_predictions, unmatched_pairs

# FIXED VALUES: the runtime bridge between syscall containers and captures.
BRIDGE = [("benign_proc", "benign_web"), ("benign_idle", "benign_ping"),
          ("benign_loop", "benign_nginx"), ("mal_file", "mal_flood"),
          ("mal_proc", "mal_conn"), ("mal_rename", "mal_scan")]


def _inputs(spark):
    sysp = (spark.read.option("header", True).schema("file string, label int, pred int, p_sys double")
            .csv(fixture_path("runtime_syscall_predictions.csv")))
    netp = spark.read.option("header", True).option("inferSchema", True).csv(
        fixture_path("runtime_network_predictions.csv"))
    s = sysp.select(base_name("file", (".log",)).alias("base"), "file", "label", "p_sys")
    n = netp.select(base_name("file", ("_network.pcap", ".pcap")).alias("network_base"), "file",
                    F.col("p_net").cast("double").alias("p_net"))
    b = spark.createDataFrame(BRIDGE, "base string, network_base string")
    return s, n, b


def test_runtime_hybrid_golden(spark):
    s, n, b = _inputs(spark)
    got = {r.base: r for r in pair_predictions(s, n, b, sys_order=["file"], net_order=["file"],
                                                bridge_max_rows=1000).collect()}
    gold = (spark.read.option("header", True).option("inferSchema", True)
            .csv(fixture_path("runtime_hybrid_predictions.csv")).collect())
    assert len(got) == len(gold) == 6
    for g in gold:
        r = got[g.base]
        assert r.network_base == g.network_base and r.label == g.label
        assert r.p_sys == pytest.approx(g.p_sys, abs=1e-12) and r.p_net == pytest.approx(g.p_net, abs=1e-12)
        assert (r.pred_syscall, r.pred_network, r.pred_hybrid) == (g.pred_syscall, g.pred_network, g.pred_hybrid)


def test_runtime_metrics_golden(spark):
    s, n, b = _inputs(spark)
    paired = pair_predictions(s, n, b, sys_order=["file"], net_order=["file"])
    m = {r.model: r for r in detector_metrics(paired, "label", {
        "syscall": "pred_syscall", "network": "pred_network", "hybrid": "pred_hybrid"}).collect()}
    assert m["syscall"].accuracy == pytest.approx(2 / 3) and m["syscall"].fpr == pytest.approx(1 / 3)
    assert (m["network"].accuracy, m["network"].recall, m["network"].fnr) == (0.5, 0.0, 1.0)
    assert (m["hybrid"].fp, m["hybrid"].fn) == (1, 1)


def test_unmatched_pairs(spark):
    s, n, b = _inputs(spark)
    extra = spark.createDataFrame([("ghost", "benign_web"), ("benign_proc", "nowhere"), ("x", "y")],
                                  "base string, network_base string")
    got = {(r.base, r.network_base): r.missing_side for r in unmatched_pairs(s, n, b.unionByName(extra)).collect()}
    assert got == {("ghost", "benign_web"): "syscall", ("benign_proc", "nowhere"): "network",
                   ("x", "y"): "both"}


def test_first_per_key_hot_key(spark):
    rows = [("hot", i, float(i)) for i in range(5000, 0, -1)] + [("cold", 7, 0.7)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(8)
    got = {r.k: (r.o, r.v) for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {"hot": (1, 1.0), "cold": (7, 0.7)}
