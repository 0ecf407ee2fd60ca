"""End-to-end flows over files on disk."""

import tempfile

from pyspark.sql import functions as F

from conftest import fixture_path, sf_dir
from tracefuse.functions.contracts import SYSCALL_CONTRACT
from tracefuse.plans import flows, standins
from tracefuse.sources.readers import read_csv, read_tagged_tables


def _write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def test_sysdig_to_window_features(spark):
    d = tempfile.mkdtemp(prefix="tf-e2e-")
    _write(f"{d}/capture.txt", "redis 100 open\nredis 103 read\nredis 120 write\nbad line\n"
                                  "port-scan 50 connect\nport-scan 51 socket\nredis x read\n")
    _write(f"{d}/manifest.csv", "container,label,start_ts,end_ts\nredis,0,100,115\nport-scan,1,50,65\n")
    keys = spark.createDataFrame([("redis", 0), ("port-scan", 1), ("idle", 0)], "container string, label int")
    feats, status = flows.syscall_window_features(spark, f"{d}/capture.txt", f"{d}/manifest.csv", keys,
                                                  validate=True)
    got = {(r.window_tag, r.container): r for r in feats.collect()}
    assert len(got) == 15
    assert got[("N3", "redis")].total_events == 2 and got[("full", "redis")].total_events == 3
    assert got[("N3", "port-scan")].evt_connect == 1 and got[("full", "idle")].total_events == 0
    assert {r.capture_mode for r in got.values()} == {"sysdig"}
    assert {r.status: r.n for r in status.collect()} == {"ok": 5, "short": 1, "bad_time": 1}


def test_strace_and_packets(spark):
    d = tempfile.mkdtemp(prefix="tf-e2e-")
    _write(f"{d}/mal_file.log", "1 0.1 openat(x) = 3\n1 0.2 openat(y) = 4\n1 0.3 renameat(a, b) = 0\n")
    _write(f"{d}/benign_idle.log", "1 0.1 restart_syscall(<...\n")
    feats, drift = flows.strace_features(spark, d, validate=True)
    got = {r.file: r for r in feats.collect()}
    assert got["mal_file.log"].label == 1 and got["mal_file.log"].evt_openat == 2
    assert got["mal_file.log"].total_events == 3  # renameat counted in the total, dropped as a column
    assert got["benign_idle.log"].total_events == 1 and feats.columns[2:] == SYSCALL_CONTRACT
    dropped = {r.feature for r in drift.filter("status = 'dropped'").collect()}
    assert dropped == {"evt_renameat", "evt_restart_syscall"}
    p = tempfile.mkdtemp(prefix="tf-pk-")
    _write(f"{p}/mal_scan_network.tsv", "60\t6\t80\t\t1.0\n70\t17\t\t53\t3.0\n\t\t\t\t\n")
    net = flows.network_features(spark, p).first()
    assert (net.pkts, net.dport, net.proto_tcp, net.proto_udp, net.label) == (2, 80, 1, 1, 1)


def test_synthetic_evaluation_reports(spark):
    probs = read_csv(spark, fixture_path("hybrid_synthetic_probs_test.csv"),
                     "scenario string, y_true int, p_sys double, p_net double")
    rep = flows.synthetic_evaluation(probs)
    m = {r.model: r.f1 for r in rep["metrics"].collect()}
    assert round(m["hybrid"], 4) == 0.8982
    assert rep["thresholds"].filter("tp = 460 and fp = 0").count() == 46


def test_train_detector_and_windows(spark):
    raw = standins.training_rows(spark, sf_dir("0.001"))
    det = flows.train_detector(raw, "label_bin", kind="random_forest", num_trees=10, max_depth=6)
    row = det.metrics.first()
    assert 0.0 <= row.accuracy <= 1.0 and det.importances.count() <= 20
    assert det.overfit.count() == 1


def test_windowed_evaluation_on_shipped_windows(spark):
    from tracefuse.operators import models as MD
    from tracefuse.operators.prep import select_features
    schema = "label int, container string, " + ", ".join(f"`{c}` double" for c in SYSCALL_CONTRACT)
    tagged = read_tagged_tables(spark, fixture_path("windows"), schema)
    assert {r.window_tag for r in tagged.select("window_tag").distinct().collect()} == \
        {"N3", "N5", "N10", "N15", "full"}
    # the shipped per-window tables are generated; total_events is the sum of the
    # counters in every window except N10 (the generator may pick it as a rare column)
    feats = select_features(tagged)
    total = sum((F.col(f"`{c}`") for c in feats if c != "total_events"), F.lit(0.0))
    off = {r.window_tag for r in tagged.filter(F.col("total_events") != total).select("window_tag").collect()}
    assert off <= {"N10"}
    full = tagged.filter("window_tag = 'full'")
    model = MD.random_forest(feats, "label", weight_col=None, num_trees=10, max_depth=4).fit(full)
    ref = spark.createDataFrame([("rf", 0.95)], "model string, f1 double")
    ev = flows.windowed_evaluation(model, tagged, "container", "label", reference=ref)
    rows = {r.window_tag: r for r in ev["metrics"].collect()}
    assert set(rows) == {"N3", "N5", "N10", "N15", "full"}
    assert all(r.tn + r.fp + r.fn + r.tp == 10 for r in rows.values())
    assert ev["recommended"].first().recommended_seconds in (3, 5, 10, 15)
    assert ev["breakdown"].count() == 10
    d = ev["reference_delta"].first()
    assert abs(d.delta - (0.95 - rows["full"].f1)) < 1e-12


def test_detect_from_captures(spark):
    from tracefuse.functions.contracts import NETWORK_CONTRACT
    from tracefuse.operators import models as MD
    sys_schema = "label int, container string, " + ", ".join(f"`{c}` double" for c in SYSCALL_CONTRACT)
    sys_train = read_tagged_tables(spark, fixture_path("windows"), sys_schema).filter("window_tag = 'full'")
    sys_model = MD.random_forest(SYSCALL_CONTRACT, "label", weight_col=None, num_trees=5, max_depth=3).fit(sys_train)
    net_train = spark.read.option("header", True).option("inferSchema", True).csv(
        fixture_path("runtime_network_aligned.csv"))
    net_train = net_train.select("label", *[F.col(f"`{c}`").cast("double").alias(c) for c in NETWORK_CONTRACT])
    net_model = MD.random_forest(NETWORK_CONTRACT, "label", weight_col=None, num_trees=5, max_depth=3).fit(net_train)
    d = tempfile.mkdtemp(prefix="tf-det-")
    _write(f"{d}/capture.txt", "".join(f"redis {100 + i % 10} read\n" for i in range(50)) +
           "".join(f"file-flood {200 + i % 10} write\n" for i in range(500)))
    _write(f"{d}/manifest.csv", "container,label,start_ts,end_ts\nredis,0,100,115\nfile-flood,1,200,215\n")
    pk = tempfile.mkdtemp(prefix="tf-detpk-")
    _write(f"{pk}/benign_web_network.tsv", "".join(f"60\t6\t80\t\t{i}.0\n" for i in range(20)))
    _write(f"{pk}/mal_flood_network.tsv", "".join(f"1400\t17\t\t53\t{i / 100}\n" for i in range(300)))
    keys = spark.createDataFrame([("redis", 0), ("file-flood", 1)], "container string, label int")
    bridge = spark.createDataFrame([("redis", "benign_web"), ("file-flood", "mal_flood"), ("idle", "none")],
                                   "base string, network_base string")
    paired, metrics, unmatched = flows.detect_from_captures(spark, f"{d}/capture.txt", f"{d}/manifest.csv", keys,
                                                            pk, sys_model, net_model, bridge)
    got = {r.base: r for r in paired.collect()}
    assert set(got) == {"redis", "file-flood"} and got["file-flood"].label == 1
    assert all(0.0 <= r.p_sys <= 1.0 and 0.0 <= r.p_net <= 1.0 for r in got.values())
    assert metrics.count() == 3 and [r.missing_side for r in unmatched.collect()] == ["both"]


def test_train_detector_drops_metadata_and_resolves_label(spark):
    raw = standins.training_rows(spark, sf_dir("0.001")).withColumn("id", F.monotonically_increasing_id()) \
        .withColumn("folder", F.lit("f1"))
    det = flows.train_detector(raw, kind="logistic_regression")
    assert "id" not in det.features and "folder" not in det.features
    assert det.metrics.count() == 1


def test_sweep_detectors(spark):
    raw = standins.training_rows(spark, sf_dir("0.001"))
    table, best, model = flows.sweep_detectors(raw, candidates=("logistic_regression", "gradient_boosting"),
                                               gbt_iterations=3)
    rows = {r.model: r for r in table.collect()}
    assert set(rows) == {"logistic_regression", "gradient_boosting"}
    b = best.first()
    assert b.f1 == max(r.f1 for r in rows.values())
    # the winner itself comes back, ready to save
    kinds = {"logistic_regression": "LogisticRegressionModel", "gradient_boosting": "GBTClassificationModel"}
    assert type(model.stages[-1]).__name__ == kinds[b.model]
