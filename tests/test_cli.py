"""Command line jobs on the shipped fixtures."""

import tempfile

import pytest

from conftest import fixture_path
from tracefuse.cli import main


def test_fuse_command_reproduces_runtime_golden(spark):
    d = tempfile.mkdtemp(prefix="tf-cli-")
    with open(f"{d}/bridge.csv", "w") as f:
        f.write("base,network_base\nbenign_proc,benign_web\nbenign_idle,benign_ping\n"
                "benign_loop,benign_nginx\nmal_file,mal_flood\nmal_proc,mal_conn\nmal_rename,mal_scan\n"
                "ghost,benign_web\n")
    main(["fuse", "--syscall", fixture_path("runtime_syscall_predictions.csv"),
          "--network", fixture_path("runtime_network_predictions.csv"),
          "--bridge", f"{d}/bridge.csv", "--out", f"{d}/out"], spark=spark)
    got = {r.base: r.pred_hybrid for r in spark.read.parquet(f"{d}/out/predictions").collect()}
    assert got == {"benign_proc": 0, "benign_idle": 0, "benign_loop": 1, "mal_file": 0,
                   "mal_proc": 1, "mal_rename": 1}
    m = {r.model: r for r in spark.read.parquet(f"{d}/out/metrics").collect()}
    assert m["hybrid"].accuracy == pytest.approx(2 / 3)
    assert [r.missing_side for r in spark.read.parquet(f"{d}/out/unmatched").collect()] == ["syscall"]


def test_evaluate_command(spark):
    d = tempfile.mkdtemp(prefix="tf-cli-")
    main(["evaluate", "--scores", fixture_path("hybrid_synthetic_probs_test.csv"), "--out", d,
          "--format", "csv"], spark=spark)
    m = {r.model: r for r in spark.read.option("header", True).option("inferSchema", True)
         .csv(f"{d}/metrics").collect()}
    assert round(m["hybrid"].f1, 4) == 0.8982 and m["hybrid"].tp == 375


def test_feature_train_and_score_commands(spark):
    from conftest import sf_dir
    from tracefuse.plans import standins
    d = tempfile.mkdtemp(prefix="tf-cli-")
    with open(f"{d}/capture.txt", "w") as f:
        f.write("redis 100 open\nredis 101 read\nport-scan 50 connect\n")
    with open(f"{d}/manifest.csv", "w") as f:
        f.write("container,label,start_ts,end_ts\nredis,0,100,115\nport-scan,1,50,65\n")
    with open(f"{d}/containers.csv", "w") as f:
        f.write("container,label\nredis,0\nport-scan,1\n")
    main(["sysdig-features", "--raw", f"{d}/capture.txt", "--manifest", f"{d}/manifest.csv",
          "--containers", f"{d}/containers.csv", "--out", f"{d}/sys"], spark=spark)
    feats = spark.read.parquet(f"{d}/sys/features")
    assert feats.count() == 10 and feats.filter("window_tag = 'N3' and container = 'redis'").first().evt_read == 1
    import os
    os.makedirs(f"{d}/logs")
    with open(f"{d}/logs/mal_x.log", "w") as f:
        f.write("1 0.1 openat(x) = 3\n")
    main(["strace-features", "--logs", f"{d}/logs", "--out", f"{d}/st"], spark=spark)
    assert spark.read.parquet(f"{d}/st/features").first().evt_openat == 1
    os.makedirs(f"{d}/pk")
    with open(f"{d}/pk/mal_a_network.tsv", "w") as f:
        f.write("60\t6\t80\t\t1.0\n")
    main(["packet-features", "--packets", f"{d}/pk", "--out", f"{d}/net"], spark=spark)
    assert spark.read.parquet(f"{d}/net/features").first().dport == 80
    standins.training_rows(spark, sf_dir("0.001")).write.parquet(f"{d}/train.parquet")
    main(["train", "--table", f"{d}/train.parquet", "--label", "label_bin", "--kind", "logistic_regression",
          "--model-out", f"{d}/model", "--out", f"{d}/tr"], spark=spark)
    assert spark.read.parquet(f"{d}/tr/metrics").count() == 1
    feats_in = spark.read.parquet(f"{d}/train.parquet").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_linenumber", "cast(is_open as int) as is_open",
        "label_bin", "monotonically_increasing_id() as row_id")
    feats_in.write.parquet(f"{d}/score_in.parquet")
    main(["score", "--model", f"{d}/model", "--table", f"{d}/score_in.parquet", "--key", "row_id",
          "--label", "label_bin", "--out", f"{d}/scores"], spark=spark)
    sc = spark.read.parquet(f"{d}/scores")
    assert sc.count() == feats_in.count() and sc.filter("p < 0 or p > 1").count() == 0


def test_sweep_and_window_evaluate_commands(spark):
    import os
    d = tempfile.mkdtemp(prefix="tf-cli-")
    os.makedirs(f"{d}/w")
    for tag, shift in (("N3", 0), ("full", 3)):
        with open(f"{d}/w/features_{tag}.csv", "w") as f:
            f.write("container,evt_read,label,evt_open,total_events\n")
            for i in range(40):
                f.write(f"c{i},{(i % 2) * 5 + i % 3 + shift},{i % 2},{i % 4},{i}\n")
    main(["sweep", "--table", f"{d}/w/features_full.csv", "--recipe", "syscall", "--model-out", f"{d}/m",
          "--candidates", "logistic_regression,linear_svm", "--out", f"{d}/s"], spark=spark)
    table = spark.read.parquet(f"{d}/s/metrics")
    assert {r.model for r in table.collect()} == {"logistic_regression", "linear_svm"}
    assert spark.read.parquet(f"{d}/s/best").count() == 1
    main(["window-evaluate", "--model", f"{d}/m", "--windows", f"{d}/w", "--key", "container", "--label", "label",
          "--out", f"{d}/e"], spark=spark)
    assert {r.window_tag for r in spark.read.parquet(f"{d}/e/metrics").collect()} == {"N3", "full"}
    assert spark.read.parquet(f"{d}/e/breakdown").count() == 40
