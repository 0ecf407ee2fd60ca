"""Complete, right rows: silent files, short lines, header binding, fills, exact large counts."""

import math

import pytest
from pyspark.sql import functions as F

from tracefuse.functions.contracts import SYSCALL_CONTRACT
from tracefuse.operators import metrics, models, prep
from tracefuse.operators.ranking import top_k_per_group
from tracefuse.plans import flows
from tracefuse.sources import readers


def test_top_k_keeps_numbers_before_nan_and_exact_bigints(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, i, nan if i < 3 else float(i)) for i in range(23)], "g int, id int, o double").repartition(4)
    got = top_k_per_group(df, ["g"], ["o", "id"], 4).collect()
    assert sorted(r.id for r in got) == [3, 4, 5, 6]
    desc = top_k_per_group(df, ["g"], ["o", "id"], 4, descending=True).collect()
    assert sorted(r.id for r in desc) == [0, 1, 2, 22]
    big = spark.createDataFrame([(1, 9007199254740993), (1, None), (2, 9007199254740993)], "g int, v bigint")
    got = {(r.g, r.v) for r in top_k_per_group(big, ["g"], ["v"], 2).collect()}
    assert got == {(1, None), (1, 9007199254740993), (2, 9007199254740993)}


def test_csv_binds_by_header_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text("container,start_ts,end_ts,label,more\nredis,1000,1015,1,x\nweb, 7 ,,0,y\nbad,z,1,2,w\n")
    rows = {r.container: tuple(r)[1:] for r in readers.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert rows == {"redis": (1, 1000, 1015), "web": (0, 7, None), "bad": (2, None, 1)}
    (tmp_path / "n.csv").write_text("container,label,start_ts\na,1,2\n")
    with pytest.raises(ValueError, match="end_ts"):
        readers.read_manifest(spark, str(tmp_path / "n.csv"))


def test_tagged_tables_ignore_other_files(spark, tmp_path):
    (tmp_path / "features_N3.csv").write_text("a,b\n1,2\n")
    (tmp_path / "features_full.csv").write_text("b,a\n4,3\n")
    for other in ("raw.csv", "aligned.csv", "features_.csv", "features_x.csv.bak", "old_features_N3.csv"):
        (tmp_path / other).write_text("a,b\n9,9\n")
    got = {tuple(r) for r in readers.read_tagged_tables(spark, str(tmp_path), "a int, b int").collect()}
    assert got == {(1, 2, "N3"), (3, 4, "full")}
    (tmp_path / "none").mkdir()
    assert readers.read_tagged_tables(spark, str(tmp_path / "none"), "a int").count() == 0


def test_short_packet_rows_and_empty_captures(spark, tmp_path):
    (tmp_path / "mal_a_network.tsv").write_text("60\t6\t80\t\t1.0\n60\t6\t80\t1.5\n70\t17\t\t53\t2.0\textra\nx\t6\t\t\ty\n")
    (tmp_path / "b_network.tsv").write_text("")
    (tmp_path / "c_network.tsv").write_text("only\tfour\tfields\there\n")
    (tmp_path / "notes.txt").write_text("1\t2\t3\t4\t5\n")
    lines = spark.read.option("pathGlobFilter", "*.tsv").text(str(tmp_path))
    status = {r.status: r["count"] for r in readers.parse_packets(lines).groupBy("status").count().collect()}
    assert status == {"ok": 3, "short": 2}
    got = {r.file: r for r in flows.network_features(spark, str(tmp_path)).collect()}
    assert set(got) == {"mal_a_network.tsv", "b_network.tsv", "c_network.tsv"}
    a = got["mal_a_network.tsv"]
    assert (a.pkts, a.bytes, a.dport, a.dur, a.label) == (2.0, 130.0, 80.0, 1.0, 1)
    for name in ("b_network.tsv", "c_network.tsv"):
        assert all(v == 0 for k, v in got[name].asDict().items() if k != "file")


def test_packet_order_over_many_splits(spark, tmp_path):
    rows = [f"60\t6\t{'' if i < 5000 else i}\t\t{i}" for i in range(20000)]
    (tmp_path / "x.tsv").write_text("\n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_packets(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 3
        order = [r.t for r in df.orderBy("ordinal").collect()]
        assert order == sorted(order) and flows.network_features(spark, str(tmp_path)).first().dport == 5000.0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_silent_logs_are_rows_of_zeros(spark, tmp_path):
    (tmp_path / "mal_a.log").write_text("open(1)\nread(2)\n")
    (tmp_path / "quiet.log").write_text("--- nothing here ---\n")
    (tmp_path / "empty.log").write_text("")
    feats, _ = flows.strace_features(spark, str(tmp_path), validate=True)
    got = {r.file: r for r in feats.collect()}
    assert set(got) == {"mal_a.log", "quiet.log", "empty.log"}
    assert got["mal_a.log"].total_events == 2.0 and got["mal_a.log"].label == 1
    assert all(got[f][c] == 0.0 for f in ("quiet.log", "empty.log") for c in SYSCALL_CONTRACT)


def test_scores_fill_missing_features_and_strict_class(spark):
    rows = [(i, float(i % 2), i % 2 if i % 10 else 1 - i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y int")
    model = models.logistic_regression(["x"], "y", weight_col=None).fit(df)
    zero = models.score(model, spark.createDataFrame([(1, 0.0, 0)], "id int, x double, y int"), ["id"], "y").first().p
    for probe in (spark.createDataFrame([(1, None, 0)], "id int, x double, y int"),
                  spark.createDataFrame([(1, float("nan"), 0)], "id int, x double, y int"),
                  spark.createDataFrame([(1, 0)], "id int, y int")):
        assert models.score(model, probe, ["id"], "y").first().p == zero
    half = models.score(model, df, ["id"], "y", threshold=zero).filter(F.col("p") == zero)
    strict = models.score(model, df, ["id"], "y", threshold=zero, strict=True).filter(F.col("p") == zero)
    assert {r.pred for r in half.collect()} == {1} and {r.pred for r in strict.collect()} == {0}


def test_weights_keep_unlabelled_rows_and_reach_the_svm(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "id int, y int")
    assert models.balanced_weights(df, "y").count() == 4
    assert models.linear_svm(["x"], "y").getStages()[-1].getWeightCol() == "weight"


def test_auc_of_billions_of_rows_is_exact(spark, monkeypatch):
    n = 3_000_000_000
    groups = spark.createDataFrame([("m", 0.1, 0, n), ("m", 0.5, n, n), ("m", 0.9, 2 * n, 0)],
                                   "model string, score double, pos bigint, neg bigint")
    monkeypatch.setattr(metrics, "_score_groups", lambda *a: groups)
    r = metrics.roc_auc(groups, "y", "score", ["model"]).first()
    assert (r.n_pos, r.n_neg) == (3 * n, 2 * n)
    assert r.roc_auc == (n * (n + n / 2) + 2 * n * 2 * n) / (3 * n * 2 * n)


def test_recommended_window_at_the_boundary(spark):
    rows = [("N3", 1, 0.3999998), ("N3", 0, 0.0), ("full", 1, 0.9), ("full", 0, 0.1)]
    df = spark.createDataFrame(rows, "window_tag string, y int, p double").withColumn("pred", F.col("y"))
    wm = metrics.window_metrics(df, "y", "pred", "p")
    assert {r.window_tag: r.separation for r in wm.collect()}["N3"] == 0.3999998
    assert metrics.recommended_window(wm, {"N3": 3, "full": None}).first().recommended_seconds == 15


def test_syscall_recipe_keeps_rows_and_columns(spark):
    cols = [f"1.0D as `{c}`" for c in SYSCALL_CONTRACT]
    df = spark.range(6).selectExpr("cast(id % 2 as int) as label", "'x' as container", *cols)
    kept = prep.prepare_syscall(df, "label")
    assert len(kept.features) == len(SYSCALL_CONTRACT) and kept.data.count() == 6
    dropped = prep.prepare_training(df, "label")
    assert dropped.features == [] and dropped.data.count() == 2


def test_no_pairs_is_an_error(spark):
    s = spark.createDataFrame([("a", 1, 0.5)], "base string, label int, p_sys double")
    n = spark.createDataFrame([("z", "f", 0.5)], "network_base string, file string, p_net double")
    b = spark.createDataFrame([("a", "q")], "base string, network_base string")
    with pytest.raises(ValueError, match="paired"):
        flows.runtime_detection(s, n, b, ["base"], ["file"])


def test_labelled_concat_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 2)], "v double, k int")
    got = {(r.k, r.s, r.v, r.label) for r in prep.labelled_concat({0: a, 1: b}).collect()}
    assert got == {(1, "x", None, 0), (2, None, 2.5, 1)}


def test_boosting_matches_closed_form(spark):
    df = spark.createDataFrame([(float(i % 2), int(i % 7 < 5) if i % 2 else int(i % 7 < 2)) for i in range(700)], "x double, y int")
    model = models.gradient_boosting(["x"], "y", max_iter=1, max_depth=1).fit(df)
    rate = {r.x: r.r for r in df.groupBy("x").agg(F.avg("y").alias("r")).collect()}
    for r in models.score(model, df, ["x"], "y").distinct().collect():
        assert r.p == pytest.approx(1 / (1 + math.exp(-2 * (2 * rate[r.x] - 1))), abs=1e-12)
