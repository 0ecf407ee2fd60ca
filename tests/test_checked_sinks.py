"""Whole-table replacement, recovery, checks in the writing pass, file inventory and preview."""

import os

import pytest
from pyspark.sql import functions as F

from tracefuse.functions.contracts import SYSCALL_CONTRACT
from tracefuse.plans import flows
from tracefuse.session import hadoop_path, scratch_folder
from tracefuse.sources import readers
from tracefuse.sources.sinks import CheckedWrite, contract_counts, recover_table, write_table


def _names(folder):
    return sorted(os.listdir(folder))


def test_failing_job_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "report")
    write_table(spark.range(5), path)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("stop"))).alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_table(broken, path)
    assert spark.read.parquet(path).count() == 5 and _names(tmp_path) == ["report"]
    # the old table may be read while its replacement is written
    write_table(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 3 and _names(tmp_path) == ["report"]


def test_stopped_swap_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(3), str(tmp_path / ".t.old-1"))
    write_table(spark.range(4), str(tmp_path / ".t.new-2"))
    spark.range(9).write.parquet(str(tmp_path / ".t.new-3"))
    os.remove(tmp_path / ".t.new-3" / "_SUCCESS")  # never became complete
    assert recover_table(spark, path) and spark.read.parquet(path).count() == 4
    assert not recover_table(spark, path)
    os.rename(path, tmp_path / ".gone")
    assert recover_table(spark, path) and spark.read.parquet(path).count() == 3


def _executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def _capture(tmp_path, lines):
    (tmp_path / "raw.txt").write_text("".join(f"{x}\n" for x in lines))
    (tmp_path / "manifest.csv").write_text("container,label,start_ts,end_ts\na,0,100,200\nb,1,100,200\n")
    return str(tmp_path / "raw.txt"), str(tmp_path / "manifest.csv")


def test_one_pass_writes_and_checks(spark, tmp_path):
    raw, manifest = _capture(tmp_path, ["a 101 open", "a 102 read", "b 104 OPENAT more", "", "SYSDIG_UNAVAILABLE x", "a 1", "b x read"])
    who = spark.createDataFrame([("a", 0), ("b", 1), ("c", 0)], "container string, label int")
    before = _executions(spark)
    status = flows.write_syscall_features(spark, raw, manifest, who, str(tmp_path / "out"))
    used = _executions(spark) - before
    assert used <= 4  # the manifest's header and size check, the write command and its query
    assert {r.status: r.n for r in status.collect()} == {"ok": 3, "blank": 1, "sentinel": 1, "short": 1, "bad_time": 1}
    got = spark.read.parquet(str(tmp_path / "out"))
    feats, lines = flows.syscall_window_features(spark, raw, manifest, who, validate=True)
    cols = ["window_tag", "container", "label", "capture_mode", *SYSCALL_CONTRACT]
    assert sorted(map(str, got.select(*[f"`{c}`" for c in cols]).collect())) == sorted(map(str, feats.select(*[f"`{c}`" for c in cols]).collect()))
    assert {r.status: r.n for r in lines.collect()} == {r.status: r.n for r in status.collect()}


def test_models_score_after_observed_writes(spark, tmp_path):
    from tracefuse.operators import kernel, models
    w = CheckedWrite()
    w.write(w.observe(spark.range(3), "n", rows=F.count(F.lit(1))), str(tmp_path / "t"))
    df = spark.createDataFrame([(i, float(i % 2), i % 2 if i % 10 else 1 - i % 2) for i in range(60)], "id int, x double, y int")
    for pipe in (models.logistic_regression(["x"], "y", weight_col=None, max_iter=5),
                 models.random_forest(["x"], "y", weight_col=None, num_trees=2, max_depth=2),
                 models.linear_svm(["x"], "y", weight_col=None, max_iter=3),
                 kernel.kernel_svm(["x"], "y", weight_col=None, size=8, folds=2, max_iter=3)):
        assert models.score(pipe.fit(df), df, ["id"], "y").count() == 60
        models.score(pipe.fit(df), df, ["id"], "y").collect()


def test_checks_raise_and_keep_the_old_table(spark, tmp_path):
    raw, manifest = _capture(tmp_path, ["a 101 open"])
    who = spark.createDataFrame([("a", 0)], "container string, label int")
    out = str(tmp_path / "out")
    flows.write_syscall_features(spark, raw, manifest, who, out)
    empty = tmp_path / "empty"
    empty.mkdir()
    bad_raw, _ = _capture(empty, ["SYSDIG_UNAVAILABLE"])
    with pytest.raises(ValueError, match="no rows found"):
        flows.write_syscall_features(spark, bad_raw, manifest, who, out)
    twice = spark.createDataFrame([("a", 0), ("a", 0)], "container string, label int")
    w = CheckedWrite()
    df = w.observe(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), "f", **contract_counts(["x"]))
    w.require(lambda n: f"{n['f']['bad']} NULL/NaN" if n["f"]["bad"] else None, AssertionError)
    with pytest.raises(AssertionError, match="2 NULL/NaN"):
        w.write(df, out)
    assert w.counts["f"] == {"rows": 3, "bad": 2}
    assert spark.read.parquet(out).filter("window_tag = 'full'").first().evt_openat == 1.0
    assert twice.count() == 2 and not [n for n in _names(tmp_path) if n.startswith(".out")]


def test_inventory_order_and_preview(spark, tmp_path):
    for name, body in (("b.log", "x(1)\n"), ("a b%20.log", ""), ("c d+%20é.log", "open(1)\n"), ("Z.log", "read(2)\nopen(1)\n"), ("skip.txt", "no")):
        (tmp_path / name).write_text(body)
    files = readers.file_inventory(spark, str(tmp_path), "*.log")
    got = [(r.place, r.file, r.bytes) for r in readers.in_order(files, ["file"]).orderBy("place").collect()]
    assert got == [(1, "Z.log", 16), (2, "a b%20.log", 0), (3, "b.log", 5), (4, "c d+%20é.log", 8)]
    assert [r.file for r in readers.preview(files, ["file"], 2).collect()] == ["Z.log", "a b%20.log"]
    assert {r.file for r in readers.read_strace_logs(spark, str(tmp_path)).collect()} == {"Z.log", "b.log", "c d+%20é.log"}
    assert readers.file_inventory(spark, str(tmp_path), "*.none").count() == 0


def test_scratch_folder_is_removed(spark):
    with scratch_folder(spark, "x") as path:
        spark.range(2).write.parquet(path)
        fs, at = hadoop_path(spark, path)
        assert fs.exists(at)
    assert not fs.exists(at)
