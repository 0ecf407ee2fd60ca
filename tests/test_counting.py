"""Event parsing, alias mapping, counting, detection windows and alignment."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import fixture_path
from tracefuse.functions.contracts import SYSCALL_CONTRACT
from tracefuse.operators import counting as C
from tracefuse.sources.readers import parse_sysdig, read_strace_logs

LINES = ["redis 100 open", "redis 103 read", "redis 104 READ", "redis 99 read", "ghost 100 read",
         "redis 100", "redis 100 restart_syscall", "", "SYSDIG_UNAVAILABLE", "redis x read",
         "redis 100 read extra", "  nginx\t101   accept4  ", "nginx 200 clone3"]


def _events(spark):
    return parse_sysdig(spark.createDataFrame([(x,) for x in LINES], "value string"))


def test_parse_statuses(spark):
    st = {r.status: r["count"] for r in _events(spark).groupBy("status").count().collect()}
    assert st == {"ok": 9, "short": 1, "blank": 1, "sentinel": 1, "bad_time": 1}
    row = _events(spark).filter(F.col("container") == "nginx").orderBy("ts_s").first()
    assert (row.ts_s, row.syscall) == (101, "accept4")


def test_alias_counts_windows_and_declared_keys(spark):
    ev = _events(spark).filter("status = 'ok'")
    keys = spark.createDataFrame([("redis", 0), ("nginx", 0), ("idle", 0)], "container string, label int")
    manifest = spark.createDataFrame([("redis", 100)], "container string, start_ts bigint")  # nginx missing
    mapped = C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT)
    w = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT,
                          {"N3": 3, "full": None}, keys=keys)
    got = {(r.window_tag, r.container): r for r in w.collect()}
    # redis: open->evt_openat (t=100), read at 103 (=N3, kept), READ at 104 (dropped in N3),
    # read at 99 (before start: kept), read extra at 100; restart_syscall and ghost dropped
    assert got[("N3", "redis")].evt_read == 3 and got[("full", "redis")].evt_read == 4
    assert got[("N3", "redis")].evt_openat == 1 and got[("full", "redis")].total_events == 5
    # nginx has no manifest entry -> start 0 -> nothing within N3; alias accept4->accept, clone3->clone
    assert got[("N3", "nginx")].total_events == 0
    assert (got[("full", "nginx")].evt_accept, got[("full", "nginx")].evt_clone) == (1, 1)
    assert got[("full", "idle")].total_events == 0 and len(got) == 6
    assert w.columns[:3] == ["window_tag", "container", "label"] and w.columns[3:] == SYSCALL_CONTRACT


def test_total_modes(spark):
    ev = spark.createDataFrame([("a", "read"), ("a", "read"), ("a", "zzz")], "k string, syscall string")
    long = C.long_counts(C.map_syscalls(ev, "syscall", aliases=None), ["k"])
    con = ["total_events", "evt_read"]
    assert C.widen(long, ["k"], con, total="all").first().total_events == 3
    assert C.widen(long, ["k"], con, total="mapped").first().total_events == 2


def test_alignment_golden(spark):
    raw = spark.read.option("header", True).option("inferSchema", True).csv(fixture_path("runtime_features_raw.csv"))
    gold = spark.read.option("header", True).option("inferSchema", True).csv(fixture_path("runtime_features_aligned.csv"))
    aligned = C.align(raw, SYSCALL_CONTRACT, keep=["file", "label"])
    assert aligned.columns == gold.columns
    a = {r.file: r for r in aligned.collect()}
    for g in gold.collect():
        r = a[g.file]
        assert r.label == g.label
        assert all(float(r[c]) == float(g[c]) for c in SYSCALL_CONTRACT)
    drift = C.column_drift(raw.columns, SYSCALL_CONTRACT, keep=["file", "label"])
    assert sorted(drift["extra"]) == ["evt_WIFEXITED", "evt_dup3", "evt_renameat", "evt_restart_syscall"]


def test_drift_report(spark):
    long = spark.createDataFrame([("a", "evt_read", 3), ("b", "evt_read", 1), ("a", "evt_odd", 2)],
                                 "k string, feature string, n bigint")
    got = {r.feature: (r.status, r.n_keys, r.n_events)
           for r in C.drift_report(long, ["total_events", "evt_read", "evt_write"], key_col="k").collect()}
    assert got == {"evt_read": ("kept", 2, 4), "evt_odd": ("dropped", 1, 2), "evt_write": ("missing", 0, 0)}


def test_strace_directory_scan(spark):
    d = tempfile.mkdtemp(prefix="tf-logs-")
    with open(os.path.join(d, "mal_x.log"), "wb") as f:
        f.write(b"123 0.1 openat(AT_FDCWD, \"/etc\") = 3\n"
                b"123 0.2 read(3, \"\\xff\", 1) = 1\nno call here\n"
                b"123 0.3 --- SIGCHLD {si_signo=SIGCHLD} --- WIFEXITED(s) && x(\n\xff\xfe bad bytes close(3)\n")
    with open(os.path.join(d, "ignored.txt"), "w") as f:
        f.write("write(1)\n")
    got = sorted((r.file, r.syscall) for r in read_strace_logs(spark, d).collect())
    assert got == [("mal_x.log", "WIFEXITED"), ("mal_x.log", "close"), ("mal_x.log", "openat"),
                   ("mal_x.log", "read")]


def test_top_features_and_nonzero(spark):
    long = spark.createDataFrame([("a", "f1", 5), ("a", "f2", 5), ("a", "f3", 1), ("b", "f1", 0)],
                                 "k string, feature string, n bigint")
    top = [(r.feature, r.n) for r in C.top_features(long, ["k"], k=3).filter("k = 'a'").orderBy("rank").collect()]
    assert top == [("total_events", 11), ("f1", 5), ("f2", 5)]
    nz = {r.k: r.nonzero_features for r in C.nonzero_features(long, ["k"]).collect()}
    assert nz == {"a": 4, "b": 0}
