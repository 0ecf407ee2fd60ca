"""A hot key holding a third of all rows: results stay exact and whole."""

import random
from collections import Counter

from tracefuse.functions.contracts import SYSCALL_CONTRACT
from tracefuse.operators import counting as C
from tracefuse.operators.flows import packet_features
from tracefuse.operators.pairing import first_per_key

NAMES = ["read", "write", "open", "close", "futex", "mmap", "restart_syscall"]


def _events(n=30000, seed=11):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = "hot" if i % 3 == 0 else f"c{rnd.randint(0, 40)}"
        rows.append((c, 1000 + rnd.randint(-5, 40), rnd.choice(NAMES)))
    return rows


def test_hot_container_windows_exact(spark):
    rows = _events()
    ev = spark.createDataFrame(rows, "container string, ts_s bigint, syscall string").repartition(16)
    manifest = spark.createDataFrame([("hot", 1000)] + [(f"c{i}", 1010) for i in range(0, 40, 2)],
                                     "container string, start_ts bigint")
    mapped = C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT)
    out = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, {"N10": 10, "full": None})
    got = {(r.window_tag, r.container): (r.total_events, r.evt_read, r.evt_openat) for r in out.collect()}
    starts = {"hot": 1000, **{f"c{i}": 1010 for i in range(0, 40, 2)}}
    want = Counter()
    for c, t, s in rows:
        if s == "restart_syscall":
            continue
        for tag, lim in (("N10", 10), ("full", None)):
            if lim is None or t - starts.get(c, 0) <= lim:
                want[(tag, c, "total")] += 1
                want[(tag, c, s)] += 1
    for (tag, c), (tot, rd, op) in got.items():
        assert (tot, rd, op) == (want[(tag, c, "total")], want[(tag, c, "read")], want[(tag, c, "open")])
    assert got[("full", "hot")][0] == sum(1 for c, _, s in rows if c == "hot" and s != "restart_syscall")


def test_hot_key_first_row_and_flows(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, float(rnd.randint(40, 1500)), "6", 80 + i % 7, None,
             float(i)) for i in range(30000)]
    df = spark.createDataFrame(rows, "file string, ordinal bigint, frame_len double, ip_proto string, "
                                     "tcp_dstport int, udp_dstport int, t double").repartition(16)
    first = {r.file: r.ordinal for r in first_per_key(df, ["file"], ["ordinal"], ["ordinal"]).collect()}
    assert first["hot"] == 0 and first["k1"] == 1
    f = {r.file: r for r in packet_features(df).collect()}
    hot = [r for r in rows if r[0] == "hot"]
    assert f["hot"].pkts == len(hot) and f["hot"].bytes == sum(r[2] for r in hot)
    assert f["hot"].dport == 80 and f["hot"].dur == hot[-1][6] - hot[0][6]


def test_salted_manifest_join_matches_plain(spark):
    rows = _events(6000, seed=4)
    ev = spark.createDataFrame(rows, "container string, ts_s bigint, syscall string").repartition(8)
    manifest = spark.createDataFrame([("hot", 1000), ("c3", 1010)], "container string, start_ts bigint")
    mapped = C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT)
    plain = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, {"N10": 10, "full": None})
    salted = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, {"N10": 10, "full": None},
                               salt_buckets=8)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)


def test_pre_aggregated_events_give_same_features(spark):
    rows = _events(5000, seed=8)
    ev = spark.createDataFrame(rows, "container string, ts_s bigint, syscall string")
    rolled = ev.groupBy("container", "ts_s", "syscall").count().withColumnRenamed("count", "w")
    manifest = spark.createDataFrame([("hot", 1000), ("c5", 1012)], "container string, start_ts bigint")
    windows = {"N10": 10, "full": None}
    raw = C.window_features(C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT), manifest,
                            "container", "ts_s", SYSCALL_CONTRACT, windows)
    pre = C.window_features(C.map_syscalls(rolled, "syscall", contract=SYSCALL_CONTRACT), manifest,
                            "container", "ts_s", SYSCALL_CONTRACT, windows, weight_col="w")
    assert sorted(map(tuple, raw.collect()), key=str) == sorted(map(tuple, pre.collect()), key=str)


def test_small_manifest_counts_events_once(spark):
    rows = _events(6000, seed=9)
    ev = spark.createDataFrame(rows, "container string, ts_s bigint, syscall string").repartition(8)
    manifest = spark.createDataFrame([("hot", 1000), ("c3", 1010)], "container string, start_ts bigint")
    keys = spark.createDataFrame([("hot",), ("c3",), ("silent",)], "container string")
    mapped = C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT)
    windows = {"N10": 10, "full": None}
    joined = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, windows, keys=keys)
    small = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, windows, keys=keys,
                              manifest_max_rows=2)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, small.collect()), key=str)
    assert "AS _n#" not in small._jdf.queryExecution().optimizedPlan().toString()
    # one row above the bound: rolled up and joined by shuffle
    over = C.window_features(mapped, manifest, "container", "ts_s", SYSCALL_CONTRACT, windows, manifest_max_rows=1)
    assert "AS _n#" in over._jdf.queryExecution().optimizedPlan().toString()


def test_fits_broadcast_checks_rows_and_bytes(spark):
    from tracefuse.session import fits_broadcast
    df = spark.createDataFrame([("x" * 1000, 1), (None, None)], "k string, v bigint")
    assert fits_broadcast(df, 2) and not fits_broadcast(df, 1)
    assert fits_broadcast(df, 2, max_bytes=1064) and not fits_broadcast(df, 2, max_bytes=1063)
    assert fits_broadcast(df.limit(0), 0)
