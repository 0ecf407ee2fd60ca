"""Property tests: distributed exact operators against brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracefuse.operators.metrics import roc_auc
from tracefuse.operators.ranking import global_rank

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60)


@SETTINGS
@given(rows=rows_st)
def test_auc_property(spark, rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    df = spark.createDataFrame([(y, s / 6) for y, s in rows], "y int, s double")
    got = roc_auc(df, "y", "s").first().roc_auc
    if not pos or not neg:
        assert got is None
    else:
        want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
        assert abs(got - want) < 1e-12


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 10 ** 6)), min_size=1, max_size=80,
                     unique_by=lambda r: r[1]))
def test_rank_property(spark, rows):
    df = spark.createDataFrame(rows, "g int, o int")
    got = {(r.g, r.o): r["rank"] for r in global_rank(df, ["g"], ["o"], n_blocks=3).collect()}
    for g in {g for g, _ in rows}:
        ordered = sorted(o for gg, o in rows if gg == g)
        assert [got[(g, o)] for o in ordered] == list(range(1, len(ordered) + 1))


NAMES = ["read", "open", "accept4", "clone3", "zzz"]
FEAT = {"read": "evt_read", "open": "evt_openat", "accept4": "evt_accept", "clone3": "evt_clone"}


@SETTINGS
@given(events=st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(90, 130),
                                 st.sampled_from(NAMES)), min_size=1, max_size=80),
       starts=st.dictionaries(st.sampled_from(["a", "b"]), st.integers(95, 115)))
def test_window_features_property(spark, events, starts):
    from tracefuse.functions.contracts import SYSCALL_CONTRACT
    from tracefuse.operators import counting as C
    ev = spark.createDataFrame(events, "container string, ts_s bigint, syscall string")
    manifest = spark.createDataFrame(list(starts.items()) or [("none", 0)], "container string, start_ts bigint")
    windows = {"N3": 3, "N10": 10, "full": None}
    out = C.window_features(C.map_syscalls(ev, "syscall", contract=SYSCALL_CONTRACT), manifest,
                            "container", "ts_s", SYSCALL_CONTRACT, windows)
    got = {(r.window_tag, r.container): r for r in out.collect()}
    for tag, lim in windows.items():
        for c in {e[0] for e in events}:
            kept = [s for cc, t, s in events if cc == c and s in FEAT
                    and (lim is None or t - starts.get(c, 0) <= lim)]
            row = got.get((tag, c))
            if not kept:
                assert row is None
                continue
            assert row.total_events == len(kept)
            for name, feat in FEAT.items():
                assert row[feat] == sum(1 for s in kept if s == name)
