"""Edge cases and helpers: empty input, tagged tables, contract assertions, presentation."""

import os
import tempfile

import pytest

from tracefuse.operators import counting as C
from tracefuse.operators import metrics as M
from tracefuse.sources.readers import read_tagged_tables, require_rows


def test_require_rows_raises_on_empty(spark):
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "a int"), "nothing")


def test_tagged_tables(spark):
    d = tempfile.mkdtemp(prefix="tf-tags-")
    for tag, v in (("N3", 1.0), ("full", 2.0)):
        with open(os.path.join(d, f"features_{tag}.csv"), "w") as f:
            f.write(f"label,container,total_events\n0,redis,{v}\n")
    df = read_tagged_tables(spark, d, "label int, container string, total_events double")
    got = {r.window_tag: r.total_events for r in df.collect()}
    assert got == {"N3": 1.0, "full": 2.0}


def test_assert_contract(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    C.assert_contract(df, ["x", "y"], keep=["k"], expected_rows=1)
    with pytest.raises(AssertionError):
        C.assert_contract(df, ["y", "x"], keep=["k"])
    bad = spark.createDataFrame([("a", None, float("nan"))], "k string, x double, y double")
    with pytest.raises(AssertionError):
        C.assert_contract(bad, ["x", "y"], keep=["k"])


def test_allow_list_is_case_sensitive(spark):
    ev = spark.createDataFrame([("redis", "read"), ("Redis", "read"), ("ghost", "read")],
                               "container string, syscall string")
    keys = spark.createDataFrame([("redis",)], "container string")
    assert [r.container for r in C.restrict_to(ev, keys, ["container"]).collect()] == ["redis"]


def test_present_and_reference_delta(spark):
    df = spark.createDataFrame([("m", 0.123456, 3)], "model string, f1 double, n int")
    r = M.present(df, 4).first()
    assert (r.f1, r.n) == (0.1235, 3)
    ref = spark.createDataFrame([("m", 0.9)], "model string, f1 double")
    d = M.reference_delta(ref, df).first()
    assert d.delta == pytest.approx(0.9 - 0.123456)


def test_one_class_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "y int, p int, s double")
    r = M.with_rates(M.confusion(df, "y", "p")).first()
    assert (r.tn, r.fp, r.fpr, r.recall) == (0, 0, 0.0, 0.5)
    sep = M.separation_gap(df, "y", "s").first()
    assert sep.mean_neg == 0.0 and sep.separation == pytest.approx(0.55)
    assert M.separation_gap(df, "y", "s", absent="null").first().separation is None


def test_cluster_settings_scale():
    from tracefuse.session import cluster_settings
    conf = cluster_settings(100 * 1024 ** 4)
    assert conf["spark.sql.shuffle.partitions"] == "200000"  # 409,600 splits of 256 MB, capped
    assert cluster_settings(1024)["spark.sql.shuffle.partitions"] == "8"


def test_join_dimension_size_check(spark):
    from tracefuse.session import has_at_most, join_dimension
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # isolate the explicit check
    try:
        fact = spark.range(1000).withColumnRenamed("id", "k")
        dim = spark.range(50).withColumnRenamed("id", "k")
        assert has_at_most(dim, 50) and not has_at_most(dim, 49)
        small = join_dimension(fact, dim, "k", max_rows=100)._jdf.queryExecution().executedPlan().toString()
        big = join_dimension(fact, dim, "k", max_rows=10)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in small
        assert "BroadcastHashJoin" not in big
        assert join_dimension(fact, dim, "k", max_rows=10).count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
