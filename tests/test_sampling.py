"""Exact ranks, splits and per-class samples against brute force."""

import random

from pyspark.sql import functions as F

from tracefuse.operators.ranking import global_rank, running_sums, top_k_per_group
from tracefuse.operators.sampling import (pair_within_label, rebalance_classes, sample_per_class,
                                          stratified_split)


def _rows(n=2000, hot=0.7, seed=1):
    rnd = random.Random(seed)
    return [(i, 1 if rnd.random() < hot else 0, rnd.randint(0, 10 ** 6)) for i in range(n)]


def test_global_rank_matches_sort(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, y int, h int")
    got = {r.id: r["rank"] for r in global_rank(df, ["y"], ["h", "id"], n_blocks=7).collect()}
    for y in (0, 1):
        ordered = sorted((r for r in rows if r[1] == y), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_running_sums_descending(spark):
    df = spark.createDataFrame([(s / 10, 1) for s in range(10)], "s double, v int")
    got = {r.s: r.cum_v for r in running_sums(df.withColumn("g", F.lit(0)), ["g"], ["s"], ["v"],
                                               descending=True, n_blocks=3).collect()}
    assert got == {s / 10: 10 - s for s in range(10)}


def test_stratified_split_proportions(spark):
    df = spark.createDataFrame(_rows(), "id int, y int, h int")
    out = stratified_split(df, "y", ["h", "id"], 0.2)
    sizes = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    n1 = sizes[(1, "test")] + sizes[(1, "train")]
    n0 = sizes[(0, "test")] + sizes[(0, "train")]
    assert sizes[(1, "test")] == round(0.2 * n1) and sizes[(0, "test")] == round(0.2 * n0)


def test_sample_per_class_is_first_k(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, y int, h int").repartition(5)
    got = sorted((r.y, r["rank"], r.id) for r in sample_per_class(df, "y", ["h", "id"], 15).collect())
    want = []
    for y in (0, 1):
        ordered = sorted((r for r in rows if r[1] == y), key=lambda r: (r[2], r[0]))[:15]
        want += [(y, i + 1, r[0]) for i, r in enumerate(ordered)]
    assert got == sorted(want)


def test_rebalance_and_pairing(spark):
    df = spark.createDataFrame(_rows(), "id int, y int, h int")
    reb = rebalance_classes(df, "y", ["h", "id"])
    counts = {r.y: r["count"] for r in reb.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    splits = {r.split for r in reb.select("split").distinct().collect()}
    assert splits == {"train", "validation", "test"}
    right = spark.createDataFrame([(i, i % 2, i * 7 % 13) for i in range(50)], "vid int, y int, h2 int")
    paired = pair_within_label(df, right, "y", ["h", "id"], ["h2", "vid"])
    assert paired.count() == 50 and paired.select("y", "rank").distinct().count() == 50


def test_top_k_empty_partitions(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "g int, o int").repartition(6)
    got = sorted((r.g, r.o) for r in top_k_per_group(df, ["g"], ["o"], 1).collect())
    assert got == [(1, 3), (2, 9)]


def test_global_rank_default_blocks_under_aqe(spark):
    rows = _rows(3000, seed=5)
    df = spark.createDataFrame(rows, "id int, y int, h int").repartition(6)
    got = {r.id: r["rank"] for r in global_rank(df, ["y"], ["h", "id"]).collect()}
    for y in (0, 1):
        ordered = sorted((r for r in rows if r[1] == y), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_top_k_null_order_matches_spark(spark):
    rows = [(1, None, i) for i in range(3)] + [(1, float(v), 10 + v) for v in range(20)]
    df = spark.createDataFrame(rows, "g int, o double, id int").repartition(4)
    got = sorted(r.id for r in top_k_per_group(df, ["g"], ["o", "id"], 4).collect())
    assert got == [0, 1, 2, 10]  # NULLs first in ascending order, as Spark orders them


def test_null_label_rows_are_kept(spark):
    rows = [(i, None if i % 5 == 0 else i % 2, i * 7 % 101) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, y int, h int")
    out = stratified_split(df, "y", ["h", "id"], 0.2)
    assert out.count() == 100
    assert out.filter("y is null and split = 'test'").count() == 4  # round(0.2 * 20)


def test_split_by_key_matches_the_ranked_split_and_keeps_copies_together(spark):
    from tracefuse.operators.sampling import split_by_key, stratified_split
    df = spark.createDataFrame([(i, (i * 7919) % 10007, None if i % 11 == 0 else i % 3) for i in range(500)],
                               "id int, h int, y int").repartition(5)
    want = {r.id: r.split for r in stratified_split(df, "y", ["h"], 0.2).collect()}
    assert {r.id: r.split for r in split_by_key(df, "y", "h", 0.2).collect()} == want
    copies = df.withColumn("h", F.when(F.col("y") == 1, F.col("id") % 4).otherwise(F.col("h")))
    got = split_by_key(copies, "y", "h", 0.2).collect()
    assert len(got) == 500
    sides = {}
    for r in got:
        sides.setdefault((r.y, r.h), set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert {r.split for r in split_by_key(df, "y", "h", 0.0).collect()} == {"train"}


def test_running_sums_next_and_totals(spark):
    from tracefuse.operators.ranking import running_sums
    rows = [(g, float(i), i) for g in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, o double, v int").repartition(3)
    for descending in (False, True):
        got = running_sums(df, ["g"], ["o"], ["v"], descending=descending, n_blocks=7, next_cols=["v"], totals_prefix="n_")
        for r in got.collect():
            nxt = r.v - 1 if descending else r.v + 1
            assert r.next_v == (nxt if 0 <= nxt < 50 else None) and r.n_v == 1225
            assert r.cum_v == (sum(range(r.v, 50)) if descending else sum(range(r.v + 1)))
