"""Shards and slots against a brute-force version of rendezvous hashing."""

import hashlib
import math
import zlib
from collections import Counter

from llm.conftest import edge_rows, frame
from pyspark.sql import functions as F

from tracefuse.llm import sharding


def brute(key, weights):
    key = "" if key is None else str(key)
    costs = []
    for i, w in enumerate(weights):
        u = int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16)
        costs.append((-math.log((u + 0.5) / 2 ** 52) / w, i))
    return min(costs)[1]


def test_rows_against_brute_force(lspark):
    rows = edge_rows()
    for clash in (False, True):
        got = sharding.assign_shards(frame(lspark, rows, clash), [1.0] * 16).collect()
        assert len(got) == len(rows)
        have = sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=str)
        assert have == sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key",
                                brute(r[0], [1] * 16), brute(r[0], [1] * 17)) for r in rows), key=str)
        for s, n in Counter(r.shard for r in got).items():
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        assert all(r.grown_shard in (r.shard, 16) for r in got)


def test_weights_and_growth(lspark):
    weights, more = [1.0, 2.0, 0.5, 4.0], [1.0, 2.0, 0.5, 4.0, 1.5]
    keys = lspark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign_shards(keys, weights, more).groupBy("shard", "grown_shard").count().collect()
    share = Counter()
    for r in got:
        share[r.shard] += r["count"]
        assert r.grown_shard in (r.shard, 4)
    for i, w in enumerate(weights):
        assert abs(share[i] / 20000 - w / 7.5) < 0.02
    moved = sum(r["count"] for r in got if r.grown_shard == 4)
    assert abs(moved / 20000 - 1.5 / 9) < 0.02
    some = keys.limit(200).select(sharding.shard_of(F.col("doc_id"), weights).alias("s"), "doc_id").collect()
    assert all(r.s == brute(r.doc_id, weights) for r in some)


def test_empty_table(lspark):
    assert sharding.assign_shards(frame(lspark, []).limit(0), [1.0] * 4).count() == 0
