"""Prefix windows kept as streaming state against the batch operator, over a restart."""

import pytest
from pyspark.sql import functions as F

from conftest import sf_dir
from tracefuse.operators import counting as C
from tracefuse.plans import standins as S
from tracefuse.streaming.prefix import STATE_STORE, prefix_window_counts

WINDOWS = {"N3": 3 * 86400, "N15": 15 * 86400, "full": None}


@pytest.fixture
def store(spark):
    spark.conf.set(*STATE_STORE)
    yield
    spark.conf.unset(STATE_STORE[0])


def test_equals_batch_over_a_restart(spark, store, tmp_path):
    ev, manifest, _ = S.window_events(spark, sf_dir("0.001"))
    rows = sorted(((r.container, r.ts_s, r.syscall) for r in ev.collect()), key=lambda r: r[1])
    assert len(rows) > 200
    # rows of one batch out of order; the last one only moves the watermark
    schema = "container bigint, ts_s bigint, feature string"
    parts = [rows[i:i + len(rows) // 3 + 1][::-1] for i in range(0, len(rows), len(rows) // 3 + 1)]
    late = (rows[0][0], rows[0][1], "late")
    end = [(-1, rows[-1][1] + 10 ** 8, "end")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def feed(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src).withColumn("ts", F.timestamp_seconds("ts_s"))
        counts = prefix_window_counts(stream, manifest, WINDOWS, watermark="0 seconds")
        q = (counts.writeStream.format("parquet").outputMode("append").option("path", out)
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
        assert q.awaitTermination(100)

    feed(parts[0])
    run()
    for p in parts[1:]:  # every run restarts from the checkpoint
        feed(p + [late])
        run()
    feed(end)
    run()
    got = sorted(map(tuple, spark.read.parquet(out).select("window_tag", "container", "feature", "n").collect()))
    whole = ev.withColumnRenamed("syscall", "feature")
    long = C.window_long_counts(C.attach_start(whole, manifest, "container"), "container", "ts_s", WINDOWS)
    want = sorted(map(tuple, long.filter("window_tag != 'full'").select("window_tag", "container", "feature", "n").collect()))
    assert got == want and len(want) > 20


def test_needs_the_store_and_a_finite_window(spark):
    ev = spark.createDataFrame([("a", 1, "x")], "container string, ts int, feature string")
    manifest = spark.createDataFrame([("a", 0)], "container string, start_ts bigint")
    with pytest.raises(ValueError, match="providerClass"):
        prefix_window_counts(ev, manifest, {"N1": 1})
    with pytest.raises(ValueError, match="last second"):
        prefix_window_counts(ev, manifest, {"full": None})
