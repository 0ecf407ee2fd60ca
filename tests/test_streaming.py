"""Streaming windowed counts over the events table used as a file stream."""

import tempfile

from pyspark.sql import functions as F

from conftest import sf_dir
from tracefuse.streaming.live import fused_verdicts, windowed_counts


def test_windowed_counts_match_batch(spark):
    src = sf_dir("0.001") + "/events.parquet"
    schema = spark.read.parquet(src).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir("0.001"))
              .select(F.col("user_id").alias("container"), "ts", F.col("event_type").alias("syscall")))
    counts = windowed_counts(stream, window="1 day", watermark="0 seconds", aliases=None)
    q = (counts.writeStream.outputMode("update").format("memory").queryName("tf_counts")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tf-stream-")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) as n from tf_counts").first().n
    assert got == spark.read.parquet(src).count()


def test_fused_verdicts_on_stream_shape(spark):
    df = spark.createDataFrame([(0.7, 0.1), (0.2, 0.6)], "p_sys double, p_net double")
    got = [r.pred_hybrid for r in fused_verdicts(df).collect()]
    assert got == [1, 1]


def test_fused_sink_matches_batch(spark):
    from tracefuse.plans import standins
    from tracefuse.streaming.live import start_fused_sink
    d = sf_dir("0.001")
    schema = spark.read.parquet(d + "/labels.parquet").schema
    lab = (spark.readStream.schema(schema).option("pathGlobFilter", "labels.parquet").parquet(d)
           .select("doc_id", ((F.col("doc_id") * 7919) % 1000 / 1000).alias("p_sys"),
                   ((F.col("doc_id") * 104729) % 1000 / 1000).alias("p_net")))
    out = tempfile.mkdtemp(prefix="tf-fused-") + "/out"
    q = start_fused_sink(lab, out, tempfile.mkdtemp(prefix="tf-ckpt-"))
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.pred_hybrid for r in spark.read.parquet(out).collect()}
    want = {r.doc_id: r.pred_hybrid for r in fused_verdicts(standins.scores(spark, d)).collect()}
    assert got == want and len(got) > 0


def test_windowed_flow_stats_stream(spark):
    from tracefuse.streaming.live import windowed_flow_stats
    d = tempfile.mkdtemp(prefix="tf-pkts-")
    rows = [("cap1", i, 60.0 + i, "6", 80 + i, None, 1000.0 + i * 10) for i in range(12)] + \
           [("cap2", i, 100.0, "17", None, 53, 1000.0 + i) for i in range(5)]
    schema = ("file string, ordinal bigint, frame_len double, ip_proto string, tcp_dstport int, "
              "udp_dstport int, t double")
    spark.createDataFrame(rows, schema).write.parquet(d + "/p")
    stream = spark.readStream.schema(schema).parquet(d + "/p")
    stats = windowed_flow_stats(stream, window="60 seconds", watermark="0 seconds")
    q = (stats.writeStream.outputMode("update").format("memory").queryName("tf_flows")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tf-ckpt-")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select file, sum(pkts) as pkts, min(dport) as dport from tf_flows group by file").collect()
    assert {r.file: (r.pkts, r.dport) for r in got} == {"cap1": (12.0, 80.0), "cap2": (5.0, 53.0)}
