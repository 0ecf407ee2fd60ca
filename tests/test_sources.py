"""Readers and sinks: round trips, multi-file packet scans, manifests."""

import tempfile

from tracefuse.operators.flows import network_feature_table
from tracefuse.sources.readers import read_csv, read_manifest, read_packets
from tracefuse.sources.sinks import write_table


def test_sink_round_trips(spark):
    df = spark.createDataFrame([("N3", "a", 1.0), ("full", "b", 2.0)], "window_tag string, k string, v double")
    base = tempfile.mkdtemp(prefix="tf-sink-")
    write_table(df, f"{base}/pq", partition_by=["window_tag"])
    back = spark.read.parquet(f"{base}/pq")
    assert sorted((r.window_tag, r.k, r.v) for r in back.collect()) == [("N3", "a", 1.0), ("full", "b", 2.0)]
    write_table(df, f"{base}/csv", fmt="csv")
    back = read_csv(spark, f"{base}/csv", "window_tag string, k string, v double")
    assert back.count() == 2 and dict(back.dtypes)["v"] == "double"


def test_manifest_and_packets_per_file(spark):
    d = tempfile.mkdtemp(prefix="tf-src-")
    with open(f"{d}/m.csv", "w") as f:
        f.write("container,label,start_ts,end_ts\nredis,0,100,115\nport-scan,1,50,\n")
    m = {r.container: (r.label, r.start_ts, r.end_ts) for r in read_manifest(spark, f"{d}/m.csv").collect()}
    assert m == {"redis": (0, 100, 115), "port-scan": (1, 50, None)}
    p = tempfile.mkdtemp(prefix="tf-pk-")
    with open(f"{p}/mal_a_network.tsv", "w") as f:
        f.write("".join(f"{60 + i}\t6\t{1000 + i}\t\t{i}.5\n" for i in range(500)))
    with open(f"{p}/benign_b_network.tsv", "w") as f:
        f.write("\t\t\t53\t1.0\n100\t17\t\t\t2.0\n")
    with open(f"{p}/notes.txt", "w") as f:
        f.write("not a capture\n")
    rows = read_packets(spark, p)
    assert rows.count() == 502
    feats = {r.file: r for r in network_feature_table(rows).collect()}
    a = feats["mal_a_network.tsv"]
    assert (a.label, a.pkts, a.dport, a.dur) == (1, 500, 1000, 499.0)
    b = feats["benign_b_network.tsv"]
    assert (b.label, b.pkts, b.dport, b.proto_udp, b.proto_tcp) == (0, 1, 53, 1, 0)
