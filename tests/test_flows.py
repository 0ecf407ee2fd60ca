"""Packet flow statistics and network alignment."""

import pytest

from conftest import fixture_path
from tracefuse.functions.contracts import NETWORK_CONTRACT
from tracefuse.operators.counting import align
from tracefuse.operators.flows import network_feature_table, packet_features

SCHEMA = ("file string, ordinal bigint, frame_len double, ip_proto string, tcp_dstport int, "
          "udp_dstport int, t double")
ROWS = [
    ("one.pcap", 1, 60.0, "6", 80, None, 10.0),
    ("none.pcap", 1, None, None, None, None, None),
    ("mix.pcap", 1, 100.0, "6,17", None, 53, 1.0),      # udp-only port first
    ("mix.pcap", 2, 300.0, "17", 443, 53, 3.0),           # tcp wins over udp
    ("mix.pcap", 3, None, "6", 22, None, None),          # missing length and time
    ("mix.pcap", 0, 200.0, None, None, None, 2.0),       # earliest, no port
]


def test_packet_cases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.file: r for r in packet_features(df).collect()}
    one = got["one.pcap"]
    assert (one.pkts, one.stddev, one.dur, one.rate, one.dport, one.proto_tcp) == (1, 0.0, 0.0, 0.0, 80, 1)
    none = got["none.pcap"]
    assert (none.pkts, none.bytes, none.mean, none.min, none.dport) == (0, 0.0, 0.0, 0.0, 0)
    mix = got["mix.pcap"]
    assert (mix.pkts, mix.bytes, mix.min, mix.max, mix.mean) == (3, 600.0, 100.0, 300.0, 200.0)
    assert mix.stddev == pytest.approx(100.0) and mix.dur == 2.0 and mix.rate == 1.5
    assert (mix.proto_tcp, mix.proto_udp, mix.dport) == (1, 1, 53)
    assert (mix.spkts, mix.sbytes, mix.srate, mix.dpkts, mix.drate) == (3, 600.0, 1.5, 0.0, 0.0)


def test_network_table_contract(spark):
    df = spark.createDataFrame([("mal_scan_network.pcap", 1, 60.0, "6", 80, None, 1.0),
                                ("Mal_x_network.pcap", 1, 60.0, "6", 80, None, 1.0)], SCHEMA)
    t = network_feature_table(df)
    assert t.columns == ["file", "label"] + NETWORK_CONTRACT
    labels = {r.file: r.label for r in t.collect()}
    assert labels == {"mal_scan_network.pcap": 1, "Mal_x_network.pcap": 0}


def test_network_alignment_golden(spark):
    raw = spark.read.option("header", True).option("inferSchema", True).csv(fixture_path("runtime_network_raw.csv"))
    gold = spark.read.option("header", True).option("inferSchema", True).csv(fixture_path("runtime_network_aligned.csv"))
    aligned = align(raw, NETWORK_CONTRACT, keep=["file", "label"])
    assert aligned.columns == gold.columns
    a = {r.file: r for r in aligned.collect()}
    for g in gold.collect():
        assert all(float(a[g.file][c]) == pytest.approx(float(g[c]), rel=1e-12) for c in NETWORK_CONTRACT)
