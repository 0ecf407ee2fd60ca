"""Per-capture flow statistics from decoded packet rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.functions.contracts import NETWORK_CONTRACT
from tracefuse.functions.scalar import label_from_name, safe_div
from tracefuse.operators.counting import align


def packet_features(packets: DataFrame, key_col: str = "file", len_col: str = "frame_len",
                    proto_col: str = "ip_proto", tcp_col: str = "tcp_dstport",
                    udp_col: str = "udp_dstport", time_col: str = "t",
                    order_cols: Sequence[str] = ("ordinal",),
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row of flow features per capture.

    * ``pkts`` counts rows with a length; ``bytes``/``sum`` their total;
      ``mean``, ``min``, ``max``; sample ``stddev`` (0 when fewer than 2);
      ``dur`` = max - min time when at least 2 times, else 0;
      ``rate`` = pkts / dur when dur > 0, else 0.  s* mirror the totals, d* are 0.
    * ``proto_tcp`` / ``proto_udp``: some row's protocol field equals exactly
      ``"6"`` / ``"17"`` (a ``"6,17"`` field matches neither); ``proto_arp`` 0.
    * ``dport``: first non-null port in packet order, tcp before udp per row.
    * ``extra_keys``: further grouping columns (e.g. an event-time window).

    Every aggregate is algebraic (count/sum/min/max/avg/stddev/min_by), so a
    capture holding a third of all packets is combined map-side.
    """
    ln, t = F.col(len_col), F.col(time_col)
    port = F.coalesce(F.col(tcp_col), F.col(udp_col))
    # a single (primitive) ordering column keeps the whole aggregate hash-based;
    # a multi-column order needs a struct, which Spark aggregates by sorting
    key = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*[F.col(c) for c in order_cols])
    order = F.when(port.isNotNull(), key)
    agg = packets.groupBy(key_col, *extra_keys).agg(
        F.count(ln).alias("_pkts"),
        F.sum(ln).alias("_bytes"),
        F.avg(ln).alias("_mean"),
        F.stddev_samp(ln).alias("_std"),
        F.min(ln).alias("_min"),
        F.max(ln).alias("_max"),
        F.count(t).alias("_nt"),
        (F.max(t) - F.min(t)).alias("_span"),
        F.max(F.when(F.col(proto_col) == "6", 1).otherwise(0)).alias("proto_tcp"),
        F.max(F.when(F.col(proto_col) == "17", 1).otherwise(0)).alias("proto_udp"),
        F.min_by(port, order).alias("_dport"),
    )
    pkts = F.col("_pkts").cast("double")
    bytes_ = F.coalesce(F.col("_bytes"), F.lit(0.0))
    dur = F.when(F.col("_nt") > 1, F.col("_span")).otherwise(F.lit(0.0))
    rate = safe_div(F.col("_pkts"), dur)
    return agg.select(
        key_col, *extra_keys,
        F.coalesce(F.col("_dport"), F.lit(0)).cast("double").alias("dport"),
        pkts.alias("pkts"),
        bytes_.alias("bytes"),
        F.lit(0.0).alias("seq"),
        dur.alias("dur"),
        F.coalesce(F.col("_mean"), F.lit(0.0)).alias("mean"),
        F.when(F.col("_pkts") > 1, F.col("_std")).otherwise(F.lit(0.0)).alias("stddev"),
        bytes_.alias("sum"),
        F.coalesce(F.col("_min"), F.lit(0.0)).alias("min"),
        F.coalesce(F.col("_max"), F.lit(0.0)).alias("max"),
        pkts.alias("spkts"),
        F.lit(0.0).alias("dpkts"),
        bytes_.alias("sbytes"),
        F.lit(0.0).alias("dbytes"),
        rate.alias("rate"),
        rate.alias("srate"),
        F.lit(0.0).alias("drate"),
        F.lit(0.0).alias("proto_arp"),
        F.col("proto_tcp").cast("double").alias("proto_tcp"),
        F.col("proto_udp").cast("double").alias("proto_udp"),
    )


def network_feature_table(packets: DataFrame, key_col: str = "file", keys: DataFrame | None = None,
                          **kw) -> DataFrame:
    """Flow features aligned to the 23-column contract with a name-derived label.

    ``keys`` lists the captures: one without a packet gets a row of zeros.
    """
    feats = packet_features(packets, key_col=key_col, **kw)
    if keys is not None:
        feats = keys.select(key_col).join(feats, key_col, "left")  # align() fills the zeros
    feats = feats.withColumn("label", label_from_name(key_col, "network"))
    return align(feats, NETWORK_CONTRACT, keep=[key_col, "label"])
