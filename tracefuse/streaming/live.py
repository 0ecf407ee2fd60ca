"""Structured Streaming forms of the counting and fusion steps.

The batch operators are pure ``DataFrame -> DataFrame`` transforms, so only
the window key changes: event-time windows with a watermark bound the state,
and late events beyond the watermark are dropped by Spark, not by us.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.functions.contracts import SYSCALL_ALIASES
from tracefuse.functions.fusion import CURRENT_RULE, FusionRule, fuse
from tracefuse.operators.counting import map_syscalls
from tracefuse.operators.flows import packet_features


def windowed_counts(events: DataFrame, key_col: str = "container", ts_col: str = "ts",
                    name_col: str = "syscall", window: str = "15 seconds",
                    slide: str | None = None, watermark: str = "1 minute",
                    aliases: Mapping[str, str] | None = SYSCALL_ALIASES,
                    contract=None) -> DataFrame:
    """Per (event-time window, container, feature) counts of a syscall stream.

    ``ts_col`` is cast to ``timestamp`` (``withWatermark`` rejects
    ``timestamp_ntz``).  Append mode emits each window once the watermark
    passes its end.
    """
    ev = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    mapped = map_syscalls(ev, name_col, aliases, contract)
    win = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    return (mapped.withWatermark(ts_col, watermark)
            .groupBy(win.alias("window"), key_col, "feature")
            .agg(F.count(F.lit(1)).alias("n")))


def windowed_flow_stats(packets: DataFrame, key_col: str = "file", time_col: str = "t",
                        window: str = "1 minute", watermark: str = "2 minutes",
                        order_cols=("ordinal",)) -> DataFrame:
    """Per (capture, event-time window) flow statistics of a packet stream.

    The float epoch time becomes a ``timestamp`` for the watermark; all
    aggregates are the batch ones (algebraic, so the state per group is a
    fixed-size buffer, evicted once the watermark passes the window end).
    """
    p = (packets.withColumn("_ts", F.timestamp_seconds(F.col(time_col)))
         .withWatermark("_ts", watermark)
         .withColumn("window", F.window("_ts", window)))
    return packet_features(p, key_col=key_col, time_col=time_col, order_cols=order_cols,
                           extra_keys=["window"])


def fused_verdicts(scores: DataFrame, rule: FusionRule = CURRENT_RULE) -> DataFrame:
    """Stateless fusion of a stream of paired scores (p_sys, p_net)."""
    return fuse(scores, rule=rule)


def start_fused_sink(scores: DataFrame, path: str, checkpoint: str, rule: FusionRule = CURRENT_RULE):
    """Write fused verdicts with the file sink.

    Fusion is stateless, so the sink's own log of committed files makes a
    replayed micro-batch harmless (exactly once for readers of the folder).
    """
    return (fuse(scores, rule=rule).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).start())
