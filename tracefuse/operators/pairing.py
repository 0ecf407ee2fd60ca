"""First-row-per-key and bridge pairing of two score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.functions.fusion import CURRENT_RULE, FusionRule
from tracefuse.functions.scalar import predict
from tracefuse.session import join_dimension


def first_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str],
                  value_cols: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key under an explicit order (K4).

    Expressed as ``min_by(row, order)``: a partial aggregate, so a key holding
    a third of all rows is combined map-side instead of landing in one task.
    ``order_cols`` must be a total order within a key (as file order is).
    """
    key_cols = list(key_cols)
    values = list(value_cols) if value_cols is not None else [
        c for c in df.columns if c not in key_cols]
    if len(order_cols) == 1:
        # one primitive ordering: a min_by per column keeps fixed-width buffers,
        # so Spark can hash-aggregate (a struct buffer forces a sort aggregate)
        order = F.col(order_cols[0])
        return df.groupBy(*key_cols).agg(*[F.min_by(F.col(c), order).alias(c) for c in values])
    row = F.struct(*[F.col(c) for c in values])
    order = F.struct(*[F.col(c) for c in order_cols])
    return (df.groupBy(*key_cols).agg(F.min_by(row, order).alias("_first"))
            .select(*key_cols, *[F.col(f"_first.{c}").alias(c) for c in values]))


def pair_predictions(sys_scores: DataFrame, net_scores: DataFrame, bridge: DataFrame, *,
                     sys_order: Sequence[str], net_order: Sequence[str],
                     rule: FusionRule = CURRENT_RULE, threshold: float = 0.5,
                     bridge_max_rows: int | None = None) -> DataFrame:
    """Pair syscall and network scores through a bridge table and fuse them.

    Inputs: ``sys_scores(base, label, p_sys, *order)``,
    ``net_scores(network_base, p_net, *order)``, ``bridge(base, network_base)``.
    The first row per base is taken on each side; ``label`` comes from the
    syscall side.  A ``run_id`` equi-join is the identity bridge.
    """
    s = first_per_key(sys_scores, ["base"], sys_order, ["label", "p_sys"])
    n = first_per_key(net_scores, ["network_base"], net_order, ["p_net"])
    b = bridge.select("base", "network_base")
    # one row per base on each side; the bridge is broadcast only when a
    # limit-count check bounds it, otherwise AQE picks the strategy at run time
    paired = join_dimension(s, b, "base", max_rows=bridge_max_rows).join(n, "network_base")
    return paired.select(
        "base", "network_base", "label", "p_sys", "p_net",
        predict("p_sys", threshold).alias("pred_syscall"),
        predict("p_net", threshold).alias("pred_network"),
        rule.decide("p_sys", "p_net").alias("pred_hybrid"))


def unmatched_pairs(sys_scores: DataFrame, net_scores: DataFrame, bridge: DataFrame) -> DataFrame:
    """Bridge rows that cannot be paired, with the side(s) missing."""
    sk = sys_scores.select("base").distinct().withColumn("_has_sys", F.lit(True))
    nk = net_scores.select("network_base").distinct().withColumn("_has_net", F.lit(True))
    b = (bridge.select("base", "network_base")
         .join(sk, "base", "left").join(nk, "network_base", "left"))
    has_s, has_n = F.col("_has_sys").isNotNull(), F.col("_has_net").isNotNull()
    side = (F.when(~has_s & ~has_n, "both").when(~has_s, "syscall").otherwise("network"))
    return (b.filter(~has_s | ~has_n)
            .select("base", "network_base", side.alias("missing_side")))
