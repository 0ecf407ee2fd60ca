"""Late fusion of two detector probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefuse.functions.scalar import _c, at_least, nan_to_null, predict

SYSCALL_DOMINANT = "syscall_dominant"
NETWORK_OVERRIDE = "network_override"
NETWORK_CORROBORATES = "network_corroborates"
NO_RULE = "none"


@dataclass(frozen=True)
class FusionRule:
    """Ordered, inclusive threshold rule.

    1. ``p_sys >= sys_hi``                          -> malicious (syscall dominant)
    2. ``p_net >= net_override`` (when set)          -> malicious (network override)
    3. ``p_net >= net_hi and p_sys >= sys_floor``    -> malicious (network corroborates)
    4. otherwise benign.  NaN / NULL never pass a threshold.
    """

    sys_hi: float = 0.6
    net_hi: float = 0.5
    sys_floor: float = 0.1
    net_override: float | None = None

    def fired(self, p_sys, p_net) -> Column:
        p_sys, p_net = _c(p_sys), _c(p_net)
        chain = F.when(at_least(p_sys, self.sys_hi), F.lit(SYSCALL_DOMINANT))
        if self.net_override is not None:
            chain = chain.when(at_least(p_net, self.net_override), F.lit(NETWORK_OVERRIDE))
        chain = chain.when(at_least(p_net, self.net_hi) & at_least(p_sys, self.sys_floor),
                           F.lit(NETWORK_CORROBORATES))
        return chain.otherwise(F.lit(NO_RULE))

    def decide(self, p_sys, p_net) -> Column:
        p_sys, p_net = _c(p_sys), _c(p_net)
        hit = at_least(p_sys, self.sys_hi)
        if self.net_override is not None:
            hit = hit | at_least(p_net, self.net_override)
        hit = hit | (at_least(p_net, self.net_hi) & at_least(p_sys, self.sys_floor))
        return hit.cast("int")


# FIXED VALUES: the shipped rule and the older rule its synthetic set was labelled with.
CURRENT_RULE = FusionRule(sys_hi=0.6, net_hi=0.5, sys_floor=0.1)
LEGACY_RULE = FusionRule(sys_hi=0.5, net_hi=0.5, sys_floor=0.2, net_override=0.9)


def fuse(df: DataFrame, p_sys: str = "p_sys", p_net: str = "p_net",
         rule: FusionRule = CURRENT_RULE, threshold: float = 0.5,
         explain: bool = True) -> DataFrame:
    """Add single-signal predictions, the fused verdict and (optionally) the rule that fired."""
    out = df.withColumns({
        "pred_syscall": predict(p_sys, threshold),
        "pred_network": predict(p_net, threshold),
        "pred_hybrid": rule.decide(p_sys, p_net),
    })
    if explain:
        out = out.withColumn("fired_rule", rule.fired(p_sys, p_net))
    return out


def probability_band(p_sys, p_net) -> Column:
    """Cases A-E of the probability plane; NULL for the two uncovered gaps."""
    s, n = nan_to_null(_c(p_sys)), nan_to_null(_c(p_net))
    return (F.when((s >= 0.6) & (n < 0.5), "A")
            .when((s < 0.1) & (n >= 0.6), "B")
            .when((s >= 0.1) & (s < 0.6) & (n >= 0.5), "C")
            .when((s >= 0.6) & (n >= 0.5), "D")
            .when((s < 0.1) & (n < 0.5), "E"))
