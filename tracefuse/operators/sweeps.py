"""Robustness and threshold sweeps, rule agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefuse.functions.fusion import CURRENT_RULE, FusionRule
from tracefuse.functions.scalar import clip01, hash_normal, nan_to_null, predict, safe_div
from tracefuse.session import cut_lineage

# FIXED VALUES: observation window (seconds) -> confidence scale of the shrink study.
SHRINK_GRID: tuple[tuple[int, float], ...] = ((5, 0.25), (10, 0.50), (15, 0.75), (30, 1.00))


_NAMES = ("syscall", "network", "hybrid")


def noise_key(seed: int, row: Column, point: Column, signal: str) -> Column:
    """Text that names one noise draw: seed, row key, grid point and signal."""
    return F.concat_ws(":", F.lit(str(seed)), F.coalesce(row.cast("string"), F.lit("")), point.cast("string"), F.lit(signal))


def robustness_sweep(df: DataFrame, y: str = "y", p_sys: str = "p_sys", p_net: str = "p_net",
                     grid: Sequence[tuple[int, float]] = SHRINK_GRID, noise: bool = False,
                     seed: int = 42, rule: FusionRule = CURRENT_RULE, key: str | None = None) -> DataFrame:
    """Shrink both scores toward 0.5 by ``scale`` (plus optional Gaussian noise
    with sd ``(1 - scale) * 0.1``), clip to [0, 1], and report F1 of the
    syscall, network and fused predictors per window (R1, P22).

    Every row meets every grid point inside its task, its three verdicts become
    one small integer, and the counts by (point, class, integer) - at most 16 a
    point - are all that is shuffled.  ``noise=True`` draws from a hash of (seed,
    ``key``, grid point, signal), so the result does not depend on partitions or
    retries; rows with one key share their draws.  Without ``key`` a row is its
    class and two scores.
    """
    row = F.col(key) if key else F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in (y, p_sys, p_net)])
    points = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(int(n)).alias("n_window"), F.lit(float(s)).alias("scale"))
                       for i, (n, s) in enumerate(grid)])
    x = df.select(F.col(y).cast("int").alias("_y"), nan_to_null(p_sys).alias("_s"), nan_to_null(p_net).alias("_n"),
                  *([row.alias("_row")] if noise else [])).filter(F.col("_y").isin(0, 1)).select("*", F.inline(points))

    def shrink(c: str) -> Column:
        v = F.lit(0.5) + F.col("scale") * (F.col(c) - F.lit(0.5))
        if noise:
            sd = (F.lit(1.0) - F.col("scale")) * F.lit(0.1)
            v = v + hash_normal(noise_key(seed, F.col("_row"), F.col("_i"), c[1:])) * sd
        return clip01(v)

    x = x.withColumns({"_s": shrink("_s"), "_n": shrink("_n")})
    verdicts = (predict("_s"), predict("_n"), rule.decide("_s", "_n"))
    bits = sum((v * F.lit(1 << j) for j, v in enumerate(verdicts)), F.lit(0))
    counts = x.groupBy("_i", "n_window", "scale", "_y", bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_rows"))

    def total(true: int, j: int, pred: bool) -> Column:
        said = F.col("_bits").bitwiseAND(F.lit(1 << j)) != 0
        return F.sum(F.when((F.col("_y") == true) & (said if pred else ~said), F.col("_rows")).otherwise(0))

    sums = counts.groupBy("_i", "n_window", "scale").agg(*[
        total(true, j, pred).alias(f"{kind}_{name}") for j, name in enumerate(_NAMES)
        for kind, true, pred in (("tp", 1, True), ("fp", 0, True), ("fn", 1, False))])
    return sums.select("n_window", "scale", *[
        safe_div(2 * F.col(f"tp_{n}"), 2 * F.col(f"tp_{n}") + F.col(f"fp_{n}") + F.col(f"fn_{n}")).alias(f"f1_{n}")
        for n in _NAMES])


def grid_cell(p: str, steps: int) -> Column:
    """Index of the highest grid threshold k/steps that ``p`` reaches (0..steps),
    -1 for NULL/NaN/negative.  The estimate ``floor(p*steps)`` is corrected by
    comparing against the exact thresholds, so it agrees with ``p >= k/steps``."""
    v = nan_to_null(F.col(p))
    c0 = F.least(F.greatest(F.floor(v * steps), F.lit(0)), F.lit(steps)).cast("int")
    up = (c0 < steps) & (v >= (c0 + 1) / F.lit(float(steps)))
    down = v < c0 / F.lit(float(steps))
    c = F.when(up, c0 + 1).when(down, c0 - 1).otherwise(c0)
    return F.when(v.isNull(), F.lit(-1)).otherwise(c)


def threshold_sweep(df: DataFrame, y: str = "y", p_sys: str = "p_sys", p_net: str = "p_net",
                    steps: int = 20) -> DataFrame:
    """Confusion counts and rates of the fusion rule at every grid point
    (sys_hi, net_hi, sys_floor) in (k/steps), k = 0..steps (R2).

    The scores are reduced to one histogram over grid cells with a count per
    class (at most (steps+2)^2 rows, whatever the input size), turned into 2-D
    suffix sums C(x, b) = #{cell_sys >= x, cell_net >= b}, and every grid point
    is a few equi-join lookups into that small table:

        fused(a, b, f) = C(a, -1) + [f < a] * (C(f, b) - C(a, b))

    where cell -1 holds NULL / NaN scores (a missing network score still lets
    the syscall branch fire) and C(-1, -1) is the class size.  No cross join
    of scores with the grid.
    """
    spark = df.sparkSession
    k = steps + 1          # thresholds 0..steps
    kc = steps + 2         # cells -1..steps
    yy = F.col(y).cast("int")
    hist = (df.select(yy.alias("_y"), grid_cell(p_sys, steps).alias("cs"), grid_cell(p_net, steps).alias("cn"))
            .groupBy("cs", "cn")
            .agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("h1"),
                 F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("h0")))

    def div(c, d):
        return F.floor(c / F.lit(d)).cast("int")

    idx = F.col("id")
    dense = spark.range(kc * kc).select((div(idx, kc) - 1).alias("cs"), (idx % kc - 1).cast("int").alias("cn"))
    # the histogram is bounded by the cell count: broadcast is proven small
    dense = dense.join(F.broadcast(hist), ["cs", "cn"], "left").fillna(0, subset=["h1", "h0"])
    down_s = Window.partitionBy("cn").orderBy(F.desc("cs")).rowsBetween(Window.unboundedPreceding, 0)
    down_n = Window.partitionBy("cs").orderBy(F.desc("cn")).rowsBetween(Window.unboundedPreceding, 0)
    c = (dense.select("cs", "cn", F.sum("h1").over(down_s).alias("r1"), F.sum("h0").over(down_s).alias("r0"))
         .select(F.col("cs").alias("x"), F.col("cn").alias("b"),
                 F.sum("r1").over(down_n).alias("c1"), F.sum("r0").over(down_n).alias("c0")))
    # class sizes = C(-1, -1), the largest suffix sum; carried on every row of
    # this (steps+2)^2-row table so no extra join is needed to attach them
    everything = Window.partitionBy()
    c = c.withColumns({"n1": F.max("c1").over(everything), "n0": F.max("c0").over(everything)})
    # frozen once: the three lookups below read these (steps+2)^2 rows, not the scores
    c = cut_lineage(c)
    grid = spark.range(k * k * k).select(
        div(idx, k * k).alias("a"), (div(idx, k) % k).alias("bn"), (idx % k).cast("int").alias("f"))

    def lookup(frame: DataFrame, x: Column, b: Column, name: str, extra=()) -> DataFrame:
        look = F.broadcast(c.select(F.col("x").alias("_lx"), F.col("b").alias("_lb"),
                                    F.col("c1").alias(f"{name}1"), F.col("c0").alias(f"{name}0"), *extra))
        return frame.join(look, (x == F.col("_lx")) & (b == F.col("_lb")), "inner").drop("_lx", "_lb")

    t = lookup(grid, F.col("a"), F.lit(-1), "ca", extra=("n1", "n0"))
    t = lookup(t, F.col("f"), F.col("bn"), "cf")
    t = lookup(t, F.col("a"), F.col("bn"), "cab")

    def fused(cls: str) -> Column:
        return (F.col(f"ca{cls}") + F.when(F.col("f") < F.col("a"), F.col(f"cf{cls}") - F.col(f"cab{cls}"))
                .otherwise(0)).cast("bigint")

    tp, fp = fused("1"), fused("0")
    out = t.select((F.col("a") / F.lit(float(steps))).alias("sys_hi"),
                   (F.col("bn") / F.lit(float(steps))).alias("net_hi"),
                   (F.col("f") / F.lit(float(steps))).alias("sys_floor"),
                   tp.alias("tp"), fp.alias("fp"), (F.col("n1") - tp).cast("bigint").alias("fn"),
                   (F.col("n0") - fp).cast("bigint").alias("tn"))
    return out.withColumns({"recall": safe_div("tp", F.col("tp") + F.col("fn")),
                            "precision": safe_div("tp", F.col("tp") + F.col("fp")),
                            "f1": safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                            "fpr": safe_div("fp", F.col("fp") + F.col("tn"))})


def best_thresholds(sweep: DataFrame, max_fpr: float = 0.0) -> DataFrame:
    """Grid point with the highest recall subject to FPR <= max_fpr; ties by
    F1, then the strictest thresholds (sys_hi, net_hi, sys_floor descending)."""
    return (sweep.filter(F.col("fpr") <= max_fpr)
            .orderBy(F.desc("recall"), F.desc("f1"), F.desc("sys_hi"), F.desc("net_hi"),
                     F.desc("sys_floor")).limit(1))


def rule_agreement(df: DataFrame, p_sys: str = "p_sys", p_net: str = "p_net",
                   rule_a: FusionRule = CURRENT_RULE, rule_b: FusionRule | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Joint counts of two rules' verdicts on the same scores."""
    from tracefuse.functions.fusion import LEGACY_RULE
    rule_b = rule_b or LEGACY_RULE
    return (df.select(*group_cols, rule_a.decide(p_sys, p_net).alias("pred_a"),
                      rule_b.decide(p_sys, p_net).alias("pred_b"))
            .groupBy(*group_cols, "pred_a", "pred_b").agg(F.count(F.lit(1)).alias("n")))
