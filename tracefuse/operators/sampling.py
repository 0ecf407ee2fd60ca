"""Deterministic splitting and sampling (M1-M4).

Membership is decided by an exact rank within the class under an explicit
order (e.g. a hash of the key), so the result is reproducible across engines
and re-runs; ``sampleBy`` is Bernoulli and would only approximate the sizes.
Ranks come from :func:`global_rank`, which never gathers a class in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefuse.operators.ranking import global_rank, running_sums, top_k_per_group


def _ranked_sizes(ranked: DataFrame, label: str) -> DataFrame:
    """Class sizes as the largest rank per class (one row per class)."""
    return ranked.groupBy(label).agg(F.max("rank").alias("class_n"))


def _with_sizes(ranked: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """Attach class columns with a NULL-safe join: a NULL label is a class of
    its own instead of silently losing its rows."""
    s = sizes.withColumnRenamed(label, "_lbl")
    return ranked.join(s, ranked[label].eqNullSafe(s["_lbl"]), "inner").drop("_lbl")


def stratified_split(df: DataFrame, label: str, order_cols: Sequence[str],
                     test_fraction: float = 0.2) -> DataFrame:
    """Adds ``split`` in {train, test}: the first round(f * n_class) rows of each
    class (by ``order_cols``) are test, preserving class proportions (M1)."""
    ranked = global_rank(df, [label], order_cols)
    # class sizes from the frozen ranking (max rank), not a second scan of the source
    sized = _with_sizes(ranked, _ranked_sizes(ranked, label), label)
    n_test = F.round(F.col("class_n") * F.lit(float(test_fraction)))
    split = F.when(F.col("rank") <= n_test, "test").otherwise("train")
    return sized.withColumn("split", split).drop("class_n")


def split_by_key(df: DataFrame, label: str, key: str, test_fraction: float = 0.2) -> DataFrame:
    """Adds ``split`` like :func:`stratified_split`, ranking (label, key) alone (M1).

    Each class gets one cut key, the one that brings its test share closest to
    round(f * n_class), and the rows themselves are only filtered, never
    ranked or frozen.  Rows with one key (copies, where ``key`` is a hash of
    the row) stay on one side, so a copy is never both learned and tested.
    """
    counts = df.groupBy(label, key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, [label], [key], ["_n"], totals_prefix="_class")
    wanted = F.round(F.col("_class_n") * F.lit(float(test_fraction)))
    best = F.min(F.struct(F.abs(F.col("cum__n") - wanted).alias("off"), F.col("cum__n"), F.col(key).alias("cut"),
                          wanted.alias("wanted"))).alias("best")
    # one row per class -> broadcast
    cuts = ranked.groupBy(label).agg(best).select(F.col(label).alias("_cut_label"), "best.cut", "best.wanted")
    out = df.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_cut_label")))
    test = (F.col(key) <= F.col("cut")) & (F.col("wanted") > 0)
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_cut_label", "cut", "wanted")


def sample_per_class(df: DataFrame, label: str, order_cols: Sequence[str], k: int = 15) -> DataFrame:
    """The first ``k`` rows of each class, without replacement (M2)."""
    return top_k_per_group(df, [label], order_cols, k)


def rebalance_classes(df: DataFrame, label: str, order_cols: Sequence[str], ratio: float = 1.0,
                      bands: Sequence[float] = (0.7, 0.85)) -> DataFrame:
    """Cap every class at floor(ratio * minority size) and split the kept rows
    into train / validation / test by rank bands (M3)."""
    ranked = global_rank(df, [label], order_cols)
    # one row per class (from the frozen ranking): the minority size is a
    # window over this tiny table
    sizes = _ranked_sizes(ranked, label).withColumn(
        "minority_n", F.min("class_n").over(Window.partitionBy()))
    ranked = _with_sizes(ranked, sizes, label)
    keep_n = F.least(F.col("class_n"), F.floor(F.col("minority_n") * F.lit(float(ratio))))
    kept = ranked.withColumn("keep_n", keep_n).filter(F.col("rank") <= F.col("keep_n"))
    b1 = F.round(F.col("keep_n") * F.lit(float(bands[0])))
    b2 = F.round(F.col("keep_n") * F.lit(float(bands[1])))
    split = (F.when(F.col("rank") <= b1, "train").when(F.col("rank") <= b2, "validation")
             .otherwise("test"))
    return kept.withColumn("split", split).drop("class_n", "minority_n", "keep_n")


def pair_within_label(left: DataFrame, right: DataFrame, label: str,
                      left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Pair the i-th row of a class on one side with the i-th row of the same
    class on the other (M4).  (label, rank) is unique per side: no skew."""
    lr = global_rank(left, [label], left_order)
    rr = global_rank(right, [label], right_order)
    return lr.join(rr, [label, "rank"], "inner")
