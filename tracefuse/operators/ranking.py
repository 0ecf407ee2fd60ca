"""Exact ranks and running sums without a single-task global window.

A window with ``partitionBy(label)`` puts a whole class in one task, and
``orderBy`` without a partition puts the whole table there.  Instead rows are
range-partitioned into balanced blocks, the blocks are frozen in the
checkpoint folder (so block ids survive recomputation and executor loss),
per-block totals (one row per block and group: bounded by the partition
count) give exclusive offsets, and the rest is a window inside one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefuse.session import cut_lineage

_BLK = "_blk"


def _order_exprs(order_cols: Sequence, descending: bool) -> list[Column]:
    out = []
    for c in order_cols:
        col = F.col(c) if isinstance(c, str) else c
        out.append(col.desc_nulls_last() if descending else col.asc_nulls_first())
    return out


def _sort_keys(order_cols: Sequence[str], descending: bool) -> list[Column]:
    """Numeric order columns as ascending struct fields in the same order as ``_order_exprs``."""
    out = []
    for i, c in enumerate(order_cols):
        v = F.col(c)
        out += [(v.isNull() == F.lit(descending)).cast("int").alias(f"_null{i}"),
                (-v if descending else v).alias(f"_key{i}")]
    return out


def _blocks(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence,
            n_blocks: int | None, descending: bool) -> DataFrame:
    exprs = [*[F.col(c).asc() for c in part_cols], *_order_exprs(order_cols, descending)]
    # Without an explicit count, AQE sizes the blocks to its advisory partition
    # size; it only merges adjacent range partitions, so block ids stay in order.
    ranged = df.repartitionByRange(n_blocks, *exprs) if n_blocks else df.repartitionByRange(*exprs)
    return cut_lineage(ranged.withColumn(_BLK, F.spark_partition_id()))


def running_sums(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence,
                 sum_cols: Sequence[str], descending: bool = False,
                 n_blocks: int | None = None, prefix: str = "cum_", next_cols: Sequence[str] = (),
                 totals_prefix: str | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` within ``part_cols`` along ``order_cols``.

    ``order_cols`` must be a total order within a group (no ties).
    ``next_cols`` adds ``next_<c>``: the column's value in the group's next row
    (NULL in the last one).  ``totals_prefix`` adds the groups' totals.  Both
    come from the blocks' one frozen copy, without another pass or checkpoint.
    """
    part_cols = list(part_cols)
    blk = _blocks(df, part_cols, order_cols, n_blocks, descending)
    totals = blk.groupBy(_BLK, *part_cols).agg(*[F.sum(c).alias(c) for c in sum_cols])
    before = Window.partitionBy(*part_cols).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*part_cols)
    extra = [F.sum(c).over(group).alias(f"_tot_{c}") for c in sum_cols] if totals_prefix else []
    if next_cols:
        # the first row of each block and group: what follows the last row of the block before
        first = F.min(F.struct(*_sort_keys(order_cols, descending), *next_cols))
        heads = blk.groupBy(_BLK, *part_cols).agg(first.alias("_head"))
        keyed = heads.select(F.col(_BLK).alias("_hblk"), *[F.col(c).alias(f"_h_{c}") for c in part_cols], "_head")
        same = F.col(_BLK) == F.col("_hblk")
        for c in part_cols:
            same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
        totals = totals.join(keyed, same).drop("_hblk", *[f"_h_{c}" for c in part_cols])
        after = Window.partitionBy(*part_cols).orderBy(_BLK)
        extra += [F.lead(F.col("_head")[c]).over(after).alias(f"_after_{c}") for c in next_cols]
    offsets = totals.select(_BLK, *part_cols, *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols], *extra)
    # offsets has at most #blocks + #groups rows (groups are contiguous in the
    # range order).  Without groups that is bounded by the block count ->
    # broadcast; with groups (possibly many) AQE checks the size at run time.
    offsets = offsets.select(F.col(_BLK).alias("_oblk"), *[F.col(c).alias(f"_o_{c}") for c in part_cols],
                             *[c for c in offsets.columns if c.startswith(("_off_", "_tot_", "_after_"))])
    offsets = offsets if part_cols else F.broadcast(offsets)
    # NULL-safe on the group columns: a NULL group is a group, not lost rows
    cond = F.col(_BLK) == F.col("_oblk")
    for c in part_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    joined = blk.join(offsets, cond, "inner").drop("_oblk", *[f"_o_{c}" for c in part_cols])
    within = (Window.partitionBy(_BLK, *part_cols).orderBy(*_order_exprs(order_cols, descending))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = Window.partitionBy(_BLK, *part_cols).orderBy(*_order_exprs(order_cols, descending))
    more = [F.when(F.lead(F.lit(1)).over(ahead).isNull(), F.col(f"_after_{c}")).otherwise(F.lead(c).over(ahead))
            .alias(f"next_{c}") for c in next_cols]
    if totals_prefix:
        more += [F.col(f"_tot_{c}").alias(f"{totals_prefix}{c}") for c in sum_cols]
    return joined.select(*[c for c in df.columns], *[
        (F.sum(c).over(within) + F.col(f"_off_{c}")).alias(f"{prefix}{c}") for c in sum_cols], *more)


def global_rank(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence,
                descending: bool = False, n_blocks: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """Exact 1-based ``row_number`` within ``part_cols`` (skew-safe)."""
    out = running_sums(df.withColumn("_one", F.lit(1)), part_cols, order_cols, ["_one"],
                       descending=descending, n_blocks=n_blocks)
    return out.withColumnRenamed("cum__one", rank_col).drop("_one")


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                    k: int, rank_col: str = "rank", descending: bool = False) -> DataFrame:
    """First ``k`` rows per group by an explicit total order.

    ``row_number() <= k`` lets Spark keep only the first ``k`` rows of a group
    in every partition before the shuffle (its window group limit), so a hot
    group is never gathered.  NULLs come first ascending and last descending;
    NaN is the largest number.
    """
    w = Window.partitionBy(*group_cols).orderBy(*_order_exprs(order_cols, descending))
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).filter(F.col(rank_col) <= k)
