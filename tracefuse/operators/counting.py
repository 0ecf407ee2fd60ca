"""Event counting, detection windows and schema alignment.

Covers alias lookup and contract membership (J4, J5), per-key feature counts
(A1, A2, A4), labelled key lists (J6), manifest lookup and elapsed-time
windows (J3, P19, A3), contract alignment and drift (P17, P18, U3), and the
top-k / non-zero summaries of a count table (K3, P25).

Counting always goes through ``groupBy(key, feature).count()`` first: a
partial aggregate, so even a container with a third of all events is reduced
map-side before the shuffle, and the wide table is built from that small
long table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefuse.functions.contracts import CALL_GROUP, CALL_PATTERN, SYSCALL_ALIASES
from tracefuse.session import fits_broadcast, fixed_table, join_dimension, salted_join

TOTAL = "total_events"


def contract_features(contract: Sequence[str]) -> list[str]:
    return [c for c in contract if c != TOTAL]


def map_syscalls(events: DataFrame, name_col: str = "syscall",
                 aliases: Mapping[str, str] | None = SYSCALL_ALIASES,
                 contract: Sequence[str] | None = None,
                 feature_col: str = "feature") -> DataFrame:
    """Name -> feature (J4) and contract membership.

    ``aliases=None`` is the strace mode: ``evt_<name>`` with no aliasing and
    nothing dropped here.  With aliases, unmapped names are dropped by an
    inner join with the fixed alias table (153 rows, broadcast).
    """
    spark = events.sparkSession
    if aliases is None:
        out = events.withColumn(feature_col, F.concat(F.lit("evt_"), F.col(name_col)))
    else:
        table = fixed_table(spark, list(aliases.items()), f"{name_col} string, {feature_col} string")
        out = join_dimension(events, table, name_col, bounded=True)
    if contract is not None:
        keep = fixed_table(spark, [(f,) for f in contract_features(contract)], f"{feature_col} string")
        out = join_dimension(out, keep, feature_col, how="left_semi", bounded=True)
    return out


def long_counts(events: DataFrame, key_cols: Sequence[str], feature_col: str = "feature",
                weight_col: str | None = None) -> DataFrame:
    """(key..., feature, n): the one heavy aggregation (A4 long form).
    ``weight_col`` accepts pre-aggregated events (a count per row)."""
    n = F.count(F.lit(1)) if weight_col is None else F.sum(weight_col).cast("bigint")
    return events.groupBy(*key_cols, feature_col).agg(n.alias("n"))


def widen(long: DataFrame, key_cols: Sequence[str], contract: Sequence[str],
          feature_col: str = "feature", count_col: str = "n", total: str = "mapped") -> DataFrame:
    """Long counts -> one column per contract feature, in contract order.

    Features outside the contract are dropped; absent ones are 0.  ``total``:
    ``mapped`` = sum of the kept features (sysdig path), ``all`` = every
    counted name including dropped ones (strace path) (A2).
    """
    feats = contract_features(contract)
    f, n = F.col(feature_col), F.col(count_col)
    in_contract = f.isin(feats)
    aggs = {c: F.coalesce(F.sum(F.when(f == c, n)), F.lit(0)).cast("double") for c in feats}
    if total == "mapped":
        aggs[TOTAL] = F.coalesce(F.sum(F.when(in_contract, n)), F.lit(0)).cast("double")
    elif total == "all":
        aggs[TOTAL] = F.coalesce(F.sum(n), F.lit(0)).cast("double")
    else:
        raise ValueError(f"unknown total mode {total!r}")
    wide = long.groupBy(*key_cols).agg(*[e.alias(c) for c, e in aggs.items()])
    return wide.select(*key_cols, *[F.col(f"`{c}`") for c in contract])


def with_all_keys(wide: DataFrame, keys: DataFrame, key_cols: Sequence[str],
                  contract: Sequence[str]) -> DataFrame:
    """Every declared key gets a row, 0-filled when it produced no events."""
    out = keys.join(wide, list(key_cols), "left")
    return out.fillna(0.0, subset=list(contract))


def restrict_to(events: DataFrame, keys: DataFrame, key_cols: Sequence[str],
                max_rows: int | None = None) -> DataFrame:
    """Container allow-list (P20): keep events of declared keys only, as a
    semi join before any aggregation (case-sensitive equality)."""
    return join_dimension(events, keys.select(*key_cols), list(key_cols), how="left_semi",
                          max_rows=max_rows)


def count_features(events: DataFrame, key_cols: Sequence[str], contract: Sequence[str],
                   feature_col: str = "feature", total: str = "mapped",
                   keys: DataFrame | None = None) -> DataFrame:
    """A1: events (key, feature) -> wide contract table, optionally over all declared keys
    (undeclared keys are dropped before counting, declared keys without events get 0s)."""
    long = long_counts(events, key_cols, feature_col)
    if keys is not None:
        # counted first: the allow-list meets one row per key and feature, however hot a key is
        long = restrict_to(long, keys, key_cols)
    wide = widen(long, key_cols, contract, feature_col, total=total)
    if keys is not None:
        wide = with_all_keys(wide, keys, key_cols, contract)
    return wide


def attach_start(events: DataFrame, manifest: DataFrame, key_col: str,
                 start_col: str = "start_ts", manifest_max_rows: int | None = None,
                 salt_buckets: int | None = None, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """Manifest lookup with default (J3): a key missing from the manifest starts at 0.

    Broadcast when the manifest has at most ``manifest_max_rows`` rows and its
    bytes fit; otherwise a shuffle join, salted over ``salt_buckets`` when given (a container with a
    third of all events is then spread over that many tasks; without it AQE's
    skew-join splitting is relied on).
    """
    m = manifest.select(key_col, start_col)
    small = manifest_max_rows is not None and fits_broadcast(m, manifest_max_rows)
    if salt_buckets and not small:
        out = salted_join(events, m, key_col, how="left", buckets=salt_buckets, salt_cols=salt_cols)
    else:
        out = join_dimension(events, m, key_col, how="left", bounded=small)
    return out.withColumn(start_col, F.coalesce(F.col(start_col), F.lit(0)).cast("bigint"))


def window_long_counts(events: DataFrame, key_col: str, ts_col: str, windows: Mapping[str, int | None],
                       feature_col: str = "feature", start_col: str = "start_ts",
                       unit_seconds: int = 1, weight_col: str | None = None) -> DataFrame:
    """All detection windows in one pass.

    An event belongs to window N when ``ts - start <= N`` (inclusive; events
    before the start are kept); ``None`` is the unfiltered window.  Windows
    are nested, so one aggregate of conditional counts serves them all; the
    reference's one-scan-per-window-per-container becomes a single scan.
    Returns (window_tag, key, feature, n).
    """
    elapsed = F.col(ts_col) - F.col(start_col)
    one = F.lit(1) if weight_col is None else F.col(weight_col).cast("bigint")
    tags = list(windows)
    aggs = []
    for tag in tags:
        n = windows[tag]
        cond = F.lit(True) if n is None else elapsed <= F.lit(int(n) * unit_seconds)
        aggs.append(F.sum(F.when(cond, one).otherwise(0)).alias(f"_w_{tag}"))
    per = events.groupBy(key_col, feature_col).agg(*aggs)
    stacked = per.select(key_col, feature_col, F.explode(F.array(*[
        F.struct(F.lit(t).alias("window_tag"), F.col(f"_w_{t}").alias("n")) for t in tags
    ])).alias("_w")).select("_w.window_tag", key_col, feature_col, "_w.n")
    return stacked.filter(F.col("n") > 0)


def window_features(events: DataFrame, manifest: DataFrame, key_col: str, ts_col: str,
                    contract: Sequence[str], windows: Mapping[str, int | None],
                    keys: DataFrame | None = None, feature_col: str = "feature",
                    total: str = "mapped", unit_seconds: int = 1,
                    manifest_max_rows: int | None = None, restrict: bool = True,
                    salt_buckets: int | None = None, weight_col: str | None = None) -> DataFrame:
    """Wide (window_tag, key, contract...) feature tables for every window at once.

    With ``keys``, every declared key gets a row per window and (``restrict``)
    events of undeclared keys are dropped before counting; pass
    ``restrict=False`` when the keys are derived from the events themselves.
    A manifest of at most ``manifest_max_rows`` rows (its bytes are checked too)
    is broadcast and the events are counted once, combined before their only
    shuffle, by (key, name).  A larger one is joined by shuffle after the events
    are rolled up per (key, second, name), so a hot key reaches it, salted when
    asked, as one row per second and name.
    ``weight_col`` accepts events already rolled up per (key, second, name) with
    a count, which shrinks the join and the shuffle for high-rate captures.
    """
    if manifest_max_rows is not None and fits_broadcast(manifest.select(key_col, "start_ts"), manifest_max_rows):
        starts = F.broadcast(manifest.select(key_col, "start_ts"))
        ev = events.join(starts, key_col, "left").withColumn("start_ts", F.coalesce("start_ts", F.lit(0)).cast("bigint"))
        long = window_long_counts(ev, key_col, ts_col, windows, feature_col, unit_seconds=unit_seconds,
                                  weight_col=weight_col)
        if keys is not None and restrict:
            long = restrict_to(long, keys, [key_col])
    else:
        one = F.lit(1) if weight_col is None else F.col(weight_col).cast("bigint")
        rolled = events.groupBy(key_col, ts_col, feature_col).agg(F.sum(one).alias("_n"))
        if keys is not None and restrict:
            rolled = restrict_to(rolled, keys, [key_col])
        ev = attach_start(rolled, manifest, key_col, salt_buckets=salt_buckets, salt_cols=[ts_col, feature_col])
        long = window_long_counts(ev, key_col, ts_col, windows, feature_col, unit_seconds=unit_seconds, weight_col="_n")
    wide = widen(long, ["window_tag", key_col], contract, feature_col, total=total)
    if keys is not None:
        all_keys = keys.withColumn("window_tag", F.explode(F.array(*[F.lit(t) for t in windows])))
        wide = with_all_keys(wide, all_keys, ["window_tag", key_col], contract)
    return wide


def align(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Wide-table schema alignment (P17): add missing contract columns as ``fill``,
    drop extras, fix the order.  Column-set work is on the schema only."""
    present = set(df.columns)
    cols = [F.col(c) for c in keep]
    for c in contract:
        if c in present:
            cols.append(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill)).alias(c))
        else:
            cols.append(F.lit(fill).cast("double").alias(c))
    return df.select(*cols)


def column_drift(columns: Sequence[str], contract: Sequence[str], keep: Sequence[str] = ()) -> dict:
    """Missing / extra columns of a wide table against a contract (U3, schema only)."""
    cols = [c for c in columns if c not in keep]
    return {"missing": [c for c in contract if c not in cols],
            "extra": [c for c in cols if c not in contract]}


def drift_report(long: DataFrame, contract: Sequence[str], feature_col: str = "feature",
                 count_col: str = "n", key_col: str | None = None) -> DataFrame:
    """Per-feature drift between observed counts and a contract.

    status: ``kept`` (observed, in contract), ``dropped`` (observed, not in
    contract: silently lost by alignment), ``missing`` (in contract, never
    observed: 0-filled by alignment).
    """
    spark = long.sparkSession
    aggs = [F.sum(count_col).alias("n_events")]
    if key_col is not None:
        aggs.insert(0, F.countDistinct(key_col).alias("n_keys"))
    seen = long.groupBy(feature_col).agg(*aggs).withColumn("_seen", F.lit(True))
    con = fixed_table(spark, [(f,) for f in contract_features(contract)],
                      f"{feature_col} string").withColumn("_con", F.lit(True))
    j = seen.join(con, feature_col, "full_outer")
    status = (F.when(F.col("_seen").isNull(), "missing")
              .when(F.col("_con").isNull(), "dropped").otherwise("kept"))
    out = [feature_col, status.alias("status")]
    if key_col is not None:
        out.append(F.coalesce(F.col("n_keys"), F.lit(0)).cast("bigint").alias("n_keys"))
    out.append(F.coalesce(F.col("n_events"), F.lit(0)).cast("bigint").alias("n_events"))
    return j.select(*out)


def extract_calls(lines: DataFrame, line_col: str = "line", out_col: str = "syscall") -> DataFrame:
    """First call-like identifier of each line (P10); lines without one are dropped."""
    name = F.regexp_extract(F.col(line_col), CALL_PATTERN, CALL_GROUP)
    return lines.withColumn(out_col, name).filter(F.col(out_col) != "")


def top_features(long: DataFrame, key_cols: Sequence[str], k: int = 5,
                 feature_col: str = "feature", count_col: str = "n",
                 include_total: bool = True) -> DataFrame:
    """Top-k features per key by count (desc), name (asc) as tie-break (K3).

    The window partitions by key over the *aggregated* table, so a partition
    holds one row per observed feature of that key (bounded by the feature
    vocabulary, not by the number of events).
    """
    key_cols = list(key_cols)
    src = long.select(*key_cols, feature_col, count_col)
    if include_total:
        totals = long.groupBy(*key_cols).agg(F.sum(count_col).alias(count_col)) \
            .withColumn(feature_col, F.lit(TOTAL)).select(*key_cols, feature_col, count_col)
        src = src.unionByName(totals)
    w = Window.partitionBy(*key_cols).orderBy(F.desc(count_col), F.asc(feature_col))
    return src.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def nonzero_features(long: DataFrame, key_cols: Sequence[str], count_col: str = "n",
                     include_total: bool = True) -> DataFrame:
    """Number of non-zero features per key (P25); ``total_events`` counts once when > 0."""
    nz = F.sum(F.when(F.col(count_col) > 0, 1).otherwise(0))
    if include_total:
        nz = nz + F.when(F.sum(count_col) > 0, 1).otherwise(0)
    return long.groupBy(*key_cols).agg(nz.cast("bigint").alias("nonzero_features"))


def contract_report(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Contract violations as a table (P18): per contract column whether it stands
    in its place and how many values are NULL or NaN (all rows if it is absent)."""
    cols = [c for c in df.columns if c not in keep]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(contract):
        v = F.col(f"`{c}`").cast("double") if c in cols else F.lit(None).cast("double")
        aggs.append(F.sum((v.isNull() | F.isnan(v)).cast("bigint")).alias(f"_bad{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                              F.lit(int(i < len(cols) and cols[i] == c)).alias("in_place"),
                              F.coalesce(F.col(f"_bad{i}"), F.lit(0)).cast("bigint").alias("n_missing"))
                     for i, c in enumerate(contract)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def assert_contract(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = (),
                    expected_rows: int | None = None) -> None:
    """Schema contract checks (P18): column order, no NULL/NaN, optional row count.
    Order is checked on the schema; NULLs with one aggregate; rows with a count."""
    cols = [c for c in df.columns if c not in keep]
    if cols != list(contract):
        raise AssertionError("column order does not match the contract")
    bad = F.lit(0)
    for c in contract:
        v = F.col(f"`{c}`")
        bad = bad + F.sum((v.isNull() | F.isnan(v)).cast("int"))
    row = df.agg(bad.alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if row["bad"]:
        raise AssertionError(f"{row['bad']} NULL/NaN values after alignment")
    if expected_rows is not None and row["n"] != expected_rows:
        raise AssertionError(f"row count {row['n']} != {expected_rows}")
