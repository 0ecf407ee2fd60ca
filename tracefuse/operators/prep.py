"""Training-table preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefuse.functions.contracts import LABEL_CANDIDATES, METADATA_COLUMNS

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def drop_metadata(df: DataFrame, cols: Sequence[str] = METADATA_COLUMNS) -> DataFrame:
    """Drop ``id`` / ``folder`` when present."""
    return df.drop(*[c for c in cols if c in df.columns])


def select_features(df: DataFrame, prefix: str = "evt_", extra: Sequence[str] = ("total_events",)) -> list[str]:
    """Feature columns by prefix or name, in file order."""
    return [c for c in df.columns if c.startswith(prefix) or c in extra]


def resolve_label(columns: Sequence[str], candidates: Sequence[str] = LABEL_CANDIDATES) -> str | None:
    """First label candidate present."""
    return next((c for c in candidates if c in columns), None)


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with NULL or NaN in the key columns."""
    return df.na.drop(subset=list(subset))


def labelled_concat(parts: Mapping[int, DataFrame], label: str = "label") -> DataFrame:
    """One table from one table per class: the class becomes ``label``.

    Columns bind by name; a column that one part lacks is NULL there.
    """
    out = None
    for value, part in parts.items():
        part = part.withColumn(label, F.lit(int(value)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def booleans_to_int(df: DataFrame) -> DataFrame:
    """bool -> int (P5)."""
    return df.select(*[F.col(f"`{f.name}`").cast("int").alias(f.name)
                       if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def drop_string_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop string columns except ``keep``."""
    drop = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in keep]
    return df.drop(*drop)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-null, non-NaN value.

    One aggregate of min/max per column (algebraic, map-side combined) instead
    of a distinct count per column; only a row of 2 x columns values reaches
    the driver.
    """
    if not cols:
        return []
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        if types.get(c) in ("double", "float"):
            v = F.nanvl(v, F.lit(None).cast(types[c]))  # NaN is not a value, as NULL is not
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}")]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols)
            if row[f"mn{i}"] is None or row[f"mn{i}"] == row[f"mx{i}"]]


def to_numeric_or_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce to double, unparseable -> NULL -> 0, NaN -> 0."""
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            v = F.col(f"`{f.name}`").try_cast("double")
            out.append(F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


@dataclass
class PreparedTable:
    data: DataFrame
    label: str
    features: list[str]
    dropped_strings: list[str] = field(default_factory=list)
    dropped_constant: list[str] = field(default_factory=list)


def prepare_training(df: DataFrame, label: str) -> PreparedTable:
    """bool->int, drop strings, exact de-duplication, drop constant columns,
    coerce + fill 0 - in this order, which changes results (L10, A16)."""
    strings = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name != label]
    x = drop_string_columns(booleans_to_int(df), keep=[label])
    x = x.withColumn(label, F.col(label).try_cast("int"))
    feats = [c for c in x.columns if c != label]
    # de-duplication changes no column's extremes: constants are found on the
    # source in one pruned aggregate, and the de-duplicated table stays lazy
    const = constant_columns(x, feats)
    kept = [c for c in feats if c not in const]
    x = x.dropDuplicates()
    x = to_numeric_or_zero(x.select(*[F.col(f"`{c}`") for c in kept], label), kept)
    return PreparedTable(x, label, kept, strings, const)


def prepare_syscall(df: DataFrame, label: str) -> PreparedTable:
    """The syscall recipe: features by prefix or name, every row and column kept, blanks to 0."""
    feats = select_features(df)
    x = booleans_to_int(df).withColumn(label, F.col(label).try_cast("int"))
    x = to_numeric_or_zero(x.select(*[F.col(f"`{c}`") for c in feats], label), feats)
    return PreparedTable(x, label, feats)


#: training preparation by signal
PREPARE = {"network": prepare_training, "syscall": prepare_syscall}


def column_report(df: DataFrame, label: str) -> DataFrame:
    """Per numeric column after de-duplication: rows before/after, non-null
    count, min, max and the constant flag (A16 + P7 as a table)."""
    x = drop_string_columns(booleans_to_int(df), keep=[label])
    # one pass: the de-duplicating aggregate also counts the copies it folds
    dedup = x.groupBy(*[F.col(f"`{c}`") for c in x.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    feats = [f.name for f in dedup.schema.fields
             if f.name not in (label, "_copies") and isinstance(f.dataType, _NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("_rows"), F.sum("_copies").alias("_before")]
    for i, c in enumerate(feats):
        col = F.col(f"`{c}`").cast("double")
        aggs += [F.count(col).alias(f"n{i}"), F.min(col).alias(f"mn{i}"), F.max(col).alias(f"mx{i}")]
    wide = dedup.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_nonnull"),
                              F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"))
                     for i, c in enumerate(feats)])
    out = wide.select(F.col("_rows").alias("rows_after"), F.col("_before").cast("bigint").alias("rows_before"),
                      F.explode(rows).alias("r"))
    is_const = (F.col("r.n_nonnull") == 0) | (F.col("r.min_value") == F.col("r.max_value"))
    return out.select("r.column", "rows_before", "rows_after",
                      "r.n_nonnull", "r.min_value", "r.max_value", is_const.cast("int").alias("is_constant"))
