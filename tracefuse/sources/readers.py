"""Scans of raw telemetry and tabular inputs.

All readers declare their schema (no inference pass over the data) and
return lazy DataFrames; file names come from the ``_metadata`` column.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefuse.functions.contracts import SYSDIG_SENTINEL
from tracefuse.operators.counting import extract_calls
from tracefuse.operators.ranking import global_rank
from tracefuse.session import hadoop_path

SYSDIG_STATUSES = ("ok", "blank", "sentinel", "short", "bad_time")
MANIFEST_SCHEMA = "container string, label int, start_ts bigint, end_ts bigint"
PACKET_SCHEMA = ("frame_len double, ip_proto string, tcp_dstport int, udp_dstport int, "
                 "t double")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Headered CSV with an explicit schema (S1), bound by column name.

    Column order in the file does not matter and columns outside ``schema`` are
    ignored; a missing column is an error, and so is a file whose header
    differs from the first one's.  Values that do not parse are NULL.  Without
    a header the schema binds by position.
    """
    fields = T.StructType.fromDDL(schema).fields
    if not header:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    names = spark.read.option("header", True).csv(path).columns  # reads one line
    missing = [f.name for f in fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in {names}")
    # text columns in file order; enforceSchema=False compares every file's header with them
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(text).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name)
                         if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in fields])


def _file_name() -> F.Column:
    """Name of the file a row came from; Spark's metadata column has it percent-encoded (and '+' as it is)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def file_inventory(spark: SparkSession, directory: str | Sequence[str], glob: str) -> DataFrame:
    """(file, bytes) per file of a folder or of several, empty ones included (K1's input, S3, S4, S10).

    Each folder is listed by a task, from metadata alone: nothing is opened and
    no name passes the driver.  (Spark's own scans leave out files of length
    zero.)  Hidden files are skipped, as Spark skips them.
    """
    folders = []
    for d in [directory] if isinstance(directory, str) else directory:
        fs, at = hadoop_path(spark, d)
        folders.append((fs.makeQualified(at).toString(),))

    def listed(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                store, base = pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
                found = [(f.base_name, f.size) for f in store.get_file_info(pafs.FileSelector(base))
                         if f.is_file and f.base_name[:1] not in "._" and fnmatch.fnmatchcase(f.base_name, glob)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()),
                                                  pa.array([n for _, n in found], pa.int64())], ["file", "bytes"])

    return spark.createDataFrame(folders, "folder string").repartition(len(folders)).mapInArrow(listed, "file string, bytes bigint")


def list_files(spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """One row (``file``) per file of a directory, empty ones included; contents are not read."""
    return file_inventory(spark, directory, glob).select("file")


def in_order(df: DataFrame, order_cols: Sequence[str], place: str = "place") -> DataFrame:
    """K1: rows with their place (from 1) in an order, ranked in range blocks; order the result by ``place`` to print it."""
    return global_rank(df, [], order_cols, rank_col=place)


def preview(df: DataFrame, order_cols: Sequence[str], n: int = 5) -> DataFrame:
    """K7: the first ``n`` rows in an order; each task keeps its first ``n`` only."""
    return df.orderBy(*order_cols).limit(n)


def parse_sysdig(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Whitespace-delimited ``container epoch_seconds syscall`` lines.

    Returns every line with a ``status``: ``ok``, ``blank``, ``sentinel``,
    ``short`` (< 3 tokens) or ``bad_time`` (non-integer time, counted instead
    of failing the job).  Extra tokens are ignored; the syscall is lowercased.
    """
    v = F.regexp_replace(F.col(value_col), r"^\s+|\s+$", "")
    toks = F.split(v, r"\s+")
    ts = F.get(toks, 1).try_cast("bigint")
    status = (F.when(v == "", "blank")
              .when(v.startswith(SYSDIG_SENTINEL), "sentinel")
              .when(F.size(toks) < 3, "short")
              .when(ts.isNull(), "bad_time")
              .otherwise("ok"))
    return lines.select(F.get(toks, 0).alias("container"), ts.alias("ts_s"),
                        F.lower(F.get(toks, 2)).alias("syscall"), status.alias("status"))


def read_sysdig(spark: SparkSession, path: str) -> DataFrame:
    return parse_sysdig(spark.read.text(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Capture manifest ``container,label,start_ts,end_ts``."""
    return read_csv(spark, path, MANIFEST_SCHEMA)


def read_strace_logs(spark: SparkSession, directory: str, glob: str = "*.log") -> DataFrame:
    """One key per ``*.log`` file; each line's first call-like name (S3, P10).
    A file without a call has no row here; ``list_files`` names it.  Malformed bytes decode to replacement characters instead of failing."""
    lines = (spark.read.option("pathGlobFilter", glob).text(directory)
             .select(_file_name().alias("file"), F.col("value").alias("line")))
    return extract_calls(lines, "line", "syscall").select("file", "syscall")


def parse_packets(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Tab-separated packet rows (S4) with a ``status``: ``ok`` or ``short`` (under five fields).

    Fields: frame length, IP protocol, TCP and UDP destination ports, epoch
    time; any may be empty or unparseable (NULL).  Further fields are ignored.
    """
    part = F.split(F.regexp_replace(F.col(value_col), r"[\r\n]+$", ""), "\t")
    other = [F.col(c) for c in lines.columns if c != value_col]
    cols = []
    for i, field in enumerate(T.StructType.fromDDL(PACKET_SCHEMA).fields):
        raw = F.nullif(F.trim(F.get(part, i)), F.lit(""))
        cols.append((raw if isinstance(field.dataType, T.StringType) else raw.try_cast(field.dataType)).alias(field.name))
    return lines.select(*other, *cols, F.when(F.size(part) < 5, "short").otherwise("ok").alias("status"))


def read_packets(spark: SparkSession, path: str, glob: str = "*.tsv") -> DataFrame:
    """Decoded packet rows, one file per capture (S4); rows with under five fields are rejected.

    ``ordinal`` is the packet's place in its file: the byte offset of its split,
    then the row's number in the task that reads the split.
    """
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(38,0)")
    place = F.col("_metadata.file_block_start").cast("decimal(27,0)") * F.lit(1 << 33).cast("decimal(10,0)") + row_in_task
    lines = (spark.read.option("pathGlobFilter", glob).text(path)
             .select(_file_name().alias("file"), place.cast("decimal(38,0)").alias("ordinal"), "value"))
    return parse_packets(lines).filter(F.col("status") == "ok").drop("status")


def read_tagged_tables(spark: SparkSession, directory: str, schema: str,
                       pattern: str = r"^features_([A-Za-z0-9]+)\.csv$", glob: str = "features_*.csv") -> DataFrame:
    """Per-window feature files as one table with a ``window_tag`` column.

    Only files whose whole name matches count; columns bind by name.  An
    absent tag simply has no rows.
    """
    tables = list_files(spark, directory, glob).filter(F.col("file").rlike(pattern))
    out = None
    # one small plan per window file (a handful); each file's own header names its columns
    for name in sorted(r.file for r in tables.collect()):
        one = read_csv(spark, f"{directory.rstrip('/')}/{name}", schema)
        one = one.withColumn("window_tag", F.regexp_extract(F.lit(name), pattern, 1))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("window_tag", F.lit(""))
    return out


def with_capture_mode(df: DataFrame, mode: str) -> DataFrame:
    """Provenance column recording how the features were produced."""
    return df.withColumn("capture_mode", F.lit(mode))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Empty-input guard at the API edge (S11): raise instead of writing nothing."""
    if df.isEmpty():
        raise ValueError(f"no rows found for {what}")
    return df
