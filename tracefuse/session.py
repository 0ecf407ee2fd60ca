"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "tracefuse", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_settings(input_bytes: int, target_partition_bytes: int = 256 << 20,
                     max_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized for a large input (e.g. 100 TB on ~1000 executors).

    Scan splits and post-shuffle partitions both aim at ``target_partition_bytes``
    so a task's share fits executor memory (and spills, not fails, beyond it).
    The initial shuffle partition count follows the input size; AQE then
    coalesces small partitions (most shuffles here move pre-aggregated rows)
    and splits skewed ones (a key holding a third of the rows).
    """
    parts = max(8, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


#: (application, folder) of the mounted folders that driver and executors were seen to share
_SHARED: set[tuple[str, str]] = set()


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Raises unless driver and executors see each other's files in ``folder``, a ``file:`` path.

    Such a path may be a mount of all machines (NFS, a cluster volume) or a disk
    of each machine, and its name does not tell.  So a row for every core is
    written there, one file each, and read back, once per folder.
    """
    sc = spark.sparkContext
    if (sc.applicationId, folder) in _SHARED:
        return
    refusal = f"spark.checkpoint.dir must be on a shared file system, not {folder}"
    n, path = max(2, sc.defaultParallelism), f"{folder}/shared-{uuid.uuid4().hex}"
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        found = spark.read.schema("id bigint").parquet(path).count()
    except Exception as e:
        raise RuntimeError(refusal) from e
    finally:
        fs, at = hadoop_path(spark, path)
        fs.delete(at, True)
    if found != n:
        raise RuntimeError(refusal)
    _SHARED.add((sc.applicationId, folder))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster a mounted folder is tried before its first use and refused if
    the machines do not share it.  A private temporary folder is only chosen in
    local mode (tests) when the setting is absent; on a cluster a missing
    setting is an error, because a machine-local folder would not survive the
    loss of that machine.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local")  # local-cluster masters too: on one machine a file: folder is shared
    if not sc.getCheckpointDir():
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not local:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tracefuse-ckpt-"))
    folder = sc.getCheckpointDir()
    if not local and hadoop_path(spark, folder)[0].getUri().getScheme() == "file":
        _require_shared(spark, folder)
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Spark's own file layer, for renames and clean-up on any storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder under the shared checkpoint folder, removed afterwards."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        fs, at = hadoop_path(spark, path)
        fs.delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder (reliable, not local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Cheap bounded size check: reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def fits_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 256 << 20) -> bool:
    """Whether ``df`` is proven small: at most ``max_rows`` rows (no more than one above is read)
    whose values, strings at their length and others at 16 bytes, add up to at most ``max_bytes``."""
    size = F.lit(0)
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        size = size + 16 + (F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if text else 0)
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("bytes")).first()
    return row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int | None = None, bounded: bool = False) -> DataFrame:
    """Join a dimension table onto a fact table.

    * ``bounded=True``: the caller proves the size (a fixed literal table) -> broadcast.
    * ``max_rows``: broadcast only when a limit-count check passes, otherwise
      a shuffle join.  Use it for dimensions read straight from storage.
    * neither: no hint; AQE measures the dimension's shuffle output at run time
      and converts to a broadcast join only below its threshold.  Use it for
      dimensions derived from a large aggregation, so it is not computed twice.
    """
    if bounded or (max_rows is not None and has_at_most(dim, max_rows)):
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)


def salted_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                buckets: int = 16, salt_cols=None) -> DataFrame:
    """Shuffle join that spreads a hot key over ``buckets`` tasks.

    For a dimension too large to broadcast while one key may hold a large
    share of the fact rows: fact rows get a salt in [0, buckets) (row id
    modulo buckets: stable under task retry, and it separates identical
    rows), the dimension is replicated once per salt, and the salt joins too.
    Every fact row still meets each matching dimension row exactly once.
    ``salt_cols`` takes the salt from their hash instead: use it when the fact
    rows come from a shuffle, whose row order a repeated task need not keep.
    """
    on = [on] if isinstance(on, str) else list(on)
    salt = F.pmod(F.xxhash64(*salt_cols), F.lit(buckets)) if salt_cols else F.monotonically_increasing_id() % buckets
    f = fact.withColumn("_salt", salt.cast("int"))
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return f.join(d, [*on, "_salt"], how).drop("_salt")


def fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal lookup table (alias map, contract, declared keys).

    Built as an inline array of literal structs, so the table is part of the
    JVM plan (no Python-side RDD, no Python worker at run time).
    """
    st = T.DataType.fromDDL(schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)])
               for r in rows]
    if not structs:
        return spark.createDataFrame([], st)
    return spark.range(1).select(F.inline(F.array(*structs)))
