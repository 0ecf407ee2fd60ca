"""How the driver's tables stand in for telemetry.

The driver tables are not syscall traces or captures, so each operator runs
on an analogous projection that keeps the operator's semantics and grows
with the data.  Every stand-in reads whole tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.functions.scalar import epoch_seconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Events: user_id plays the container, event_type the syscall name.
EVENT_ALIASES = {"view": "evt_read", "click": "evt_read", "purchase": "evt_write",
                 "signup": "evt_openat"}          # "error" stays unmapped
EVENT_CONTRACT = ["total_events", "evt_read", "evt_write", "evt_openat", "evt_close"]
DECLARED_CONTAINERS = 12                           # ids 10 and 11 never emit events
STRACE_CONTRACT = ["total_events", "evt_click", "evt_view", "evt_purchase", "evt_signup",
                   "evt_logout"]
PAGE_CONTRACT = ["total_events", "evt_track", "evt_open", "evt_read"]
DAY = 86400
WINDOW_DAYS = {"N3": 3, "N5": 5, "N10": 10, "N15": 15, "full": None}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels -> (doc_id, scenario, y, p_sys, p_net): deterministic scores."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        "doc_id", F.col("toxic").cast("int").alias("scenario"), F.col("quality").cast("int").alias("y"),
        ((F.col("doc_id") * 7919) % 1000 / 1000).alias("p_sys"),
        ((F.col("doc_id") * 104729) % 1000 / 1000).alias("p_net"))


def hash_order(col: str) -> F.Column:
    """Cross-engine deterministic shuffle key (instead of an engine hash)."""
    return (F.col(col) * 7919) % 10007


def window_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, manifest, keys) for the detection-window features.

    The manifest starts each user at their first signup; users who never
    signed up are absent from it (start 0), as a container missing from a
    capture manifest would be.
    """
    ev = events(spark, sf_dir).select(F.col("user_id").alias("container"),
                                      epoch_seconds("ts").alias("ts_s"),
                                      F.col("event_type").alias("syscall"))
    manifest = (ev.filter(F.col("syscall") == "signup").groupBy("container")
                .agg(F.min("ts_s").alias("start_ts")))
    keys = ev.select("container").distinct().withColumn(
        "label", ((F.col("container") % 3) == 0).cast("int"))
    return ev, manifest, keys


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as decoded packets of one capture per supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("capture"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).alias("frame_len"),
        F.when(F.col("l_returnflag") == "R", "6").when(F.col("l_returnflag") == "A", "17")
         .otherwise("6,17").alias("ip_proto"),
        F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("tcp_dstport"),
        F.when(F.col("l_tax") > 0, F.col("l_partkey") + 100000).alias("udp_dstport"),
        F.when(F.col("l_linenumber") != 7, epoch_seconds("l_shipdate").cast("double")).alias("t"),
        # packet order (second, order, line, part) packed into one primitive: the
        # "first port" aggregate then stays hash-based
        (epoch_seconds("l_shipdate").cast("decimal(11,0)") * F.lit(Decimal(10 ** 26))
         + F.col("l_orderkey").cast("decimal(13,0)") * F.lit(Decimal(10 ** 13))
         + F.col("l_linenumber").cast("decimal(2,0)") * F.lit(Decimal(10 ** 11))
         + F.col("l_partkey").cast("decimal(11,0)")).cast("decimal(38,0)").alias("ordinal"))


PACKET_ORDER = ["ordinal"]


def capture_file_name(capture_col: str = "capture") -> F.Column:
    """File name of a capture; applied after aggregation (one row per capture)."""
    c = F.col(capture_col)
    return F.concat(F.when(c % 4 == 0, "mal_").otherwise(""), F.lit("cap"), c.cast("string"),
                    F.lit("_network.pcap"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a raw training table: numerics, a boolean, a string, a
    constant column and an all-NULL column, with many exact duplicates."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_quantity", "l_discount", "l_tax", "l_linenumber",
        (F.col("l_linestatus") == "O").alias("is_open"),
        "l_returnflag",
        F.lit(1.0).alias("const_one"),
        F.when(F.col("l_returnflag") == "Z", F.lit(1.0)).alias("sparse"),
        (F.col("l_returnflag") == "R").cast("int").alias("label_bin"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> syscall log and capture file names with label markers."""
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 4
    prefix = (F.when(m == 0, "mal_").when(m == 1, "MAL_").when(m == 2, "benign_")
              .otherwise("malicious-"))
    sys_file = F.concat(prefix, F.col("source"), F.lit(".logs_"), F.col("lang"), F.lit(".log"))
    net_file = F.concat(prefix, F.col("source"), F.lit("_network.pcap"))
    return d.select("doc_id", sys_file.alias("sys_file"), net_file.alias("net_file"))


def embedding_rows(spark: SparkSession, sf_dir: str, dims: int = 64) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf_dir, "embeddings")
    cols = [f"f{i}" for i in range(dims)]
    df = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"),
                  *[F.get(F.col("embedding"), i).cast("double").alias(c) for i, c in enumerate(cols)])
    return df, cols


def sysdig_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events rendered as sysdig text lines, with the malformed kinds a real
    capture produces: 'error' events lose their syscall token (short line),
    low-value events carry a non-numeric time, purchases are upper-case and
    carry an extra token, views are padded with tabs and spaces."""
    ev = events(spark, sf_dir)
    who = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    ts = epoch_seconds("ts").cast("string")
    line = (F.when(F.col("event_type") == "error", F.concat_ws(" ", who, ts))
            .when(F.col("value") < 2, F.concat_ws(" ", who, F.concat(F.lit("t"), ts), F.col("event_type")))
            .when(F.col("event_type") == "purchase", F.concat_ws(" ", who, ts, F.upper("event_type"), F.lit("extra")))
            .when(F.col("event_type") == "view", F.concat(F.lit(" \t"), who, F.lit("\t "), ts, F.lit("  "),
                                                            F.col("event_type"), F.lit("\t")))
            .otherwise(F.concat_ws(" ", who, ts, F.col("event_type"))))
    return ev.select(line.alias("value"))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a training table whose models SQL can reproduce: y mostly agrees
    with quality where x = 0 and mostly disagrees where x = 1."""
    lab = table(spark, sf_dir, "labels")
    x, q = (F.col("doc_id") % 2).cast("double"), F.col("quality").cast("int")
    return lab.select("doc_id", x.alias("x"), (F.col("doc_id") % 3).cast("double").alias("z"),
                      F.when(x == 0, q).otherwise(1 - q).alias("y"))


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tab-separated packet lines; every seventh line item is cut to three fields."""
    li = table(spark, sf_dir, "lineitem")
    blank = F.lit("")
    full = [F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("string")).otherwise(blank),
            F.when(F.col("l_returnflag") == "R", "6").when(F.col("l_returnflag") == "A", "17").otherwise("6,17"),
            F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).otherwise(blank),
            F.when(F.col("l_tax") > 0, F.col("l_partkey").cast("string")).otherwise("port?"),
            epoch_seconds("l_shipdate").cast("string")]
    return li.select(F.when(F.col("l_linenumber") == 7, F.concat_ws("\t", *full[:3]))
                     .otherwise(F.concat_ws("\t", *full)).alias("value"))


def write_page_logs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Pages as trace logs, one file per eight pages and one call a line; every third file is empty.

    Written by the tasks with pyarrow's file systems: Spark's own writers name
    their files themselves and write no empty ones.
    """
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).cast("bigint").alias("site"), "page_id", "url")
    line = F.concat(F.lit("call"), (F.col("page_id") % 5).cast("string"), F.lit("("), F.col("url"), F.lit(")\n"))
    files = pages.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body")).select(
        F.concat(F.when(F.col("site") % 4 == 0, "mal_").otherwise("site_"), F.col("site").cast("string"), F.lit(".log")).alias("file"),
        F.when(F.col("site") % 3 == 0, "").otherwise(F.col("body")).alias("body"))

    def write(rows) -> None:
        from pyarrow import fs
        uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r.file}") as out:
                out.write(r.body.encode())

    files.foreachPartition(write)
