"""Command line: one Spark job per step of the detection workflow.

    python -m tracefuse sysdig-features --raw R --manifest M --containers C --out O
    python -m tracefuse strace-features --logs DIR --out O
    python -m tracefuse packet-features --packets DIR --out O
    python -m tracefuse train --table T [--label L] [--kind random_forest] [--recipe network] --model-out M --out O
    python -m tracefuse sweep --table T [--label L] [--recipe network] --model-out M --out O
    python -m tracefuse window-evaluate --model M --windows DIR --key K --label L --out O
    python -m tracefuse score --model M --table T --key K --label L --out O
    python -m tracefuse fuse --syscall S --network N --bridge B --out O
    python -m tracefuse evaluate --scores S --out O

Inputs ending in ``.csv`` are read as headered CSV (with the declared
schema where the format is known), anything else as parquet.  Outputs are
parquet folders (``--format csv`` for CSV).  Works under ``spark-submit``:
the session is taken from the environment when one exists.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.functions.contracts import LABEL_CANDIDATES
from tracefuse.functions.scalar import base_name
from tracefuse.operators import models
from tracefuse.plans import flows
from tracefuse.sources.readers import read_csv, read_tagged_tables
from tracefuse.sources.sinks import write_table

SYS_PRED = "file string, label int, pred int, p_sys double"
BRIDGE = "base string, network_base string"
PAIRED = "scenario string, y_true int, p_sys double, p_net double"
CONTAINERS = "container string, label int"
TEXT_COLUMNS = ("file", "container", "base", "network_base", "folder", "scenario", "window_tag", "capture_mode")


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    if path.endswith(".csv"):
        if schema:
            return read_csv(spark, path, schema)
        # typed by name, without a pass over the data: keys are text, labels whole numbers, the rest figures
        names = spark.read.option("header", True).csv(path).columns
        kind = {**dict.fromkeys(TEXT_COLUMNS, "string"), **dict.fromkeys(LABEL_CANDIDATES, "int")}
        return read_csv(spark, path, ", ".join(f"`{n}` {kind.get(n, 'double')}" for n in names))
    return spark.read.parquet(path)


def _write(df: DataFrame, path: str, fmt: str, partition_by=()) -> None:
    write_table(df, path, fmt=fmt, partition_by=partition_by)


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    out, fmt = args.out, args.format
    if args.cmd == "sysdig-features":
        status = flows.write_syscall_features(
            spark, args.raw, args.manifest, _read(spark, args.containers, CONTAINERS), f"{out}/features", fmt)
        _write(status, f"{out}/line_status", fmt)
    elif args.cmd == "strace-features":
        feats, drift = flows.strace_features(spark, args.logs)
        _write(feats, f"{out}/features", fmt)
        _write(drift, f"{out}/drift", fmt)
    elif args.cmd == "packet-features":
        _write(flows.network_features(spark, args.packets), f"{out}/features", fmt)
    elif args.cmd == "train":
        det = flows.train_detector(_read(spark, args.table), args.label, kind=args.kind, recipe=args.recipe)
        models.save_model(det.model, args.model_out)
        _write(det.metrics, f"{out}/metrics", fmt)
        _write(det.importances, f"{out}/importances", fmt)
        _write(det.overfit, f"{out}/overfit", fmt)
    elif args.cmd == "sweep":
        table, best, model = flows.sweep_detectors(_read(spark, args.table), args.label, recipe=args.recipe,
                                                   candidates=args.candidates.split(","))
        models.save_model(model, args.model_out)
        _write(table, f"{out}/metrics", fmt)
        _write(best, f"{out}/best", fmt)
    elif args.cmd == "window-evaluate":
        model = models.load_model(args.model)
        columns = ", ".join([f"`{args.key}` string", f"`{args.label}` int",
                             *[f"`{c}` double" for c in model.stages[0].getInputCols()]])
        tagged = read_tagged_tables(spark, args.windows, columns)
        for name, df in flows.windowed_evaluation(model, tagged, args.key, args.label).items():
            _write(df, f"{out}/{name}", fmt)
    elif args.cmd == "score":
        model = models.load_model(args.model)
        _write(models.score(model, _read(spark, args.table), [args.key], args.label), out, fmt)
    elif args.cmd == "fuse":
        s = _read(spark, args.syscall, SYS_PRED)
        n = _read(spark, args.network)
        sys_scores = s.select(base_name("file", (".log",)).alias("base"), "file", "label", "p_sys")
        net_scores = n.select(base_name("file", ("_network.pcap", ".pcap")).alias("network_base"),
                              "file", F.col("p_net").cast("double").alias("p_net"))
        paired, metrics, unmatched = flows.runtime_detection(
            sys_scores, net_scores, _read(spark, args.bridge, BRIDGE), ["file"], ["file"])
        _write(paired, f"{out}/predictions", fmt)
        _write(metrics, f"{out}/metrics", fmt)
        _write(unmatched, f"{out}/unmatched", fmt)
    elif args.cmd == "evaluate":
        for name, df in flows.synthetic_evaluation(_read(spark, args.scores, PAIRED)).items():
            _write(df, f"{out}/{name}", fmt)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracefuse")
    sub = p.add_subparsers(dest="cmd", required=True)

    def cmd(name, *opts):
        c = sub.add_parser(name)
        for o in opts:
            c.add_argument(f"--{o}", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--format", default="parquet", choices=["parquet", "csv"])
        return c

    cmd("sysdig-features", "raw", "manifest", "containers")
    cmd("strace-features", "logs")
    cmd("packet-features", "packets")
    t = cmd("train", "table", "model-out")
    t.add_argument("--label", default=None, help="default: first of label, label_bin, true_label, y")
    t.add_argument("--kind", default="random_forest", choices=["random_forest", "logistic_regression"])
    s = cmd("sweep", "table", "model-out")
    s.add_argument("--label", default=None)
    s.add_argument("--candidates", default="logistic_regression,random_forest,linear_svm,kernel_svm,gradient_boosting")
    for c in (t, s):
        c.add_argument("--recipe", default="network", choices=["network", "syscall"])
    cmd("window-evaluate", "model", "windows", "key", "label")
    cmd("score", "model", "table", "key", "label")
    cmd("fuse", "syscall", "network", "bridge")
    cmd("evaluate", "scores")
    return p


def main(argv=None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if spark is None:
        from tracefuse.session import get_session
        spark = SparkSession.getActiveSession() or get_session()
    run(args, spark)


if __name__ == "__main__":
    main(sys.argv[1:])
