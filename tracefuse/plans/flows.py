"""End-to-end flows: the reference's script chains as lazy Spark jobs.

* :func:`syscall_window_features` - sysdig text + manifest -> per-window feature tables
* :func:`write_syscall_features` - the same, written and checked in one pass
* :func:`strace_features` - directory of ``*.log`` traces -> aligned feature table
* :func:`network_features` - decoded packet rows -> aligned flow table
* :func:`train_detector` - prepare, split, fit, evaluate, importances
* :func:`sweep_detectors` - candidate models side by side, best by F1
* :func:`runtime_detection` - pair scored signals through a bridge, fuse, evaluate
* :func:`detect_from_captures` - the whole runtime chain from raw capture files and two models
* :func:`synthetic_evaluation` - paired scores -> metrics, sweeps, rule agreement
* :func:`windowed_evaluation` - per-window scoring -> metrics and recommended window
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.functions.contracts import SYSCALL_CONTRACT, WINDOWS
from tracefuse.functions.fusion import CURRENT_RULE, LEGACY_RULE, FusionRule, fuse
from tracefuse.functions.scalar import base_name, label_from_name
from tracefuse.operators import counting, flows, kernel, metrics, models, prep, sampling, sweeps
from tracefuse.operators.pairing import pair_predictions, unmatched_pairs
from tracefuse.sources import readers, sinks

PREDS = {"syscall": "pred_syscall", "network": "pred_network", "hybrid": "pred_hybrid"}


def syscall_window_features(spark: SparkSession, raw_path: str, manifest_path: str,
                            containers: DataFrame, contract: Sequence[str] = SYSCALL_CONTRACT,
                            windows: Mapping[str, int | None] = WINDOWS,
                            validate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(features, line_status_counts).  No synthetic fallback: an input with no
    parseable event is an error, and every row carries ``capture_mode``.
    ``validate`` asserts the contract (P18): column order, no NULL/NaN, and
    one row per declared container and window."""
    parsed = readers.read_sysdig(spark, raw_path)
    status = parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    ok = readers.require_rows(parsed.filter(F.col("status") == "ok"), raw_path)
    manifest = readers.read_manifest(spark, manifest_path)
    mapped = counting.map_syscalls(ok, "syscall", contract=contract)
    feats = counting.window_features(mapped, manifest, "container", "ts_s", contract, windows,
                                     keys=containers, manifest_max_rows=1_000_000)
    feats = readers.with_capture_mode(feats, "sysdig")
    if validate:
        counting.assert_contract(feats, contract, keep=["window_tag", "container", "label", "capture_mode"],
                                 expected_rows=containers.count() * len(windows))
    return feats, status


def strace_features(spark: SparkSession, log_dir: str, contract: Sequence[str] = SYSCALL_CONTRACT,
                    validate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(aligned features, drift report) from archived strace logs (no aliasing;
    ``total_events`` counts every extracted call, including dropped ones)."""
    files = readers.require_rows(readers.list_files(spark, log_dir, "*.log"), log_dir)
    calls = readers.read_strace_logs(spark, log_dir)
    mapped = counting.map_syscalls(calls, "syscall", aliases=None)
    long = counting.long_counts(mapped, ["file"])
    wide = counting.widen(long, ["file"], contract, total="all")
    wide = counting.with_all_keys(wide, files, ["file"], contract)  # a silent log is a row of zeros
    wide = wide.withColumn("label", label_from_name("file", "syscall"))
    wide = wide.select("file", "label", *[F.col(f"`{c}`") for c in contract])
    if validate:
        counting.assert_contract(wide, contract, keep=["file", "label"])
    return wide, counting.drift_report(long, contract, key_col="file")


def network_features(spark: SparkSession, packet_dir: str) -> DataFrame:
    """One row per capture file, an empty capture included (all zeros)."""
    files = readers.require_rows(readers.list_files(spark, packet_dir, "*.tsv"), packet_dir)
    return flows.network_feature_table(readers.read_packets(spark, packet_dir), key_col="file", keys=files)


def write_syscall_features(spark: SparkSession, raw_path: str, manifest_path: str, containers: DataFrame, out: str,
                           fmt: str = "parquet", contract: Sequence[str] = SYSCALL_CONTRACT,
                           windows: Mapping[str, int | None] = WINDOWS) -> DataFrame:
    """Writes :func:`syscall_window_features` and checks it in the same pass; returns the line counts by status.

    One pass over the raw capture counts its lines by status, the features'
    rows and their NULL or NaN values; the table replaces the old one only when
    there was an event, no value is missing and every declared container has
    its row in each window (S11, P9, P18).
    """
    w = sinks.CheckedWrite()
    parsed = w.observe(readers.read_sysdig(spark, raw_path), "lines",
                       **{s: F.count_if(F.col("status") == s) for s in readers.SYSDIG_STATUSES})
    mapped = counting.map_syscalls(parsed.filter(F.col("status") == "ok"), "syscall", contract=contract)
    keys = w.observe(containers, "keys", rows=F.count(F.lit(1)))
    feats = counting.window_features(mapped, readers.read_manifest(spark, manifest_path), "container", "ts_s", contract,
                                     windows, keys=keys, manifest_max_rows=1_000_000)
    feats = readers.with_capture_mode(feats, "sysdig")
    if [c for c in feats.columns if c not in ("window_tag", "container", "label", "capture_mode")] != list(contract):
        raise AssertionError("column order does not match the contract")
    feats = w.observe(feats, "features", **sinks.contract_counts(contract))
    w.require(lambda n: None if n["lines"]["ok"] else f"no rows found for {raw_path}")
    w.require(lambda n: f"{n['features']['bad']} NULL/NaN values after alignment" if n["features"]["bad"] else None, AssertionError)
    w.require(lambda n: None if n["features"]["rows"] == len(windows) * n["keys"]["rows"] else
              f"row count {n['features']['rows']} != {len(windows) * n['keys']['rows']}", AssertionError)
    lines = w.write(feats, out, fmt, ["window_tag"])["lines"]
    return spark.createDataFrame([(s, int(lines[s])) for s in readers.SYSDIG_STATUSES if lines[s]], "status string, n bigint")


@dataclass
class TrainedDetector:
    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    importances: DataFrame
    overfit: DataFrame


def train_detector(df: DataFrame, label: str | None = None, kind: str = "random_forest",
                   test_fraction: float = 0.2, num_trees: int = 200,
                   max_depth: int = 30, recipe: str = "network") -> TrainedDetector:
    """``recipe`` names the preparation: ``network`` (de-duplicated, constant columns
    dropped) or ``syscall`` (every row and every contract column kept).  Metadata drop (P1) and label resolution (P3) -> L10 preparation ->
    deterministic stratified split -> distributed fit -> metrics on the
    held-out split, importances, overfit gap."""
    spark = df.sparkSession
    df = prep.drop_metadata(df)
    label = label or prep.resolve_label(df.columns)
    if label is None:
        raise ValueError("no label column (label, label_bin, true_label or y)")
    prepared = prep.PREPARE[recipe](df, label)
    # deterministic split key: a hash of the prepared row (rows are unique after dedup)
    keyed = prepared.data.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in prepared.features]))
    split = sampling.split_by_key(keyed, label, "_h", test_fraction)
    train = models.balanced_weights(split.filter(F.col("split") == "train"), label)
    test = split.filter(F.col("split") == "test")
    feats = prepared.features
    if kind == "logistic_regression":
        pipe = models.logistic_regression(feats, label, n_rows=train.count())
    else:
        pipe = models.random_forest(feats, label, num_trees=num_trees, max_depth=max_depth)
    model = pipe.fit(train)
    te = models.evaluate(models.score(model, test, [], label), kind)
    tr = models.evaluate(models.score(model, train, [], label), kind)
    return TrainedDetector(model, feats, te, models.feature_importance(spark, model, feats),
                           metrics.overfit_gap(tr, te))


def sweep_detectors(df: DataFrame, label: str | None = None, test_fraction: float = 0.2,
                    candidates: Sequence[str] = ("logistic_regression", "random_forest",
                                                 "linear_svm", "kernel_svm", "gradient_boosting"),
                    num_trees: int = 100, gbt_iterations: int = 100,
                    recipe: str = "network") -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Candidate sweep (L7): prepare once, split once, fit each candidate
    (every fit distributed), metrics side by side (A17) and the best by F1,
    first candidate winning ties (K5).  Linear models see standardised
    inputs, trees raw ones.  Returns (metrics, best row, the best fitted model),
    so the winner can be saved without fitting it again."""
    df = prep.drop_metadata(df)
    label = label or prep.resolve_label(df.columns)
    prepared = prep.PREPARE[recipe](df, label)
    feats = prepared.features
    keyed = prepared.data.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in feats]))
    split = sampling.split_by_key(keyed, label, "_h", test_fraction)
    train = models.balanced_weights(split.filter(F.col("split") == "train"), label)
    test = split.filter(F.col("split") == "test")
    n = train.count()
    build = {
        "logistic_regression": lambda: models.logistic_regression(feats, label, n_rows=n),
        "random_forest": lambda: models.random_forest(feats, label, num_trees=num_trees),
        "linear_svm": lambda: models.linear_svm(feats, label),
        "kernel_svm": lambda: kernel.kernel_svm(feats, label),
        "gradient_boosting": lambda: models.gradient_boosting(feats, label, max_iter=gbt_iterations),
    }
    fitted: dict[str, PipelineModel] = {}
    table = models.candidate_sweep(train, test, feats, label, {c: build[c]() for c in candidates}, fitted=fitted)
    best = metrics.best_model(table)
    return table, best, fitted[best.first()["model"]]


def runtime_detection(sys_scores: DataFrame, net_scores: DataFrame, bridge: DataFrame,
                      sys_order: Sequence[str], net_order: Sequence[str],
                      rule: FusionRule = CURRENT_RULE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paired verdicts, per-model metrics, unmatched bridge rows)."""
    paired = pair_predictions(sys_scores, net_scores, bridge, sys_order=sys_order,
                              net_order=net_order, rule=rule)
    readers.require_rows(paired, "paired syscall and network scores")
    return paired, metrics.detector_metrics(paired, "label", PREDS), \
        unmatched_pairs(sys_scores, net_scores, bridge)


def detect_from_captures(spark: SparkSession, raw_path: str, manifest_path: str, containers: DataFrame,
                         packet_dir: str, sys_model: PipelineModel, net_model: PipelineModel,
                         bridge: DataFrame, rule: FusionRule = CURRENT_RULE,
                         net_suffixes: Sequence[str] = ("_network.pcap", ".pcap", "_network.tsv", ".tsv"),
                         window_tag: str = "full") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole runtime chain from raw inputs: sysdig capture -> window
    features -> syscall model; packet rows -> flow features -> network model;
    pair through ``bridge(base, network_base)``, fuse, evaluate.

    Returns (paired verdicts, per-model metrics, unmatched bridge rows).
    """
    feats, _ = syscall_window_features(spark, raw_path, manifest_path, containers)
    sys_scores = (models.score(sys_model, feats.filter(F.col("window_tag") == window_tag),
                               ["container"], "label", out="p_sys")
                  .select(F.col("container").alias("base"), F.col("y").alias("label"), "p_sys"))
    net = network_features(spark, packet_dir)
    net_scores = (models.score(net_model, net, ["file"], "label", out="p_net")
                  .select(base_name("file", net_suffixes).alias("network_base"), "file", "p_net"))
    return runtime_detection(sys_scores, net_scores, bridge, ["base"], ["file"], rule)


def synthetic_evaluation(scores: DataFrame, y: str = "y_true", rule: FusionRule = CURRENT_RULE) -> dict:
    """Paired (y, p_sys, p_net) scores -> every report of the synthetic study."""
    clean = prep.drop_incomplete(scores, ["p_sys", "p_net", y])
    fused = fuse(clean, rule=rule)
    return {
        "class_distribution": metrics.class_distribution(clean, y),
        "metrics": metrics.detector_metrics(fused, y, PREDS),
        "robustness": sweeps.robustness_sweep(clean, y=y, rule=rule),
        "thresholds": sweeps.threshold_sweep(clean, y=y),
        "rule_agreement": sweeps.rule_agreement(clean, rule_a=rule, rule_b=LEGACY_RULE),
        "predictions": fused,
    }


def windowed_evaluation(model: PipelineModel, tagged: DataFrame, key_col: str, label: str,
                        seconds: Mapping[str, int | None] = WINDOWS, full_tag: str = "full",
                        reference: DataFrame | None = None) -> dict:
    """Score every window's features with one model.

    Returns per-window ``metrics``, the ``recommended`` window, the
    per-container ``breakdown`` of the full window, the scored ``predictions``
    and, when a reference metrics row (``model``, ``f1``) is given, the
    ``reference_delta`` of F1 against the full window.
    """
    scored = models.score(model, tagged, ["window_tag", key_col], label)
    wm = metrics.window_metrics(scored, "y", "pred", "p")
    out = {
        "metrics": wm,
        "recommended": metrics.recommended_window(wm, seconds),
        "breakdown": metrics.row_breakdown(scored.filter(F.col("window_tag") == full_tag),
                                           [key_col], "y", "pred", "p"),
        "predictions": scored,
    }
    if reference is not None:
        full = wm.filter(F.col("window_tag") == full_tag).select(
            F.lit(reference.first()["model"]).alias("model"), "f1")
        out["reference_delta"] = metrics.reference_delta(reference.select("model", "f1"), full)
    return out
