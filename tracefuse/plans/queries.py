"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Column names match the DuckDB oracle in :mod:`tracefuse.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefuse.functions.contracts import NETWORK_CONTRACT
from tracefuse.functions.fusion import CURRENT_RULE, LEGACY_RULE, fuse, probability_band
from tracefuse.functions.scalar import base_name, label_from_name, safe_div
from tracefuse.operators import counting, flows, kernel, metrics, models, pairing, prep, sampling, sweeps
from tracefuse.plans import standins as S
from tracefuse.session import cut_lineage, fixed_table, scratch_folder
from tracefuse.sources.readers import (file_inventory, in_order, parse_packets, parse_sysdig, preview, read_manifest,
                                       read_strace_logs)
from tracefuse.sources.sinks import CheckedWrite, contract_counts

PREDS = {"syscall": "pred_syscall", "network": "pred_network", "hybrid": "pred_hybrid"}


def _fused(spark, sf):
    return fuse(S.scores(spark, sf))


def _score_stack(spark, sf):
    s = S.scores(spark, sf)
    return s.select("y", "p_sys", "p_net").unpivot(["y"], ["p_sys", "p_net"], "_m", "score") \
        .select("y", F.when(F.col("_m") == "p_sys", "syscall").otherwise("network").alias("model"),
                "score")


# ---- fusion and per-model metrics ------------------------------------------------------

def detector_metrics(spark, sf):
    return metrics.detector_metrics(_fused(spark, sf), "y", PREDS)


def confusion_by_model(spark, sf):
    st = metrics.stack_predictions(_fused(spark, sf), "y", PREDS, keep=["scenario"])
    return metrics.confusion(st, "y", "pred", ["scenario", "model"])


def fusion_decision(spark, sf):
    return _fused(spark, sf).select("doc_id", "y", "p_sys", "p_net", "pred_syscall",
                                    "pred_network", "pred_hybrid", "fired_rule")


def fusion_rule_counts(spark, sf):
    return _fused(spark, sf).groupBy("y", "fired_rule").agg(F.count(F.lit(1)).alias("n"))


def probability_bands(spark, sf):
    s = S.scores(spark, sf).withColumn("band", probability_band("p_sys", "p_net")) \
        .filter(F.col("band").isNotNull())
    first = pairing.first_per_key(s, ["band"], ["doc_id"], ["doc_id", "y", "p_sys", "p_net"])
    sizes = s.groupBy("band").agg(F.count(F.lit(1)).alias("n_in_band"))
    out = first.join(sizes, "band")
    return out.withColumn("pred_hybrid", CURRENT_RULE.decide("p_sys", "p_net"))


def class_distribution(spark, sf):
    return metrics.class_distribution(S.scores(spark, sf), "y")


def class_report(spark, sf):
    return metrics.class_report(_fused(spark, sf), "y", PREDS)


def roc_auc(spark, sf):
    return metrics.roc_auc(_score_stack(spark, sf), "y", "score", ["model"])


def roc_points(spark, sf):
    return metrics.roc_points(_score_stack(spark, sf), "y", "score", ["model"])


def separation_gap(spark, sf):
    return metrics.separation_gap(_score_stack(spark, sf), "y", "score", ["model"])


def row_breakdown(spark, sf):
    return metrics.row_breakdown(_fused(spark, sf), ["doc_id"], "y", "pred_hybrid")


def accuracy_summary(spark, sf):
    st = metrics.stack_predictions(_fused(spark, sf), "y", PREDS)
    return metrics.accuracy_summary(st, "y", "pred", ["model"])


def rule_agreement(spark, sf):
    return sweeps.rule_agreement(S.scores(spark, sf), rule_a=CURRENT_RULE, rule_b=LEGACY_RULE)


def robustness_sweep(spark, sf):
    return sweeps.robustness_sweep(S.scores(spark, sf))


def robustness_sweep_noisy(spark, sf):
    """With the Gaussian noise of the shrink study, drawn by document."""
    return sweeps.robustness_sweep(S.scores(spark, sf), noise=True, key="doc_id")


def threshold_sweep(spark, sf):
    return sweeps.threshold_sweep(S.scores(spark, sf))


def threshold_choice(spark, sf):
    return sweeps.best_thresholds(sweeps.threshold_sweep(S.scores(spark, sf)))


# ---- pairing through a bridge ---------------------------------------------------------

def _pair_inputs(spark, sf):
    c = S.table(spark, sf, "customer")
    s = S.table(spark, sf, "supplier")
    n = S.table(spark, sf, "nation")
    sys_scores = c.select(F.col("c_nationkey").cast("bigint").alias("base"), "c_custkey",
                          F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY").cast("int").alias("label"),
                          ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("p_sys"))
    net_scores = s.select(F.col("s_nationkey").cast("bigint").alias("network_base"), "s_suppkey",
                          ((F.col("s_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("p_net"))
    bridge = n.select(F.col("n_nationkey").cast("bigint").alias("base"),
                      ((F.col("n_nationkey") * 7) % 31).cast("bigint").alias("network_base"))
    return sys_scores, net_scores, bridge


def pair_predictions(spark, sf):
    s, n, b = _pair_inputs(spark, sf)
    return pairing.pair_predictions(s, n, b, sys_order=["c_custkey"], net_order=["s_suppkey"],
                                    bridge_max_rows=100_000)


def pair_unmatched(spark, sf):
    s, n, b = _pair_inputs(spark, sf)
    return pairing.unmatched_pairs(s, n, b)


# ---- names ----------------------------------------------------------------------------

def label_from_name_q(spark, sf):
    f = S.file_names(spark, sf)
    return f.select("doc_id", "sys_file", "net_file",
                    label_from_name("sys_file", "syscall").alias("sys_label"),
                    label_from_name("net_file", "network").alias("net_label"))


def base_name_q(spark, sf):
    f = S.file_names(spark, sf)
    return f.select("doc_id", base_name("sys_file", (".log",)).alias("sys_base"),
                    base_name("net_file", ("_network.pcap", ".pcap")).alias("net_base"))


# ---- event features -------------------------------------------------------------------

#: a manifest up to this many rows may be broadcast, its bytes permitting
MANIFEST_ROWS = 1_000_000


def _declared_keys(spark):
    return fixed_table(spark, [(i, int(i >= 5)) for i in range(S.DECLARED_CONTAINERS)],
                       "container bigint, label int")


def event_feature_counts(spark, sf):
    ev = S.events(spark, sf).select((F.col("user_id") % 10).alias("container"),
                                    F.col("event_type").alias("syscall"))
    mapped = counting.map_syscalls(ev, "syscall", S.EVENT_ALIASES, S.EVENT_CONTRACT)
    return counting.count_features(mapped, ["container"], S.EVENT_CONTRACT,
                                   keys=_declared_keys(spark))


def prefix_window_features(spark, sf):
    ev, manifest, keys = S.window_events(spark, sf)
    manifest = cut_lineage(manifest)  # one row a container: measured once, joined from its copy
    mapped = counting.map_syscalls(ev, "syscall", S.EVENT_ALIASES, S.EVENT_CONTRACT)
    # keys are every user seen in the events: no allow-list to apply
    return counting.window_features(mapped, manifest, "container", "ts_s", S.EVENT_CONTRACT,
                                    S.WINDOW_DAYS, keys=keys, unit_seconds=S.DAY, restrict=False,
                                    manifest_max_rows=MANIFEST_ROWS, salt_buckets=16)


def _window_scores(spark, sf):
    w = prefix_window_features(spark, sf)
    p = safe_div(F.col("evt_write") + F.col("evt_openat"), F.col("total_events"))
    return w.select("window_tag", "container", F.col("label").alias("y"), p.alias("p")) \
        .withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def window_metrics(spark, sf):
    out = metrics.window_metrics(_window_scores(spark, sf), "y", "pred", "p")
    return out.withColumn("separation", F.round("separation", 6))


def recommended_window(spark, sf):
    m = metrics.window_metrics(_window_scores(spark, sf), "y", "pred", "p")
    return metrics.recommended_window(m, S.WINDOW_DAYS).withColumnRenamed(
        "recommended_seconds", "recommended_n")


def window_breakdown(spark, sf):
    full = _window_scores(spark, sf).filter(F.col("window_tag") == "full")
    return metrics.row_breakdown(full, ["container"], "y", "pred", "p")


def _strace_long(spark, sf):
    ev = S.events(spark, sf).select((F.col("user_id") % 10).alias("container"),
                                    F.col("event_type").alias("syscall"))
    mapped = counting.map_syscalls(ev, "syscall", aliases=None)
    return counting.long_counts(mapped, ["container"])


def schema_align(spark, sf):
    return counting.widen(_strace_long(spark, sf), ["container"], S.STRACE_CONTRACT, total="all")


def schema_drift_report(spark, sf):
    return counting.drift_report(_strace_long(spark, sf), S.STRACE_CONTRACT, key_col="container")


def _page_calls(spark, sf):
    pg = S.table(spark, sf, "pages")
    site = F.col("page_id") % 20
    file = F.concat(F.when(site >= 15, "mal_").otherwise("benign_"), F.lit("site"),
                    site.cast("string"), F.lit(".log"))
    lines = pg.select(file.alias("file"), F.explode(F.split("html", "\n")).alias("line"))
    calls = counting.extract_calls(lines, "line", "syscall")
    return counting.map_syscalls(calls, "syscall", aliases=None)


def log_call_counts(spark, sf):
    mapped = _page_calls(spark, sf)
    wide = counting.widen(counting.long_counts(mapped, ["file"]), ["file"], S.PAGE_CONTRACT, total="all")
    return wide.withColumn("label", label_from_name("file", "syscall"))


def _hourly_long(spark, sf):
    ev = S.events(spark, sf)
    feat = F.concat(F.lit("evt_"), F.col("event_type"), F.lit("_"),
                    F.lpad(F.hour("ts").cast("string"), 2, "0"))
    return counting.long_counts(ev.select(F.col("user_id").alias("container"), feat.alias("feature")),
                                ["container"])


def top_features_per_container(spark, sf):
    return counting.top_features(_hourly_long(spark, sf), ["container"], k=5)


def nonzero_features(spark, sf):
    return counting.nonzero_features(_hourly_long(spark, sf), ["container"])


def sysdig_line_parse(spark, sf):
    parsed = parse_sysdig(S.sysdig_lines(spark, sf))
    return parsed.groupBy("status", "syscall").agg(F.count(F.lit(1)).alias("n"),
                                                   F.countDistinct("container").alias("n_containers"))


# ---- flows ----------------------------------------------------------------------------

def packet_features(spark, sf):
    # aggregate on the numeric capture id; names and labels are derived per capture afterwards
    feats = flows.packet_features(S.packets(spark, sf), key_col="capture", order_cols=S.PACKET_ORDER)
    feats = feats.withColumn("file", S.capture_file_name("capture"))
    feats = feats.withColumn("label", label_from_name("file", "network"))
    out = counting.align(feats, NETWORK_CONTRACT, keep=["file", "label"])
    return out.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


def _runtime_chain(spark, sf):
    """E1 on whole tables: event counts -> p_sys, packet flows -> p_net, bridge, fuse."""
    ev = S.events(spark, sf).select((F.col("user_id") % 10).alias("container"),
                                    F.col("event_type").alias("syscall"))
    mapped = counting.map_syscalls(ev, "syscall", S.EVENT_ALIASES, S.EVENT_CONTRACT)
    feats = counting.count_features(mapped, ["container"], S.EVENT_CONTRACT, keys=_declared_keys(spark))
    sys_scores = feats.select(
        F.col("container").alias("base"), "label",
        safe_div(F.col("evt_write") + F.col("evt_openat"), F.col("total_events")).alias("p_sys"))
    flows_ = flows.packet_features(S.packets(spark, sf), key_col="capture", order_cols=S.PACKET_ORDER)
    net_scores = flows_.select(F.col("capture").alias("network_base"),
                               (F.col("pkts") / (F.col("pkts") + F.lit(100.0))).alias("p_net"))
    bridge = _declared_keys(spark).select(
        F.col("container").alias("base"), ((F.col("container") * 7) % 13 + 1).alias("network_base"))
    return pairing.pair_predictions(sys_scores, net_scores, bridge, sys_order=["base"],
                                    net_order=["network_base"], bridge_max_rows=100_000)


def runtime_hybrid_detection(spark, sf):
    return _runtime_chain(spark, sf)


def runtime_hybrid_metrics(spark, sf):
    return metrics.detector_metrics(_runtime_chain(spark, sf), "label", PREDS)


# ---- training preparation and sampling --------------------------------------------------

def dedup_and_constant_columns(spark, sf):
    return prep.column_report(S.training_rows(spark, sf), "label_bin")


def training_prep(spark, sf):
    return prep.prepare_training(S.training_rows(spark, sf), "label_bin").data


def _labelled(spark, sf):
    lab = S.table(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").cast("int").alias("y"),
                      S.hash_order("doc_id").alias("h"))


def stratified_split(spark, sf):
    return sampling.stratified_split(_labelled(spark, sf), "y", ["h", "doc_id"]) \
        .select("doc_id", "y", "rank", "split")


def sample_per_class(spark, sf):
    return sampling.sample_per_class(_labelled(spark, sf), "y", ["h", "doc_id"], k=15) \
        .select("doc_id", "y", "rank")


def rebalance_classes(spark, sf):
    return sampling.rebalance_classes(_labelled(spark, sf), "y", ["h", "doc_id"]) \
        .select("doc_id", "y", "rank", "split")


def pair_within_label(spark, sf):
    left = _labelled(spark, sf)
    e = S.table(spark, sf, "embeddings")
    right = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("y"),
                     S.hash_order("vec_id").alias("h"))
    out = sampling.pair_within_label(left, right.withColumnRenamed("h", "h2"), "y",
                                     ["h", "doc_id"], ["h2", "vec_id"])
    return out.select("y", "rank", "doc_id", "vec_id")


# ---- wide MLlib fits (not SQL; the small fits below are) ---------------------------------

def _ml_split(spark, sf):
    df, cols = S.embedding_rows(spark, sf)
    split = sampling.stratified_split(df.withColumn("h", S.hash_order("vec_id")), "y", ["h", "vec_id"])
    train = models.balanced_weights(split.filter(F.col("split") == "train"), "y")
    test = split.filter(F.col("split") == "test")
    return train, test, cols


def lr_scores(spark, sf):
    train, test, cols = _ml_split(spark, sf)
    n = train.count()
    m = models.logistic_regression(cols, "y", n_rows=n).fit(train)
    return models.score(m, test, ["vec_id"], "y")


def rf_scores(spark, sf):
    train, test, cols = _ml_split(spark, sf)
    m = models.random_forest(cols, "y", num_trees=200).fit(train)
    return models.score(m, test, ["vec_id"], "y")


def model_sweep(spark, sf):
    train, test, cols = _ml_split(spark, sf)
    n = train.count()
    cands = {"logistic_regression": models.logistic_regression(cols, "y", n_rows=n),
             "random_forest": models.random_forest(cols, "y", num_trees=100, max_depth=30),
             "gradient_boosting": models.gradient_boosting(cols, "y"),
             "linear_svm": models.linear_svm(cols, "y"),
             "kernel_svm": kernel.kernel_svm(cols, "y")}
    return models.candidate_sweep(train, test, cols, "y", cands, keep=["vec_id"])


def kernel_svm_scores(spark, sf):
    """RBF-kernel SVM by random Fourier features, with Platt probabilities."""
    train, test, cols = _ml_split(spark, sf)
    return models.score(kernel.kernel_svm(cols, "y").fit(train), test, ["vec_id"], "y")


def fourier_features(spark, sf):
    """Random Fourier features of every embedding."""
    df, cols = S.embedding_rows(spark, sf)
    size = 8
    v = df.select("vec_id", array_to_vector(F.array(*cols)).alias("x"))
    z = kernel.RandomFourierFeatures(inputCol="x", outputCol="z", size=size, gamma=1.0 / 64, seed=7).transform(v)
    return z.select("vec_id", *[F.round(vector_to_array(F.col("z"))[j], 9).alias(f"z{j}") for j in range(size)])


def platt_probabilities(spark, sf):
    """Platt's curve over margins of two values, where it reproduces the smoothed rates."""
    rows = S.model_rows(spark, sf).select("doc_id", "y", (F.lit(2.0) * F.col("x") - 1).alias("margin"))
    curve = kernel.fit_platt(rows, "margin", "y")
    return rows.select("doc_id", "margin", F.round(curve.probability(F.col("margin")), 6).alias("p"))


def feature_importance(spark, sf):
    train, _, cols = _ml_split(spark, sf)
    m = models.random_forest(cols, "y", num_trees=200).fit(train)
    return models.feature_importance(spark, m, cols, k=20)


def overfit_gap(spark, sf):
    train, test, cols = _ml_split(spark, sf)
    m = models.random_forest(cols, "y", num_trees=200).fit(train)
    tr = models.evaluate(models.score(m, train, ["vec_id"], "y"), "random_forest")
    te = models.evaluate(models.score(m, test, ["vec_id"], "y"), "random_forest")
    return metrics.overfit_gap(tr, te)


# ---- complete rows for silent inputs, and the parsers ----------------------------------

def packet_line_parse(spark, sf):
    p = parse_packets(S.packet_lines(spark, sf))
    return p.groupBy("status", "ip_proto").agg(
        F.count(F.lit(1)).alias("n"), F.count("frame_len").alias("n_len"), F.sum("frame_len").alias("sum_len"),
        F.count("tcp_dstport").alias("n_tcp"), F.count("udp_dstport").alias("n_udp"), F.count("t").alias("n_t"))


def manifest_parse(spark, sf):
    """Manifest lines rendered from events with the columns in another order, bound by name."""
    _, manifest, keys = S.window_events(spark, sf)
    rows = manifest.join(keys, "container").select(
        F.concat(F.lit("u"), F.col("container").cast("string")).alias("container"), "start_ts",
        (F.col("start_ts") + S.DAY).alias("end_ts"), "label")
    with scratch_folder(spark, "manifest") as path:
        rows.write.option("header", True).csv(path)
        return cut_lineage(read_manifest(spark, path))


def log_inventory(spark, sf):
    """Log files in the order of their names (K1): bytes, calls and label of each, empty files included."""
    with scratch_folder(spark, "logs") as path:
        S.write_page_logs(spark, sf, path)
        files = in_order(file_inventory(spark, path, "*.log"), ["file"])
        calls = read_strace_logs(spark, path).groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("syscall").alias("names"))
        return cut_lineage(files.join(calls, "file", "left").select(
            "place", "file", "bytes", F.coalesce("n", F.lit(0)).alias("n_calls"), F.coalesce("names", F.lit(0)).alias("n_names"),
            label_from_name("file", "syscall").alias("label")))


def log_preview(spark, sf):
    """The first ten log files by name (K7)."""
    with scratch_folder(spark, "logs") as path:
        S.write_page_logs(spark, sf, path)
        return cut_lineage(preview(file_inventory(spark, path, "*.log"), ["file"], 10))


def checked_window_features(spark, sf):
    """Features written beside, checked by the writing job's own counts and swapped in; read back with those counts."""
    ev, manifest, keys = S.window_events(spark, sf)
    w = CheckedWrite()
    ev = w.observe(ev, "events", rows=F.count(F.lit(1)), errors=F.count_if(F.col("syscall") == "error"))
    mapped = counting.map_syscalls(ev, "syscall", S.EVENT_ALIASES, S.EVENT_CONTRACT)
    feats = counting.window_features(mapped, manifest, "container", "ts_s", S.EVENT_CONTRACT, S.WINDOW_DAYS, keys=keys,
                                     unit_seconds=S.DAY, restrict=False)
    feats = w.observe(feats, "features", **contract_counts(S.EVENT_CONTRACT))
    w.require(lambda n: "missing values" if n["features"]["bad"] else None, AssertionError)
    with scratch_folder(spark, "features") as path:
        counts = w.write(feats, f"{path}/table")
        rows = spark.read.parquet(f"{path}/table").groupBy("window_tag").agg(
            F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).cast("bigint").alias(f"sum_{c}") for c in S.EVENT_CONTRACT])
        return cut_lineage(rows.withColumns({
            "events": F.lit(counts["events"]["rows"]).cast("bigint"), "errors": F.lit(counts["events"]["errors"]).cast("bigint"),
            "written": F.lit(counts["features"]["rows"]).cast("bigint")}))


def counts_with_silent_files(spark, sf):
    """As log_call_counts, over 24 declared logs of which four never made a call."""
    files = fixed_table(spark, [(f"{'mal_' if i % 20 >= 15 else 'benign_'}site{i}.log",) for i in range(24)], "file string")
    calls = _page_calls(spark, sf)
    wide = counting.widen(counting.long_counts(calls, ["file"]), ["file"], S.PAGE_CONTRACT, total="all")
    return counting.with_all_keys(wide, files, ["file"], S.PAGE_CONTRACT).withColumn(
        "label", label_from_name("file", "syscall"))


def flows_with_empty_captures(spark, sf):
    """Flow features of every supplier's capture; those of every fifth supplier hold no packet."""
    packets = S.packets(spark, sf).filter(F.col("capture") % 5 != 0).withColumn(
        "file", S.capture_file_name("capture"))
    files = S.table(spark, sf, "supplier").select(S.capture_file_name("s_suppkey").alias("file"))
    feats = flows.network_feature_table(packets, key_col="file", keys=files, order_cols=S.PACKET_ORDER)
    return feats.select("file", "label", "dport", "pkts", "bytes", "dur", "min", "max", "proto_tcp", "proto_udp")


# ---- preparation and reports as tables ---------------------------------------------------

def prepared_columns(spark, sf):
    """Metadata dropped, features by prefix, label resolved (P1-P3), summed per label."""
    raw = S.training_rows(spark, sf).withColumns({"id": F.lit(1), "folder": F.lit("x")})
    df = prep.drop_metadata(raw)
    feats, label = prep.select_features(df, "l_", ("is_open",)), prep.resolve_label(df.columns)
    used = prep.booleans_to_int(prep.drop_string_columns(df.select(*feats, label)))
    names = F.lit(",".join(c for c in used.columns if c != label))
    return used.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sum_quantity"),
        F.sum("is_open").alias("n_open")).withColumn("features", names)


def complete_packets(spark, sf):
    p = prep.drop_incomplete(S.packets(spark, sf), ["frame_len", "t"])
    return p.groupBy("ip_proto").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("sum_len"))


def contract_report(spark, sf):
    p = S.packets(spark, sf).select("capture", "frame_len", "udp_dstport", "tcp_dstport", "t")
    return counting.contract_report(p, ["frame_len", "tcp_dstport", "udp_dstport", "t", "absent"], keep=["capture"])


def presented_metrics(spark, sf):
    return metrics.present(detector_metrics(spark, sf))


def reference_delta(spark, sf):
    reference = metrics.detector_metrics(_fused(spark, sf).filter("scenario = 0"), "y", PREDS)
    return metrics.reference_delta(reference, detector_metrics(spark, sf))


def labelled_concat(spark, sf):
    benign = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    bad = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"),
                                                F.col("c_mktsegment").alias("segment"))
    return prep.labelled_concat({0: benign, 1: bad})


# ---- models that SQL can reproduce -------------------------------------------------------

def scaled_features(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"),
                                              F.col("c_nationkey").cast("double").alias("nation"))
    out = models.standardise(c, ["balance", "nation"], keep=["c_custkey"])
    return out.withColumns({"balance": F.round("balance", 4), "nation": F.round("nation", 4)})


def class_weights(spark, sf):
    w = models.balanced_weights(S.table(spark, sf, "labels"), "quality")
    return w.groupBy(F.col("quality").cast("int").alias("quality"), "weight").agg(F.count(F.lit(1)).alias("n"))


def _rates(model, df):
    scored = models.score(model, df, ["doc_id", "x"], "y")
    return (scored.groupBy("x", F.round("p", 5).alias("p"), "pred")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos")))


def binary_rate_scores(spark, sf):
    """Unpenalised logistic regression on one binary feature: p is the class rate per value."""
    df = S.model_rows(spark, sf)
    return _rates(models.logistic_regression(["x"], "y", weight_col=None).fit(df), df)


def boosted_stage_scores(spark, sf):
    """One boosting stage: p = 1 / (1 + exp(-2 mean(2y - 1))) per leaf."""
    df = S.model_rows(spark, sf)
    return _rates(models.gradient_boosting(["x"], "y", max_iter=1, max_depth=1).fit(df), df)


def tree_leaf_scores(spark, sf):
    """One tree without bootstrap: p is the class rate of the leaf."""
    df = S.model_rows(spark, sf)
    return _rates(_one_tree(["x"]).fit(df), df)


def _one_tree(cols):
    return models.random_forest(cols, "y", weight_col=None, num_trees=1, max_depth=1, bootstrap=False, subset="all")


def tree_importance(spark, sf):
    df = S.model_rows(spark, sf)
    out = models.feature_importance(spark, _one_tree(["x", "z"]).fit(df), ["x", "z"])
    return out.select("feature", "value", "kind", "rank")


def best_candidate(spark, sf):
    df = S.model_rows(spark, sf)
    table = models.candidate_sweep(df, df, ["x"], "y", {
        "logistic_regression": models.logistic_regression(["x"], "y", weight_col=None),
        "gradient_boosting": models.gradient_boosting(["x"], "y", max_iter=1, max_depth=1),
        "one_tree": _one_tree(["x"])})
    return metrics.best_model(table).select("model", "ordinal", "tn", "fp", "fn", "tp", "accuracy", "f1", "roc_auc")


def candidate_overfit(spark, sf):
    df = S.model_rows(spark, sf)
    train, test = df.filter("doc_id % 5 != 0"), df.filter("doc_id % 5 = 0")
    model = _one_tree(["x"]).fit(train)
    parts = [models.evaluate(models.score(model, d, [], "y"), "one_tree") for d in (train, test)]
    return metrics.overfit_gap(*parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "detector_metrics": detector_metrics,
    "confusion_by_model": confusion_by_model,
    "fusion_decision": fusion_decision,
    "fusion_rule_counts": fusion_rule_counts,
    "probability_bands": probability_bands,
    "class_distribution": class_distribution,
    "class_report": class_report,
    "roc_auc": roc_auc,
    "roc_points": roc_points,
    "separation_gap": separation_gap,
    "row_breakdown": row_breakdown,
    "accuracy_summary": accuracy_summary,
    "rule_agreement": rule_agreement,
    "robustness_sweep": robustness_sweep,
    "robustness_sweep_noisy": robustness_sweep_noisy,
    "threshold_sweep": threshold_sweep,
    "threshold_choice": threshold_choice,
    "pair_predictions": pair_predictions,
    "pair_unmatched": pair_unmatched,
    "label_from_name": label_from_name_q,
    "base_name": base_name_q,
    "event_feature_counts": event_feature_counts,
    "prefix_window_features": prefix_window_features,
    "window_metrics": window_metrics,
    "recommended_window": recommended_window,
    "window_breakdown": window_breakdown,
    "schema_align": schema_align,
    "schema_drift_report": schema_drift_report,
    "log_call_counts": log_call_counts,
    "sysdig_line_parse": sysdig_line_parse,
    "top_features_per_container": top_features_per_container,
    "nonzero_features": nonzero_features,
    "packet_features": packet_features,
    "runtime_hybrid_detection": runtime_hybrid_detection,
    "runtime_hybrid_metrics": runtime_hybrid_metrics,
    "dedup_and_constant_columns": dedup_and_constant_columns,
    "training_prep": training_prep,
    "stratified_split": stratified_split,
    "sample_per_class": sample_per_class,
    "rebalance_classes": rebalance_classes,
    "pair_within_label": pair_within_label,
    "lr_scores": lr_scores,
    "rf_scores": rf_scores,
    "model_sweep": model_sweep,
    "kernel_svm_scores": kernel_svm_scores,
    "fourier_features": fourier_features,
    "platt_probabilities": platt_probabilities,
    "feature_importance": feature_importance,
    "overfit_gap": overfit_gap,
    "packet_line_parse": packet_line_parse,
    "manifest_parse": manifest_parse,
    "log_inventory": log_inventory,
    "log_preview": log_preview,
    "checked_window_features": checked_window_features,
    "counts_with_silent_files": counts_with_silent_files,
    "flows_with_empty_captures": flows_with_empty_captures,
    "prepared_columns": prepared_columns,
    "complete_packets": complete_packets,
    "contract_report": contract_report,
    "presented_metrics": presented_metrics,
    "reference_delta": reference_delta,
    "labelled_concat": labelled_concat,
    "scaled_features": scaled_features,
    "class_weights": class_weights,
    "binary_rate_scores": binary_rate_scores,
    "boosted_stage_scores": boosted_stage_scores,
    "tree_leaf_scores": tree_leaf_scores,
    "tree_importance": tree_importance,
    "best_candidate": best_candidate,
    "candidate_overfit": candidate_overfit,
}
