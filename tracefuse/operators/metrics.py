"""Detection-quality metrics.

Rates divide integer counts, so every engine produces the same IEEE double;
only averages of float scores are rounded (to 6 digits).  Positive class = 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefuse.functions.scalar import nan_to_null, safe_div
from tracefuse.operators.ranking import running_sums
from tracefuse.session import cut_lineage


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (a NULL group is a group)."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def _is(col: str, v: int) -> Column:
    return F.col(col) == F.lit(v)


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def confusion(df: DataFrame, y: str = "y", pred: str = "pred",
              group_cols: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp with labels fixed to (0, 1) (A9): one aggregate."""
    return df.groupBy(*group_cols).agg(
        _count(_is(y, 0) & _is(pred, 0)).alias("tn"),
        _count(_is(y, 0) & _is(pred, 1)).alias("fp"),
        _count(_is(y, 1) & _is(pred, 0)).alias("fn"),
        _count(_is(y, 1) & _is(pred, 1)).alias("tp"))


def rate_columns() -> dict[str, Column]:
    """accuracy, precision, recall, F1 (A10) and FPR, FNR (A11); 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return {
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "fpr": safe_div(fp, fp + tn),
        "fnr": safe_div(fn, fn + tp),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rate_columns())


def stack_predictions(df: DataFrame, y: str, preds: Mapping[str, str],
                      keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., y, model, pred): one row per input row and predictor."""
    names = list(preds)
    wide = df.select(*keep, F.col(y).cast("int").alias("y"),
                     *[F.col(c).cast("int").alias(n) for n, c in preds.items()])
    return wide.unpivot([*keep, "y"], names, "model", "pred")


def detector_metrics(df: DataFrame, y: str, preds: Mapping[str, str],
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Side-by-side metrics of several predictors in one grouped aggregate."""
    stacked = stack_predictions(df, y, preds, keep=group_cols)
    return with_rates(confusion(stacked, "y", "pred", [*group_cols, "model"]))


def class_report(df: DataFrame, y: str, preds: Mapping[str, str]) -> DataFrame:
    """Per-class precision/recall/F1/support, the accuracy row (its value in the
    F1 column), and macro and weighted averages (A12)."""
    c = confusion(stack_predictions(df, y, preds), "y", "pred", ["model"])
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1, f1_1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn), safe_div(2 * tp, 2 * tp + fp + fn)
    p0, r0, f1_0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp), safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1"), s.cast("bigint").alias("support"))

    null = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", null, null, safe_div(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", safe_div(p0 * s0 + p1 * s1, n), safe_div(r0 * s0 + r1 * s1, n),
            safe_div(f1_0 * s0 + f1_1 * s1, n), n))
    return c.select("model", F.explode(rows).alias("r")).select("model", "r.*")


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """Count and share per class (A8).  The share window runs over the
    aggregated table (one row per class), not over the input."""
    counts = df.groupBy(F.col(y).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", "n", (F.col("n") / total).alias("share"))


def _score_groups(df: DataFrame, y: str, score: str, group_cols: Sequence[str]) -> DataFrame:
    s = nan_to_null(F.col(score))
    return (df.select(*group_cols, F.col(y).alias("_y"), s.alias("score"))
            .filter(F.col("score").isNotNull())
            .groupBy(*group_cols, "score")
            .agg(_count(_is("_y", 1)).alias("pos"), _count(_is("_y", 0)).alias("neg")))


#: a score's order is read in this many digits of 16 bits
_DIGITS = 4


def _order_digits(score: str) -> list[Column]:
    """The 64-bit order of a double as digits of 16 bits, the highest first.

    IEEE bits order like the numbers once the others are flipped for negative ones.
    """
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(score)).cast("bigint")
    signed = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    digits = []
    for d in range(_DIGITS):
        digit = F.shiftright(signed, 48 - 16 * d)
        # the highest digit keeps its sign, the others are 0 to 65535
        digits.append(digit if d == 0 else digit.bitwiseAND(F.lit(0xFFFF)))
    return digits


def roc_auc(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with ties counted 1/2 (A13); NULL when a class is absent.

    Scores are first reduced to one row per distinct score (map-side
    combined).  Twice the number of ordered pairs is then summed up digit by
    digit, the lowest first: among the rows that agree in all higher digits, a
    row's negatives below are those of the smaller digits, and the rows roll up
    to one per higher prefix.  A window thus never holds more than 65,536 rows,
    and nothing is sorted as a whole or written.  2U is an integer, so the
    result is one IEEE division.
    """
    keys = list(group_cols)
    names = [f"_d{d}" for d in range(_DIGITS)]
    # products of counts leave 64 bits at about 2e9 rows a class: exact 38-digit decimals
    wide, two = "decimal(38,0)", F.lit(2).cast("decimal(1,0)")
    g = _score_groups(df, y, score, group_cols)
    # rows of one score are ties: half of their pairs count
    u2 = (F.col("pos").cast(wide) * F.col("neg").cast(wide)).cast(wide)
    r = g.select(*keys, "pos", "neg", *[c.alias(n) for n, c in zip(names, _order_digits("score"))], u2.alias("u2"))
    for d in reversed(range(_DIGITS)):
        prefix = [*keys, *names[:d]]
        below = F.sum("neg").over(Window.partitionBy(*prefix).orderBy(names[d]).rowsBetween(Window.unboundedPreceding, -1))
        pairs = (F.col("pos").cast(wide) * (two * F.coalesce(below, F.lit(0)).cast(wide)).cast(wide)).cast(wide)
        r = (r.withColumn("u2", (F.col("u2") + pairs).cast(wide)).groupBy(*prefix)
             .agg(F.sum("u2").cast(wide).alias("u2"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    auc = F.when((F.col("pos") > 0) & (F.col("neg") > 0),
                 F.col("u2").cast("double") / (two * (F.col("pos").cast(wide) * F.col("neg").cast(wide)).cast(wide)).cast("double"))
    return r.select(*keys, auc.alias("roc_auc"), F.col("pos").alias("n_pos"), F.col("neg").alias("n_neg"))


def roc_points(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
               drop_intermediate: bool = True) -> DataFrame:
    """ROC curve points (fpr, tpr, threshold), highest threshold first, plus the
    (0, 0) origin with a NULL threshold (A14).

    With ``drop_intermediate`` a point is omitted when the next lower score
    group adds exactly the same (positives, negatives) as this one (equal
    steps: the point lies on the segment between its neighbours); the first
    and last points are always kept.  The next group, the running counts and
    the totals come from one frozen copy of the distinct scores.
    """
    keys = list(group_cols) or ["_all"]
    src = df if group_cols else df.withColumn("_all", F.lit(0))
    g = _score_groups(src, y, score, keys).withColumn("_one", F.lit(1))
    r = running_sums(g, keys, ["score"], ["pos", "neg", "_one"], descending=True,
                     next_cols=["pos", "neg"], totals_prefix="n_")
    origin = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    point = F.struct(safe_div("cum_neg", "n_neg").alias("fpr"), safe_div("cum_pos", "n_pos").alias("tpr"),
                     F.col("score").alias("threshold"))
    if drop_intermediate:
        r = r.filter((F.col("cum__one") == 1) | F.col("next_pos").isNull()
                     | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    # the group's first row also carries the origin
    rows = F.when(F.col("cum__one") == 1, F.array(origin, point)).otherwise(F.array(point))
    return r.select(*group_cols, F.explode(rows).alias("_p")).select(*group_cols, "_p.*")


def separation_gap(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (),
                   absent: str = "zero") -> DataFrame:
    """mean score of class 1 minus mean score of class 0.

    ``absent='zero'`` treats a missing class mean as 0.0; ``'null'`` yields NULL.
    """
    s = nan_to_null(F.col(score))
    m1 = F.avg(F.when(_is(y, 1), s))
    m0 = F.avg(F.when(_is(y, 0), s))
    if absent == "zero":
        m1, m0 = F.coalesce(m1, F.lit(0.0)), F.coalesce(m0, F.lit(0.0))
    return df.groupBy(*group_cols).agg(
        F.round(m1, 6).alias("mean_pos"), F.round(m0, 6).alias("mean_neg"),
        F.round(m1 - m0, 6).alias("separation"))


def row_breakdown(df: DataFrame, key_cols: Sequence[str], y: str, pred: str,
                  score: str | None = None) -> DataFrame:
    """Per-row verdict text, correctness and FP / FN flags."""
    word = lambda c: F.when(_is(c, 1), "Malicious").otherwise("Benign")
    cols = [*[F.col(k) for k in key_cols], F.col(y).alias("y"), F.col(pred).alias("pred"),
            word(y).alias("true_label"), word(pred).alias("predicted"),
            F.when(_is(pred, 1), "MALICIOUS").otherwise("BENIGN").alias("verdict"),
            (F.col(y) == F.col(pred)).cast("int").alias("correct"),
            (_is(y, 0) & _is(pred, 1)).cast("int").alias("fp"),
            (_is(y, 1) & _is(pred, 0)).cast("int").alias("fn")]
    if score is not None:
        cols.insert(len(key_cols) + 2, F.col(score).alias("score"))
    return df.select(*cols)


def accuracy_summary(df: DataFrame, y: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """correct / total and accuracy as a percentage."""
    agg = df.groupBy(*group_cols).agg(_count(F.col(y) == F.col(pred)).alias("correct"),
                                      F.count(F.lit(1)).alias("total"))
    return agg.withColumns({"accuracy": safe_div("correct", "total"),
                            "accuracy_pct": safe_div(F.col("correct") * 100, F.col("total"))})


def window_metrics(scored: DataFrame, y: str, pred: str, score: str,
                   tag_col: str = "window_tag", freeze: bool = True) -> DataFrame:
    """Per-window metrics table: confusion, rates, ROC-AUC, separation, unrounded.

    The scored table (one row per window and container: an aggregate, far
    smaller than the events) is frozen in the checkpoint folder once, so the
    confusion/separation aggregate and the AUC running sums do not each
    recompute the event pipeline.
    """
    if freeze:
        scored = cut_lineage(scored)
    s = nan_to_null(F.col(score))
    m = scored.groupBy(tag_col).agg(
        _count(_is(y, 0) & _is(pred, 0)).alias("tn"),
        _count(_is(y, 0) & _is(pred, 1)).alias("fp"),
        _count(_is(y, 1) & _is(pred, 0)).alias("fn"),
        _count(_is(y, 1) & _is(pred, 1)).alias("tp"),
        (F.avg(F.when(_is(y, 1), s)) - F.avg(F.when(_is(y, 0), s))).alias("separation"))
    m = with_rates(m)
    auc = roc_auc(scored, y, score, [tag_col]).select(tag_col, "roc_auc")
    return _join_on(m, auc, [tag_col], "left").select(
        tag_col, "tn", "fp", "fn", "tp", *rate_columns().keys(), "roc_auc", "separation")


def recommended_window(metrics: DataFrame, seconds: Mapping[str, int | None],
                       tag_col: str = "window_tag", f1_min: float = 0.7,
                       sep_min: float = 0.4, default: int = 15) -> DataFrame:
    """Smallest window (seconds) with F1 >= f1_min and separation >= sep_min,
    else ``default`` (K6)."""
    sec = F.create_map(*[x for t, n in seconds.items() if n is not None
                         for x in (F.lit(t), F.lit(int(n)))])
    n = sec[F.col(tag_col)]
    ok = (F.col("f1") >= f1_min) & (F.col("separation") >= sep_min) & n.isNotNull()
    return metrics.agg(F.coalesce(F.min(F.when(ok, n)), F.lit(default)).cast("int")
                       .alias("recommended_seconds"))


def best_model(metrics: DataFrame, ordinal_col: str = "ordinal") -> DataFrame:
    """Best candidate by F1; strict '>' in a scan means the first one wins ties (K5)."""
    return metrics.orderBy(F.desc("f1"), F.asc(ordinal_col)).limit(1)


def overfit_gap(train: DataFrame, test: DataFrame, key: str = "model",
                limit: float = 0.05) -> DataFrame:
    """train accuracy - test accuracy per model, flagged above ``limit``."""
    t = train.select(key, F.col("accuracy").alias("train_accuracy"))
    v = test.select(key, F.col("accuracy").alias("test_accuracy"))
    j = t.join(v, key)
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return j.withColumns({"gap": gap, "overfit": (gap > limit).cast("int")})


def reference_delta(reference: DataFrame, current: DataFrame, key: str = "model",
                    metric: str = "f1") -> DataFrame:
    """Reference metric minus current metric per key."""
    r = reference.select(key, F.col(metric).alias(f"reference_{metric}"))
    c = current.select(key, F.col(metric).alias(f"current_{metric}"))
    return r.join(c, key).withColumn("delta", F.col(f"reference_{metric}") - F.col(f"current_{metric}"))


def present(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column for presentation only."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`")
                       for c, t in df.dtypes])
