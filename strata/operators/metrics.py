"""Evaluation metrics as DataFrame jobs (E-1..E-10, E-12, E-13, E-15, A-16).

Every function takes a scored DataFrame with a 0/1 label column and a
probability column, plus optional grouping ``keys`` (fold, model,
replicate, ...).  Thresholded metrics are one aggregation pass (partial
aggregation per task, no row shuffle); rank metrics first collapse rows to
one row per distinct score (map-side combine), then take running sums with
:func:`strata.functions.prefix.running_sums`.

Output column names follow the reference's metric names (Accuracy,
Precision, ..., TN, FP, FN, TP).  Internal columns are ``_``-prefixed since
Spark resolves names case-insensitively (``tp`` would clash with ``TP``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.prefix import running_sums


# ----------------------------------------------------------------------------
# helpers
# ----------------------------------------------------------------------------
def _div(num: Column, den: Column, zero=0.0) -> Column:
    """num/den, ``zero`` when den == 0 (the reference's zero_division=0)."""
    return F.when(den > 0, num / den).otherwise(F.lit(zero))


def join_on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join two per-key tables; for one-row (key-less) tables a
    constant key keeps it an equi-join of two single rows."""
    keys = list(keys)
    if keys:
        return a.join(b, on=keys, how="inner")
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), on="_k").drop("_k")


def uniform_edges(n_bins: int) -> list[float]:
    """``linspace(0, 1, n_bins + 1)`` as Python floats (literal bin edges)."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def digitize_right(p: Column, edges: Sequence[float]) -> Column:
    """numpy ``digitize(p, edges, right=True)``: index i with
    edges[i-1] < p <= edges[i]; 0 below the first edge, len(edges) above."""
    expr = None
    for i, e in enumerate(edges):
        cond = p <= F.lit(float(e))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(edges)))


def count_edges_below(p: Column, edges: Sequence[float]) -> Column:
    """Number of ``edges`` strictly below ``p`` (numpy searchsorted left)."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(p > F.lit(float(e)), 1).otherwise(0)
    return total


def predict_label(p: str | Column, threshold: float) -> Column:
    """P-10: ``p >= threshold`` as 0/1."""
    pc = F.col(p) if isinstance(p, str) else p
    return (pc >= F.lit(float(threshold))).cast("int")


# ----------------------------------------------------------------------------
# E-1 / E-2 / E-3 / A-16: thresholded metrics in one pass
# ----------------------------------------------------------------------------
def _confusion_aggs(y: Column, pred: Column) -> list[Column]:
    return [
        F.sum(F.when((y == 0) & (pred == 0), 1).otherwise(0)).cast("long").alias("TN"),
        F.sum(F.when((y == 0) & (pred == 1), 1).otherwise(0)).cast("long").alias("FP"),
        F.sum(F.when((y == 1) & (pred == 0), 1).otherwise(0)).cast("long").alias("FN"),
        F.sum(F.when((y == 1) & (pred == 1), 1).otherwise(0)).cast("long").alias("TP"),
    ]


def confusion(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5,
              keys: Sequence[str] = (), rollup: bool = False) -> DataFrame:
    """A-16: TN, FP, FN, TP per key; ``rollup`` adds the accumulated row
    (keys null), as the reference sums the per-fold matrices."""
    pred = predict_label(p, threshold)
    grouped = df.rollup(*keys) if rollup else df.groupBy(*keys)
    return grouped.agg(*_confusion_aggs(F.col(y), pred))


def _with_bin(df: DataFrame, p: str, n_bins: int) -> DataFrame:
    """Uniform ``(lo, hi]`` ECE bin of each row, computed once as a column
    (the aggregates below read it; inlining the CASE into each of them
    would multiply the generated code)."""
    return df.withColumn("_ebin", digitize_right(F.col(p), uniform_edges(n_bins)))


def _ece_aggs(y: Column, p: Column, n_bins: int) -> tuple[list[Column], Column]:
    """Per-bin sums for ECE with uniform ``(lo, hi]`` bins; p = 0 is in no
    bin but stays in the denominator (numpy digitize right=True).  Expects
    the ``_ebin`` column from :func:`_with_bin`."""
    b = F.col("_ebin")
    aggs = []
    for i in range(1, n_bins + 1):
        inb = b == i
        aggs += [
            F.sum(F.when(inb, 1).otherwise(0)).alias(f"_en{i}"),
            F.sum(F.when(inb, p).otherwise(0.0)).alias(f"_ep{i}"),
            F.sum(F.when(inb, y).otherwise(0)).alias(f"_ey{i}"),
        ]
    n = F.col("_n")
    terms = [
        F.when(F.col(f"_en{i}") > 0,
               (F.col(f"_en{i}") / n) * F.abs(F.col(f"_ep{i}") / F.col(f"_en{i}") - F.col(f"_ey{i}") / F.col(f"_en{i}")))
        .otherwise(F.lit(0.0))
        for i in range(1, n_bins + 1)
    ]
    ece = terms[0]
    for t in terms[1:]:
        ece = ece + t
    return aggs, ece


def threshold_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5,
                      n_bins: int = 12, keys: Sequence[str] = (), with_counts: bool = False) -> DataFrame:
    """E-1 + E-2 + E-3 per key, one aggregation pass over the rows.
    ``with_counts`` also returns n_test and pos_rate_test from the same pass."""
    yc, pc = F.col(y), F.col(p)
    pred = predict_label(pc, threshold)
    ece_aggs, ece = _ece_aggs(yc, pc, n_bins)
    agg = _with_bin(df, p, n_bins).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(yc.cast("double")).alias("_py"),
        F.sum((pc - yc) * (pc - yc)).alias("_sse"),
        *_confusion_aggs(yc, pred),
        *ece_aggs,
    )
    tn, fp, fn, tp, n = (F.col(c) for c in ("TN", "FP", "FN", "TP", "_n"))
    precision = _div(tp, tp + fp)
    counts = [n.alias("n_test"), F.col("_py").alias("pos_rate_test")] if with_counts else []
    return agg.select(
        *keys, *counts,
        ((tp + tn) / n).alias("Accuracy"),
        precision.alias("Precision"),
        _div(tp, tp + fn).alias("Recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("F1"),
        ece.alias("ECE"),
        (F.col("_sse") / n).alias("Brier"),
        _div(tn, tn + fp).alias("Specificity"),
        precision.alias("PPV"),
        _div(tn, tn + fn).alias("NPV"),
        "TN", "FP", "FN", "TP",
    )


def ece(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 12,
        keys: Sequence[str] = ()) -> DataFrame:
    """E-3: expected calibration error per key."""
    aggs, expr = _ece_aggs(F.col(y), F.col(p), n_bins)
    return _with_bin(df, p, n_bins).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *aggs) \
        .select(*keys, expr.alias("ECE"))


def brier(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """E-2: mean squared error of the probability."""
    d = F.col(p) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("Brier"))


def prevalence(df: DataFrame, y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """E-9: positive rate and class counts."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y)).cast("long").alias("n_pos"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )


def macro_f1(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5,
             keys: Sequence[str] = ()) -> DataFrame:
    """E-12: unweighted mean of the F1 of class 1 and class 0."""
    c = confusion(df, y, p, threshold, keys)
    tn, fp, fn, tp = (F.col(k) for k in ("TN", "FP", "FN", "TP"))
    f1_pos = _div(2 * tp, 2 * tp + fp + fn)
    f1_neg = _div(2 * tn, 2 * tn + fn + fp)
    return c.select(*keys, f1_pos.alias("F1_pos"), f1_neg.alias("F1_neg"),
                    ((f1_pos + f1_neg) / 2).alias("F1_macro"))


# ----------------------------------------------------------------------------
# W-2 / E-4..E-7: rank metrics
# ----------------------------------------------------------------------------
def score_groups(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = (),
                 weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct score) with positive / negative counts
    (``_tp``, ``_fp``).  Partial aggregation happens before the shuffle."""
    w = F.col(weight) if weight else F.lit(1)
    yc = F.col(y)
    return df.groupBy(*keys, p).agg(
        F.sum(F.when(yc == 1, w).otherwise(0)).cast("long").alias("_tp"),
        F.sum(F.when(yc == 0, w).otherwise(0)).cast("long").alias("_fp"),
    )


def rank_curve(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = (),
               weight: str | None = None, grouped: DataFrame | None = None, **prefix_kw) -> DataFrame:
    """W-2: cumulative positives/negatives by descending score within keys.

    Columns: keys, p, _tp, _fp, cum__tp, cum__fp, tot__tp, tot__fp.
    """
    g = grouped if grouped is not None else score_groups(df, y, p, keys, weight)
    return running_sums(g, p, ["_tp", "_fp"], keys=keys, descending=True, **prefix_kw)


def rank_metrics_from_curve(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """E-4 (AUROC, ties count half) and E-5 (step-sum average precision)."""
    tp, fp = F.col("_tp"), F.col("_fp")
    ctp, cfp = F.col("cum__tp"), F.col("cum__fp")
    agg = curve.groupBy(*keys).agg(
        F.sum(fp * (ctp - tp / 2.0)).alias("_auc_num"),
        F.sum(tp * F.coalesce(F.try_divide(ctp, ctp + cfp), F.lit(0.0))).alias("_ap_num"),  # weights may all be 0 so far
        F.max("tot__tp").alias("n_pos"),
        F.max("tot__fp").alias("n_neg"),
    )
    npos, nneg = F.col("n_pos"), F.col("n_neg")
    return agg.select(
        *keys,
        F.when((npos > 0) & (nneg > 0), F.col("_auc_num") / (npos.cast("double") * nneg)).alias("AUROC"),
        F.when(npos > 0, F.col("_ap_num") / npos).alias("AUPRC"),
        "n_pos", "n_neg",
    )


def rank_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = (),
                 weight: str | None = None, **prefix_kw) -> DataFrame:
    """AUROC and AUPRC per key (null when a class is absent)."""
    return rank_metrics_from_curve(rank_curve(df, y, p, keys, weight, **prefix_kw), keys)


def auroc(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(df, y, p, keys).select(*keys, "AUROC")


def average_precision(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    return rank_metrics(df, y, p, keys).select(*keys, "AUPRC")


def _one_row_per_key(g: DataFrame, keys: Sequence[str], **cols: Column) -> DataFrame:
    return g.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in cols.items()])


def roc_points(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """E-6: (threshold, fpr, tpr) at every distinct score, plus the (0, 0)
    start row whose threshold is null (the library uses +inf)."""
    c = rank_curve(df, y, p, keys)
    pts = c.select(
        *keys, F.col(p).cast("double").alias("threshold"),
        F.when(F.col("tot__fp") > 0, F.col("cum__fp") / F.col("tot__fp")).alias("fpr"),
        F.when(F.col("tot__tp") > 0, F.col("cum__tp") / F.col("tot__tp")).alias("tpr"),
    )
    start = _one_row_per_key(c, keys, threshold=F.lit(None).cast("double"),
                             fpr=F.lit(0.0), tpr=F.lit(0.0))
    return pts.unionByName(start)


def pr_points(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """E-7 + P-12: (threshold, precision, recall) from the highest score down
    to the first score reaching full recall, plus the (precision 1, recall 0)
    end row; empty for a key with one class only."""
    c = rank_curve(df, y, p, keys).where((F.col("tot__tp") > 0) & (F.col("tot__fp") > 0))
    ctp, cfp = F.col("cum__tp"), F.col("cum__fp")
    pts = c.where(ctp - F.col("_tp") < F.col("tot__tp")).select(
        *keys, F.col(p).cast("double").alias("threshold"),
        (ctp / (ctp + cfp)).alias("precision"),
        (ctp / F.col("tot__tp")).alias("recall"),
    )
    # a key-less aggregate over no rows still yields one row: keep the end
    # point only where the key had rows (both classes present)
    end = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.lit(None).cast("double")).alias("threshold"),
                               F.max(F.lit(1.0)).alias("precision"), F.max(F.lit(0.0)).alias("recall")) \
        .where(F.col("_n") > 0).drop("_n")
    return pts.unionByName(end)


# ----------------------------------------------------------------------------
# E-8: calibration curve
# ----------------------------------------------------------------------------
def quantile_edges(df: DataFrame, p: str, n_bins: int) -> list[float]:
    """Exact linear-interpolated quantile edges (n_bins + 1 values read on
    the driver), computed without buffering the scores in one task."""
    from strata.operators.profile import exact_quantiles
    fr = [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]
    got = {r["frac"]: r["value"] for r in exact_quantiles(df, [p], fr).collect()}
    return [float(got[f]) for f in fr]


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10,
                      strategy: str = "uniform", keys: Sequence[str] = ()) -> DataFrame:
    """E-8: per non-empty bin, mean predicted probability and fraction of
    positives.  Bins use interior edges only, so p = 0 is in the first bin."""
    if strategy == "uniform":
        edges = uniform_edges(n_bins)
    elif strategy == "quantile":
        if keys:
            raise ValueError("quantile calibration bins are global; call per key")
        edges = quantile_edges(df, p, n_bins)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    b = count_edges_below(F.col(p), edges[1:-1])
    return (df.withColumn("_bin", b).groupBy(*keys, "_bin")
            .agg(F.avg(F.col(p)).alias("prob_pred"), F.avg(F.col(y).cast("double")).alias("prob_true"),
                 F.count(F.lit(1)).alias("n"))
            .withColumnRenamed("_bin", "bin"))


# ----------------------------------------------------------------------------
# E-10 / E-13 / E-15 / A-15: metric rows
# ----------------------------------------------------------------------------
METRIC_COLS = ["Accuracy", "Precision", "Recall", "F1", "Specificity", "PPV", "NPV", "ECE", "Brier",
               "TN", "FP", "FN", "TP"]


def evaluate(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, n_bins: int = 12,
             keys: Sequence[str] = ()) -> DataFrame:
    """Rank + thresholded metrics per key: n_test, pos_rate_test, AUROC,
    AUPRC, then the thresholded metrics."""
    thr = threshold_metrics(df, y, p, threshold, n_bins, keys, with_counts=True)
    rk = rank_metrics(df, y, p, keys).select(*keys, "AUROC", "AUPRC")
    out = join_on_keys(thr, rk, keys)
    return out.select(*keys, "n_test", "pos_rate_test", "AUROC", "AUPRC", *METRIC_COLS)


def fold_metrics(df: DataFrame, y: str = "y", p: str = "p", fold: str = "fold",
                 threshold: float = 0.5, n_bins: int = 12) -> DataFrame:
    """E-10: one row per fold with n_train = rows outside the fold."""
    ev = evaluate(df, y, p, threshold, n_bins, keys=[fold])
    n_all = F.sum("n_test").over(Window.partitionBy())  # rows = folds (k)
    return ev.select(fold, (n_all - F.col("n_test")).alias("n_train"), *[c for c in ev.columns if c != fold])


def fold_summary(fm: DataFrame, fold: str = "fold") -> DataFrame:
    """A-15: fold rows plus ``mean`` and ``std`` (sample) rows, fold as text."""
    value_cols = [c for c in fm.columns if c != fold]
    rows = fm.select(F.col(fold).cast("string").alias(fold), *[F.col(c).cast("double").alias(c) for c in value_cols])
    mean = fm.agg(*[F.avg(c).alias(c) for c in value_cols]).select(F.lit("mean").alias(fold), *value_cols)
    std = fm.agg(*[F.stddev_samp(c).alias(c) for c in value_cols]).select(F.lit("std").alias(fold), *value_cols)
    return rows.unionByName(mean).unionByName(std)


def stage_test_row(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5,
                   n_bins: int = 12, calibrated: bool = False) -> DataFrame:
    """E-13: the held-out test metric row (fold 1, threshold_used, calibrated)."""
    ev = evaluate(df, y, p, threshold, n_bins)
    return ev.select(
        F.lit(1).alias("fold"), "n_test", "pos_rate_test", "AUROC", "AUPRC",
        F.lit(float(threshold)).alias("threshold_used"), F.lit(bool(calibrated)).alias("calibrated"),
        *METRIC_COLS,
    )


def model_compare(df: DataFrame, y: str = "y", p: str = "p", model: str = "model",
                  threshold: float = 0.5, n_bins: int = 12) -> DataFrame:
    """E-15: the same report per model result (model is one more key)."""
    return evaluate(df, y, p, threshold, n_bins, keys=[model])
