"""Registered queries over the ``scored`` view (labels + two stage scores):
cascade, thresholded and rank metrics, curves, folds, bootstrap, thresholds.
"""

from __future__ import annotations

from strata.functions.hashing import md5_seed32_sql, mix32_uniform_sql, poisson1_weight_sql
from strata.operators import bootstrap as BS
from strata.operators import cascade as C
from strata.operators import folds as FO
from strata.operators import metrics as M
from strata.operators import thresholds as TH
from strata.plans import oracle as O
from strata.plans.registry import register
from strata.sources.fixtures import oracle_cte, scored

T = 0.5          # evaluation.prob_thr
NB_STAGE = 12    # stage configs: evaluation.ece.n_bins
NB_CASCADE = 5   # cascade config: evaluation.ece.n_bins
K, SEED = 5, 42  # training.cv.n_splits, experiment.random_seed
B = 1000         # evaluation.bootstrap.B

W = oracle_cte("scored")
THR_DBL = ["Accuracy", "Precision", "Recall", "F1", "ECE", "Brier", "Specificity", "PPV", "NPV"]
EVAL_DBL = ["pos_rate_test", "AUROC", "AUPRC", *THR_DBL]

# ---------------------------------------------------------------- cascade
CASCADE_PRED_SQL = f"""
SELECT id AS ID, y AS y_true,
       CASE WHEN p1 >= {O.lit(T)} THEN (CASE WHEN p2 >= {O.lit(T)} THEN 1 ELSE 0 END) ELSE 0 END AS y_pred,
       CASE WHEN p1 >= {O.lit(T)} THEN p2 ELSE p1 END AS y_prob,
       p1 AS y_prob_pred_m1, CASE WHEN p1 >= {O.lit(T)} THEN 1 ELSE 0 END AS y_pred_m1,
       p2 AS y_prob_pred_m2, CASE WHEN p2 >= {O.lit(T)} THEN 1 ELSE 0 END AS y_pred_m2
FROM scored"""


def _cascade(spark, sf):
    return C.predictions(scored(spark, sf), "id", "y", "p1", "p2", T)


@register("cascade_predict", W + CASCADE_PRED_SQL, ops="C-1 C-5 P-10")
def cascade_predict(spark, sf):
    """C-1/C-5: combined cascade prediction table."""
    return _cascade(spark, sf)


@register("cascade_outcome", W + f"""
SELECT ID, CASE WHEN y_pred_m1 = 0 THEN 'Grade 0' WHEN y_pred_m2 = 0 THEN 'Grade 1-2' ELSE 'Grade 3-5' END AS outcome
FROM ({CASCADE_PRED_SQL})""", ops="C-7")
def cascade_outcome(spark, sf):
    return C.outcome(_cascade(spark, sf))


_CASC_METRICS_SQL = f"""
SELECT t.Accuracy, t.Precision, t.Recall, t.F1, t.Specificity, t.NPV, t.PPV, r.AUROC AS ROC_AUC, r.AUPRC AS PR_AUC,
       t.Brier, t.TN, t.FP, t.FN, t.TP, t.ECE
FROM ({O.threshold_metrics('cp', 'y_true', 'y_prob', T, NB_CASCADE)}) t,
     ({O.rank_metrics('cp', 'y_true', 'y_prob')}) r"""


@register("cascade_metrics", W + f", cp AS ({CASCADE_PRED_SQL})" + _CASC_METRICS_SQL,
          dbl=["Accuracy", "Precision", "Recall", "F1", "Specificity", "NPV", "PPV", "ROC_AUC", "PR_AUC",
               "Brier", "ECE"], ops="C-2 C-4 E-1 E-2 E-4 E-5")
def cascade_metrics(spark, sf):
    return C.cascade_metrics(_cascade(spark, sf), T, NB_CASCADE)


@register("cascade_ece", W + f", cp AS ({CASCADE_PRED_SQL})" + O.ece("cp", "y_true", "y_prob", NB_CASCADE),
          dbl=["ECE"], ops="C-4 E-3")
def cascade_ece(spark, sf):
    return C.cascade_ece(_cascade(spark, sf), NB_CASCADE)


def _agreement_sql():
    conds = [
        ("GT=1 and M1=1 and M2=1", "y_true = 1 AND y_pred_m1 = 1 AND y_pred_m2 = 1", "npos"),
        ("GT=0 and M1=0 and M2=0", "y_true = 0 AND y_pred_m1 = 0 AND y_pred_m2 = 0", "nneg"),
        ("GT=1 and models disagree", "y_true = 1 AND y_pred_m1 <> y_pred_m2", "npos"),
        ("GT=0 and models disagree", "y_true = 0 AND y_pred_m1 <> y_pred_m2", "nneg"),
        ("GT=1 total", "y_true = 1", "npos"),
        ("GT=0 total", "y_true = 0", "nneg"),
        ("Total samples", "TRUE", None),
    ]
    parts = []
    for label, cond, den in conds:
        within = (f"CASE WHEN {den} > 0 THEN round_even(c / {den}, 4) END" if den
                  else "CAST(NULL AS DOUBLE)")
        parts.append(
            f"SELECT '{label}' AS Metric, c AS Count, round_even(c / n, 4) AS Percent_of_total, {within} AS Percent_within_GT "
            f"FROM (SELECT CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS c, count(*) AS n, "
            f"sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS npos, sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS nneg FROM cp)")
    return " UNION ALL ".join(parts)


@register("cascade_agreement", W + f", cp AS ({CASCADE_PRED_SQL}) " + _agreement_sql(),
          dbl=["Percent_of_total", "Percent_within_GT"], ops="C-3")
def cascade_agreement(spark, sf):
    return C.agreement(_cascade(spark, sf))


@register("cascade_keyed", W + CASCADE_PRED_SQL, ops="J-1 J-3 C-1 C-5")
def cascade_keyed(spark, sf):
    """Stage scores kept as separate tables, aligned by an id join."""
    s = scored(spark, sf)
    return C.keyed_cascade(s.select("id", "p1"), s.select("id", "p2"), s.select("id", "y"), "id", T)


# ------------------------------------------------------- thresholded metrics
@register("threshold_metrics", W + O.threshold_metrics("scored", "y", "p1", T, NB_STAGE), dbl=THR_DBL,
          ops="E-1 E-2 E-3 P-10")
def threshold_metrics(spark, sf):
    return M.threshold_metrics(scored(spark, sf), "y", "p1", T, NB_STAGE)


@register("brier", W + "SELECT avg((p1 - y) * (p1 - y)) AS Brier FROM scored", dbl=["Brier"], ops="E-2")
def brier(spark, sf):
    return M.brier(scored(spark, sf), "y", "p1")


@register("macro_f1", W + f"""
SELECT f1p AS F1_pos, f1n AS F1_neg, (f1p + f1n) / 2 AS F1_macro FROM (
  SELECT CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0.0 END AS f1p,
         CASE WHEN 2 * TN + FN + FP > 0 THEN 2 * TN / (2 * TN + FN + FP) ELSE 0.0 END AS f1n
  FROM ({O.threshold_metrics('scored', 'y', 'p1', T, 1)}))""", dbl=["F1_pos", "F1_neg", "F1_macro"], ops="E-12")
def macro_f1(spark, sf):
    return M.macro_f1(scored(spark, sf), "y", "p1", T)


@register("ece", W + O.ece("scored", "y", "p1", NB_STAGE), dbl=["ECE"], ops="E-3")
def ece(spark, sf):
    return M.ece(scored(spark, sf), "y", "p1", NB_STAGE)


@register("prevalence", W + "SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(CAST(y AS DOUBLE)) AS prevalence FROM scored",
          dbl=["prevalence"], ops="E-9")
def prevalence(spark, sf):
    return M.prevalence(scored(spark, sf), "y")


@register("test_metrics_row", W + f"""
SELECT 1 AS fold, n_test, pos_rate_test, AUROC, AUPRC, {O.lit(T)} AS threshold_used, FALSE AS calibrated,
       Accuracy, Precision, Recall, F1, Specificity, PPV, NPV, ECE, Brier, TN, FP, FN, TP
FROM ({O.evaluate('scored', 'y', 'p1', T, NB_STAGE)})""", dbl=EVAL_DBL + ["threshold_used"], ops="E-13")
def test_metrics_row(spark, sf):
    return M.stage_test_row(scored(spark, sf), "y", "p1", T, NB_STAGE, calibrated=False)


# ------------------------------------------------------------ rank metrics
@register("auroc_exact", W + f"SELECT AUROC FROM ({O.rank_metrics('scored', 'y', 'p1')})", dbl=["AUROC"],
          ops="E-4 W-2")
def auroc_exact(spark, sf):
    return M.auroc(scored(spark, sf), "y", "p1")


@register("average_precision", W + f"SELECT AUPRC FROM ({O.rank_metrics('scored', 'y', 'p1')})", dbl=["AUPRC"],
          ops="E-5 W-2")
def average_precision(spark, sf):
    return M.average_precision(scored(spark, sf), "y", "p1")


@register("roc_points", W + f"""
SELECT CAST(p1 AS DOUBLE) AS threshold, CASE WHEN _tfp > 0 THEN _cfp / _tfp END AS fpr,
       CASE WHEN _ttp > 0 THEN _ctp / _ttp END AS tpr
FROM ({O.rank_curve('scored', 'y', 'p1')})
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0, 0.0""", dbl=["threshold", "fpr", "tpr"], ops="E-6 W-2")
def roc_points(spark, sf):
    return M.roc_points(scored(spark, sf), "y", "p1")


@register("pr_points", W + f"""
SELECT CAST(p1 AS DOUBLE) AS threshold, _ctp / (_ctp + _cfp) AS precision, _ctp / _ttp AS recall
FROM ({O.rank_curve('scored', 'y', 'p1')}) WHERE _ttp > 0 AND _tfp > 0 AND _ctp - _tp < _ttp
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0 FROM (SELECT count(DISTINCT y) AS k FROM scored) WHERE k = 2""",
          dbl=["threshold", "precision", "recall"], ops="E-7 P-12 W-2")
def pr_points(spark, sf):
    return M.pr_points(scored(spark, sf), "y", "p1")


@register("calibration_uniform", W + f"""
SELECT {O.count_edges_below('p1', O.uniform_edges(NB_STAGE)[1:-1])} AS bin, avg(p1) AS prob_pred,
       avg(CAST(y AS DOUBLE)) AS prob_true, count(*) AS n
FROM scored GROUP BY 1""", dbl=["prob_pred", "prob_true"], ops="E-8")
def calibration_uniform(spark, sf):
    return M.calibration_curve(scored(spark, sf), "y", "p1", NB_STAGE, "uniform")


def _quantile_bins_sql():
    fr = ", ".join(O.lit(f) for f in O.uniform_edges(NB_STAGE))
    inner = " + ".join(f"(CASE WHEN p2 > q[{i + 2}] THEN 1 ELSE 0 END)" for i in range(NB_STAGE - 1))
    return f"""
SELECT ({inner}) AS bin, avg(p2) AS prob_pred, avg(CAST(y AS DOUBLE)) AS prob_true, count(*) AS n
FROM scored, (SELECT quantile_cont(p2, [{fr}]) AS q FROM scored) GROUP BY 1"""


@register("calibration_quantile", W + _quantile_bins_sql(), dbl=["prob_pred", "prob_true"], ops="E-8")
def calibration_quantile(spark, sf):
    return M.calibration_curve(scored(spark, sf), "y", "p2", NB_STAGE, "quantile")


# ------------------------------------------------------------------- folds
FOLDS_SQL = f"""
SELECT id, y, p1, p2, model,
       CAST((row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id) - 1) % {K} + 1 AS INTEGER) AS fold
FROM scored"""


def _folded(spark, sf):
    return FO.stratified_folds(scored(spark, sf), "y", "id", K, SEED)


def _folded_table(spark, sf):
    """Folds materialised once for reports that aggregate them several times."""
    from strata.session import cut_lineage
    return cut_lineage(_folded(spark, sf))


@register("stratified_folds", W + f"SELECT id, y, fold FROM ({FOLDS_SQL})", ops="W-1")
def stratified_folds(spark, sf):
    return _folded(spark, sf).select("id", "y", "fold")


@register("confusion_by_fold", W + f", f AS ({FOLDS_SQL}) " + f"""
SELECT fold, CAST(sum(CASE WHEN y = 0 AND p1 < {O.lit(T)} THEN 1 ELSE 0 END) AS BIGINT) AS TN,
       CAST(sum(CASE WHEN y = 0 AND p1 >= {O.lit(T)} THEN 1 ELSE 0 END) AS BIGINT) AS FP,
       CAST(sum(CASE WHEN y = 1 AND p1 < {O.lit(T)} THEN 1 ELSE 0 END) AS BIGINT) AS FN,
       CAST(sum(CASE WHEN y = 1 AND p1 >= {O.lit(T)} THEN 1 ELSE 0 END) AS BIGINT) AS TP
FROM f GROUP BY ROLLUP (fold)""", ops="A-16 W-1")
def confusion_by_fold(spark, sf):
    return M.confusion(_folded(spark, sf), "y", "p1", T, keys=["fold"], rollup=True)


FOLD_METRICS_SQL = f"""
SELECT fold, CAST(sum(n_test) OVER () - n_test AS BIGINT) AS n_train, n_test, pos_rate_test, AUROC, AUPRC,
       Accuracy, Precision, Recall, F1, Specificity, PPV, NPV, ECE, Brier, TN, FP, FN, TP
FROM ({O.evaluate('f', 'y', 'p1', T, NB_STAGE, ['fold'])})"""


@register("fold_metrics", W + f", f AS ({FOLDS_SQL}) " + FOLD_METRICS_SQL, dbl=EVAL_DBL, ops="E-10 W-1 U-1")
def fold_metrics(spark, sf):
    return M.fold_metrics(_folded_table(spark, sf), "y", "p1", "fold", T, NB_STAGE)


_FOLD_COLS = ["n_train", "n_test", "pos_rate_test", "AUROC", "AUPRC", "Accuracy", "Precision", "Recall", "F1",
              "Specificity", "PPV", "NPV", "ECE", "Brier", "TN", "FP", "FN", "TP"]


def _fold_summary_sql():
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FOLD_COLS)
    mean = ", ".join(f"avg({c}) AS {c}" for c in _FOLD_COLS)
    std = ", ".join(f"stddev_samp({c}) AS {c}" for c in _FOLD_COLS)
    return (f", f AS ({FOLDS_SQL}), fm AS ({FOLD_METRICS_SQL}) "
            f"SELECT CAST(fold AS VARCHAR) AS fold, {cast} FROM fm "
            f"UNION ALL SELECT 'mean', {mean} FROM fm UNION ALL SELECT 'std', {std} FROM fm")


@register("fold_summary", W + _fold_summary_sql(), dbl=_FOLD_COLS, ops="A-15 U-1")
def fold_summary(spark, sf):
    from strata.session import cut_lineage
    # the k-row fold table feeds three union branches: materialise it once
    return M.fold_summary(cut_lineage(fold_metrics(spark, sf)))


@register("model_compare", W + O.evaluate("scored", "y", "p1", T, NB_STAGE, ["model"]), dbl=EVAL_DBL,
          ops="E-15")
def model_compare(spark, sf):
    return M.model_compare(scored(spark, sf), "y", "p1", "model", T, NB_STAGE)


# ---------------------------------------------------------------- bootstrap
def _bootstrap_sql(metric: str) -> str:
    src = f"(SELECT y, p1, {md5_seed32_sql(SEED, 'id')} AS s FROM scored), range(0, {B}) t(r)"
    u = mix32_uniform_sql("s", "r", src, "r, y, p1")
    reps = f"SELECT r, y, p1, {poisson1_weight_sql('u')} AS w FROM ({u})"
    curve = O.rank_curve("reps", "y", "p1", ["r"], weight="w")
    rm = O.rank_metrics_from_curve(curve, ["r"])
    return (f", reps AS ({reps}) SELECT avg({metric}) AS mean, quantile_cont({metric}, 0.025) AS ci_low, "
            f"quantile_cont({metric}, 0.975) AS ci_high, count(*) AS n_replicates "
            f"FROM ({rm}) WHERE n_pos > 0 AND n_neg > 0")


@register("bootstrap_auc_ci", W + _bootstrap_sql("AUROC"), dbl=["mean", "ci_low", "ci_high"], ops="E-11 J-6 O-3")
def bootstrap_auc_ci(spark, sf):
    return BS.bootstrap_ci(scored(spark, sf), "y", "p1", "id", "AUROC", B, SEED)


@register("bootstrap_ap_ci", W + _bootstrap_sql("AUPRC"), dbl=["mean", "ci_low", "ci_high"], ops="E-11 J-6 O-3")
def bootstrap_ap_ci(spark, sf):
    return BS.bootstrap_ci(scored(spark, sf), "y", "p1", "id", "AUPRC", B, SEED)


# --------------------------------------------------------------- thresholds
def _best_threshold_sql(metric: str) -> str:
    thr = "CAST(t AS DOUBLE) / 100"
    grid = (f"SELECT {thr} AS thr, "
            f"sum(CASE WHEN y = 1 AND p1 >= {thr} THEN 1 ELSE 0 END) AS TP, "
            f"sum(CASE WHEN y = 0 AND p1 >= {thr} THEN 1 ELSE 0 END) AS FP, "
            f"sum(CASE WHEN y = 1 AND p1 < {thr} THEN 1 ELSE 0 END) AS FN, "
            f"sum(CASE WHEN y = 0 AND p1 < {thr} THEN 1 ELSE 0 END) AS TN "
            f"FROM scored, range(30, 71) g(t) GROUP BY t")
    score = {"f1": "CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0.0 END",
             "youden": "(CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END) + "
                       "(CASE WHEN TN + FP > 0 THEN TN / (TN + FP) ELSE 0.0 END) - 1"}[metric]
    return (f", grid AS (SELECT thr, {score} AS s FROM ({grid})) "
            f"SELECT '{metric}' AS metric, round(min(thr), 6) AS best_threshold, max(s) AS best_score "
            f"FROM grid WHERE s = (SELECT max(s) FROM grid)")


@register("best_threshold_f1", W + _best_threshold_sql("f1"), dbl=["best_threshold", "best_score"], ops="E-14")
def best_threshold_f1(spark, sf):
    return TH.best_threshold(scored(spark, sf), "y", "p1", "f1")


@register("best_threshold_youden", W + _best_threshold_sql("youden"), dbl=["best_threshold", "best_score"],
          ops="E-14")
def best_threshold_youden(spark, sf):
    return TH.best_threshold(scored(spark, sf), "y", "p1", "youden")
