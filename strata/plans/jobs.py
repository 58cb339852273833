"""The four end-to-end jobs a user runs: prepare, train a stage, test a
stage, and the two-stage cascade.  Each is a driver function chaining the
operators; every heavy step is a Spark job, artefacts are datasets.

    prepare(spark, cfg, path)               -> final feature table path
    train_stage(spark, cfg, table_path)     -> model path, CV reports
    test_stage(spark, cfg, table, model)    -> metric row, curves
    cascade(spark, cfg, table, m1, m2)      -> predictions, summary, agreement
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.config import JobCfg
from strata.functions import clean as CL
from strata.operators import bootstrap as BS
from strata.operators import calibrate as CA
from strata.operators import cascade as C
from strata.operators import encode as EN
from strata.operators import explain as EX
from strata.operators import impute as IM
from strata.operators import metrics as M
from strata.operators import profile as PR
from strata.operators import thresholds as TH
from strata.operators import train as TR
from strata.session import cut_lineage
from strata.sources import io as IO
from strata.streaming.score_stream import stream_cascade


def prepare(spark: SparkSession, cfg: JobCfg, path: str) -> dict[str, str]:
    """Profile the raw table, clean, drop sparse rows, encode, impute,
    round, optional log1p; every artefact is written as a dataset."""
    out = cfg.output_dir
    d = cfg.data
    raw = IO.read_cohort(spark, path)
    target = CL.target_column(raw, d.target_col)
    arts = {}
    arts.update(IO.write_report({"Overview": PR.overview(raw), "Describe_All": PR.describe_all(raw)},
                                os.path.join(out, "describe_all")))
    corr = PR.corr_matrix(raw, d.corr_method)
    pairs = PR.correlated_pairs(corr, CL.numeric_columns(raw), d.corr_threshold)
    arts.update(IO.write_report({"Correlation_Matrix": corr,
                                 "Highly_Correlated_Features": PR.ordered(
                                     pairs, F.desc("Correlation"), "Feature_1", "Feature_2")},
                                os.path.join(out, "correlation_analysis")))
    cleaned, plan = CL.clean_inequalities(raw, d.id_col, cfg.imputation.eps, cfg.imputation.eps_overrides)
    cleaned = cut_lineage(cleaned)
    arts["cleaned"] = IO.write_snapshot(cleaned, os.path.join(out, "patient_inequalities_cleaned"))
    arts["quality_issues"] = IO.write_snapshot(CL.quality_issues(raw, plan, d.id_col), os.path.join(out, "quality_issues"))
    kept, dropped = CL.drop_high_row_missing(cleaned, d.id_col, cfg.imputation.drop_missing)
    arts["missing_report"] = IO.write_snapshot(CL.row_missing_report(cleaned, d.id_col),
                                               os.path.join(out, "patient_missing_report"))
    arts["column_missing"] = IO.write_snapshot(CL.column_missing_report(cleaned), os.path.join(out, "column_missing_report"))
    enc, mapping = EN.ordinal_encode(kept, d.categorical_cols)
    arts["mapping"] = IO.write_mapping(mapping, os.path.join(out, "encoding_mappings.json"))
    enc = cut_lineage(enc)
    feats = [c for c in CL.numeric_columns(enc) if c not in (d.id_col, target)]
    text = [c for c in enc.columns if c not in feats and c not in (d.id_col, target)]
    i = cfg.imputation
    mice = {"max_iter": i.mice_max_iter, "tol": i.mice_tol, "n_nearest": i.mice_n_nearest, "min_value": i.mice_min_value,
            "max_value": i.mice_max_value, "estimator": i.mice_estimator, "order": i.mice_order,
            "initial_strategy": i.mice_initial_strategy, "seed": i.mice_seed, "sample_posterior": i.sample_posterior}
    forest = {"max_iter": i.forest_max_iter, "num_trees": i.forest_num_trees, "max_depth": i.forest_max_depth}
    if i.eval_enabled:
        arts["imputation_benchmark"] = IO.write_snapshot(
            IM.imputation_benchmark(enc.select(d.id_col, *feats), d.id_col, feats, mask_frac=i.eval_mask_frac,
                                    repeats=i.eval_repeats, mice=mice, forest=forest),
            os.path.join(out, "imputation_benchmark"))
    imp = IM.impute(enc.select(d.id_col, *feats, target), d.id_col, feats, i.method,
                    **({**mice, "add_indicator": i.add_indicator} if i.method.lower() == "mice" else forest))
    imp = CL.round_half_even_int(imp, [c for c in d.int_cols if c in imp.columns])
    imp = CL.order_columns(imp, d.id_col, target)
    if text:
        arts["dropped_text_columns"] = IO.write_snapshot(
            spark.createDataFrame([(c,) for c in text], "feature string"), os.path.join(out, "dropped_text_columns"))
    final = imp
    if cfg.log_transform.enabled:
        log_cols = CL.numeric_columns(imp, [d.id_col, target, *cfg.log_transform.exclude_from_log])
        neg = PR.ordered(CL.negative_report(imp, log_cols), F.desc("n_negative"), "min_value", "feature")
        arts["negative_report"] = IO.write_snapshot(neg, os.path.join(out, "negative_value_report"))
        final = CL.apply_log1p(imp, log_cols, check=True)
    arts["final"] = IO.write_snapshot(final, os.path.join(out, f"patient_imputed_{cfg.imputation.method.lower()}"))
    prepared = spark.read.parquet(arts["final"])
    eda = [c for c in prepared.columns if c != d.id_col]
    arts["dropped_rows"] = IO.write_snapshot(dropped.orderBy(F.desc("missing_rate"), "patient_id"),
                                             os.path.join(out, "dropped_patients"))
    arts.update(IO.write_report({
        "skewness": PR.ordered(PR.skewness(prepared.select(eda), exclude=[target]), F.desc("skewness"), "feature"),
        "outliers_percentiles": PR.ordered(PR.outliers_percentile(prepared.select(eda), exclude=[target]),
                                           F.desc("n_high_outliers"), "feature"),
        "group_summary": PR.by_target(prepared.select(eda), target),
        "violin_summary": PR.violin_summary(prepared.select(eda), exclude=[target]),
    }, os.path.join(out, "eda")))
    return arts


def train_stage(spark: SparkSession, cfg: JobCfg, table: DataFrame) -> dict[str, object]:
    """Stratified CV with fold metrics, final fit and save, SHAP ranking,
    curves and bootstrap CIs; optional calibration + threshold search."""
    d, t, e = cfg.data, cfg.training, cfg.evaluation
    target = CL.target_column(table, d.target_col)
    table = CL.drop_features(table, d.drop_features, d.drop_feature_enable)
    feats = [c for c in table.columns if c not in (d.id_col, target)]
    spec = TR.ModelSpec(t.kind, t.params, t.seed)
    oof, models = TR.cross_validate(table, feats, target, d.id_col, spec, t.n_splits, t.seed, e.prob_thr)
    oof = cut_lineage(oof)
    fm = M.fold_metrics(oof, "y", "p", "fold", e.prob_thr, e.n_bins)
    out = cfg.output_dir
    reports = IO.write_report({
        "Metrics": M.fold_summary(fm), "Predictions": oof,
        "Confusion": M.confusion(oof, "y", "p", e.prob_thr, ["fold"], rollup=True),
        "ROC": M.roc_points(oof, "y", "p"), "PR": M.pr_points(oof, "y", "p"),
        "Calibration": M.calibration_curve(oof, "y", "p", e.n_bins, e.strategy),
        "AUC_CI": BS.bootstrap_ci(oof, "y", "p", d.id_col, "AUROC", e.bootstrap_b, e.bootstrap_seed),
        "AP_CI": BS.bootstrap_ci(oof, "y", "p", d.id_col, "AUPRC", e.bootstrap_b, e.bootstrap_seed),
        "Importance": TR.importance_ci(spark.createDataFrame(TR.fold_importances(models, feats),
                                                             "fold int, feature string, importance double"),
                                       t.n_splits),
    }, os.path.join(out, "cv_report"))
    final = TR.fit(table, feats, target, spec, final=True)
    path = TR.save_model(final, os.path.join(out, "final_model"))
    if t.kind in ("gbt", "forest"):
        long = EX.tree_shap(table, final, path, feats, d.id_col)
    else:
        long = EX.linear_shap(table, final.coefficients.toArray(), feats, d.id_col)
    reports.update(IO.write_report({"shap_mean_abs": PR.ordered(EX.mean_abs(long), F.desc("mean_abs_shap"),
                                                                "feature")}, os.path.join(out, "shap")))
    scores = oof
    if e.do_calibration:
        # M-9: calibrator fitted on out-of-fold scores, saved beside the model
        cal = CA.fit_calibrator(oof, e.calib_method, "y", "p")
        CA.save_calibrator(cal, path)
        scores = CA.apply_calibrator(cal, oof, e.calib_method, "p", "p_cal") \
            .select("id" if "id" in oof.columns else d.id_col, "y", F.col("p_cal").alias("p"))
    if e.find_best_thr or e.do_calibration:
        # E-14 on the (calibrated) out-of-fold scores; S-8 artefact beside the model
        best = TH.best_threshold(scores, "y", "p", e.thr_metric, e.thr_min, e.thr_max, e.thr_step).first()
        CA.save_threshold(spark, path, best["best_threshold"], e.thr_metric)
    return {"model_path": path, "reports": reports}


def test_stage(spark: SparkSession, cfg: JobCfg, table: DataFrame, model_path: str) -> dict[str, str]:
    """Score a held-out table with a saved model: metric row, curves."""
    d, e = cfg.data, cfg.evaluation
    target = CL.target_column(table, d.target_col)
    table = CL.drop_features(table, d.drop_features, d.drop_feature_enable)
    feats = [c for c in table.columns if c not in (d.id_col, target)]
    threshold = CA.load_threshold(spark, model_path) if e.do_calibration else e.prob_thr
    model = TR.load_model(cfg.training.kind, model_path)
    scored = TR.score(model, table, feats, cfg.training.kind, d.id_col, target, threshold)
    if not e.do_calibration:
        scored = cut_lineage(scored)        # five reports read it
    else:
        cal = CA.load_calibrator(model_path, e.calib_method)
        scored = CA.apply_calibrator(cal, scored, e.calib_method, "p", "p_cal") \
            .select(d.id_col, "y", F.col("p_cal").alias("p")) \
            .withColumn("pred", (F.col("p") >= F.lit(float(threshold))).cast("int"))
        scored = cut_lineage(scored)
    return IO.write_report({
        "Metrics": M.stage_test_row(scored, "y", "p", threshold, e.n_bins, e.do_calibration),
        "Predictions": scored, "ROC": M.roc_points(scored, "y", "p"), "PR": M.pr_points(scored, "y", "p"),
        "Calibration": M.calibration_curve(scored, "y", "p", e.n_bins, e.strategy),
    }, os.path.join(cfg.output_dir, "test_report"))


def _stages(kind: str, m1_path: str, m2_path: str) -> list[tuple]:
    return [(TR.load_model(kind, path), kind, name) for path, name in ((m1_path, "p1"), (m2_path, "p2"))]


def cascade(spark: SparkSession, cfg: JobCfg, table: DataFrame, m1_path: str, m2_path: str) -> dict[str, str]:
    """Score every row with both stages, combine, report."""
    d, e = cfg.data, cfg.evaluation
    target = CL.target_column(table, d.target_col)
    table = CL.drop_features(table, d.drop_features, d.drop_feature_enable)
    if d.grade_col:
        table = table.withColumn(target, C.final_label(d.grade_col, target))
    feats = [c for c in table.columns if c not in (d.id_col, target, d.grade_col)]
    kind = cfg.training.kind
    both = TR.score_stages(table, feats, _stages(kind, m1_path, m2_path))
    pred = cut_lineage(C.predictions(both, d.id_col, target, "p1", "p2", e.prob_thr))
    return IO.write_report({
        "Summary": C.cascade_metrics(pred, e.prob_thr, e.n_bins), "Predictions": pred,
        "Agreement_Analysis": C.agreement(pred), "Outcome": C.outcome(pred),
        "ROC": M.roc_points(pred, "y_true", "y_prob"), "PR": M.pr_points(pred, "y_true", "y_prob"),
        "Calibration": M.calibration_curve(pred, "y_true", "y_prob", e.n_bins),
    }, os.path.join(cfg.output_dir, "cascade_report"))


def cascade_stream(spark: SparkSession, cfg: JobCfg, source_dir: str, schema: str, m1_path: str, m2_path: str,
                   out_dir: str | None = None, fmt: str = "parquet") -> str:
    """C-6 on a stream: both saved models and the threshold are loaded once;
    each row of the files that arrive is scored by both, combined and written
    exactly once."""
    d, e = cfg.data, cfg.evaluation
    threshold = CA.load_threshold(spark, m2_path) if e.do_calibration else e.prob_thr
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    target = d.target_col if d.target_col in names else names[-1]
    feats = [c for c in names if c not in (d.id_col, target, d.grade_col, *(d.drop_features if d.drop_feature_enable else ()))]
    stages = _stages(cfg.training.kind, m1_path, m2_path)

    def derive(raw):
        rows = raw.withColumn(target, C.final_label(d.grade_col, target)) if d.grade_col else raw
        return TR.score_stages(rows, feats, stages).select(F.col(d.id_col).alias("id"), F.col(target).alias("y"), "p1", "p2")

    return stream_cascade(spark, source_dir, schema, derive, out_dir, threshold, fmt)
