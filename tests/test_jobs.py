"""End-to-end: the four jobs on the sf0.001 cohort view."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.config import DataCfg, EvalCfg, ImputationCfg, JobCfg, TrainCfg, load_config
from strata.plans import jobs
from strata.sources import io as IO
from strata.sources.fixtures import cohort_raw


def test_config_roundtrip(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("output_dir: out\ndata:\n  id_col: id\n  categorical_cols: [segment]\n"
                 "training:\n  kind: gbt\n  params: {maxIter: 3}\n")
    cfg = load_config(str(p))
    assert cfg.data.categorical_cols == ("segment",) and cfg.training.params == {"maxIter": 3}


def test_four_jobs(spark):
    out = tempfile.mkdtemp(prefix="strata-jobs-")
    raw = cohort_raw(spark, SF_SMALL)
    csv = IO.write_cohort_csv(raw, os.path.join(out, "cohort.csv"))
    cfg = JobCfg(
        output_dir=out,
        data=DataCfg(id_col="id", target_col="target", categorical_cols=("segment",), int_cols=("grade",)),
        imputation=ImputationCfg(method="mice", mice_max_iter=2),
        training=TrainCfg(kind="gbt", params={"maxIter": 3}, n_splits=3),
        evaluation=EvalCfg(bootstrap_b=20, find_best_thr=True, do_calibration=True, calib_method="isotonic"),
    )
    arts = jobs.prepare(spark, cfg, csv)
    prepared = spark.read.parquet(arts["final"])
    assert prepared.where(F.col("price_txt").isNull()).count() == 0
    assert "priority_txt" not in prepared.columns  # text column dropped before imputation
    res = jobs.train_stage(spark, cfg, prepared)
    assert os.path.isdir(res["model_path"])
    metrics = spark.read.parquet(res["reports"]["Metrics"])
    assert metrics.count() == 3 + 2
    test = jobs.test_stage(spark, cfg, prepared, res["model_path"])
    assert spark.read.parquet(test["Metrics"]).count() == 1
    casc = jobs.cascade(spark, cfg, prepared, res["model_path"], res["model_path"])
    assert spark.read.parquet(casc["Agreement_Analysis"]).count() == 7


def test_reader_rejects_unknown_extension_and_missing_path(spark):
    import pytest
    with pytest.raises(ValueError):
        IO.read_cohort(spark, "/tmp/cohort.xlsx")
    with pytest.raises(Exception):
        IO.read_cohort(spark, "/tmp/definitely-missing-strata/cohort.csv").count()


@pytest.mark.parametrize("kind, params", [("forest", {"numTrees": 2, "maxDepth": 8}), ("logistic", {"maxIter": 5})])
def test_train_stage_reports_shap_of_every_kind(spark, kind, params, tmp_path):
    # nine distinct rows: no score is without a draw in the bootstrap
    rows = [(i, float(i % 3), float(i // 3 % 3), int(i % 3 + i % 5 > 3)) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, a double, b double, target int")
    cfg = JobCfg(output_dir=str(tmp_path), data=DataCfg(id_col="id", target_col="target"),
                 training=TrainCfg(kind=kind, params=params, n_splits=2), evaluation=EvalCfg(bootstrap_b=5))
    reports = jobs.train_stage(spark, cfg, table)["reports"]
    assert {r["feature"] for r in spark.read.parquet(reports["shap_mean_abs"]).collect()} == {"a", "b"}


def test_prepare_runs_the_imputation_benchmark_when_enabled(spark, tmp_path, monkeypatch):
    csv = IO.write_cohort_csv(cohort_raw(spark, SF_SMALL), str(tmp_path / "cohort.csv"))
    seen = {}

    def benchmark(df, id_col, cols, **kw):
        seen.update(kw)
        return spark.createDataFrame([("mice", 0)], "method string, repeat int")

    monkeypatch.setattr(jobs.IM, "imputation_benchmark", benchmark)
    cfg = JobCfg(output_dir=str(tmp_path), data=DataCfg(id_col="id", target_col="target", categorical_cols=("segment",)),
                 imputation=ImputationCfg(method="mice", mice_max_iter=1, eval_enabled=True, eval_mask_frac=0.2, eval_repeats=3))
    arts = jobs.prepare(spark, cfg, csv)
    assert spark.read.parquet(arts["imputation_benchmark"]).count() == 1
    assert (seen["mask_frac"], seen["repeats"], seen["mice"]["max_iter"], seen["forest"]["num_trees"]) == (0.2, 3, 1, 100)


def test_cascade_truth_is_derived_from_the_grade(spark, tmp_path, monkeypatch):
    rows = [(i, float(i % 3), i % 5, 0) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, a double, grade int, target int")
    monkeypatch.setattr(jobs.TR, "load_model", lambda kind, path: path)

    def score(df, feats, stages):
        assert feats == ["a"] and [(model, name) for model, _, name in stages] == [("m1", "p1"), ("m2", "p2")]
        return df.select("*", (F.col("a") / 3).alias("p1"), (F.col("a") / 3).alias("p2"))

    monkeypatch.setattr(jobs.TR, "score_stages", score)
    cfg = JobCfg(output_dir=str(tmp_path), data=DataCfg(id_col="id", target_col="target", grade_col="grade"))
    pred = spark.read.parquet(jobs.cascade(spark, cfg, table, "m1", "m2")["Predictions"])
    assert {r["ID"]: r["y_true"] for r in pred.collect()} == {i: int(g >= 3) for i, _, g, _ in rows}
