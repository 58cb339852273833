"""T3: properties of what SQL cannot state (fits, SHAP, imputation) and
plan-shape checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.operators import bootstrap as BS
from strata.operators import calibrate as CA
from strata.operators import cascade as C
from strata.operators import explain as EX
from strata.operators import folds as FO
from strata.operators import impute as IM
from strata.operators import train as TR
from strata.plans import q_cohort as QC
from strata.sources.fixtures import scored


def test_fold_sizes_balanced_per_class(spark):
    f = FO.stratified_folds(scored(spark, SF_SMALL), "y", "id", 5, 42)
    counts = f.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_cascade_label_is_threshold_of_final_probability(spark):
    pred = C.predictions(scored(spark, SF_SMALL), "id", "y", "p1", "p2", 0.5)
    bad = pred.where(F.col("y_pred") != (F.col("y_prob") >= 0.5).cast("int")).count()
    assert bad == 0


def test_bootstrap_ci_ordering(spark):
    ci = BS.bootstrap_ci(scored(spark, SF_SMALL), "y", "p1", "id", "AUROC", B=50, seed=7).first()
    assert ci["ci_low"] <= ci["mean"] <= ci["ci_high"] and ci["n_replicates"] == 50


def test_isotonic_monotone(spark):
    s = scored(spark, SF_SMALL).select("id", "y", F.col("p1").alias("p"))
    out = CA.calibrate(s, "isotonic").select("p", "p_cal").distinct().orderBy("p").collect()
    vals = [r["p_cal"] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(vals, vals[1:]))


def _train_table(spark):
    enc = QC._encoded(spark, SF_SMALL)
    return IM.median_fill(enc.select(QC.ID, *QC.ENC_FEATS, QC.TARGET), QC.ENC_FEATS)


def test_tree_shap_additivity(spark):
    data = _train_table(spark)
    spec = TR.ModelSpec("gbt", {"maxIter": 5})
    model = TR.fit(data, QC.ENC_FEATS, QC.TARGET, spec)
    path = TR.save_model(model, TR.model_dir(spark, "test-shap"))
    long = EX.tree_shap(data, model, path, QC.ENC_FEATS, QC.ID, log_odds=False)
    per_row = long.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=QC.ENC_FEATS, outputCol="_x")
    margin = model.transform(va.transform(data)).select(
        F.col(QC.ID).alias("id"), vector_to_array("rawPrediction")[1].alias("m"))
    j = per_row.join(margin, "id").select((F.col("b") + F.col("s") - F.col("m")).alias("d")).collect()
    assert len(j) == data.count()
    assert max(abs(r["d"]) for r in j) < 1e-9


def test_imputation_keeps_observed_and_fills_all(spark):
    enc = QC._encoded(spark, SF_SMALL).select(QC.ID, *QC.ENC_FEATS)
    out = IM.impute(enc, QC.ID, QC.ENC_FEATS, "mice", max_iter=2)
    j = enc.alias("a").join(out.alias("b"), QC.ID)
    for c in QC.ENC_FEATS:
        changed = j.where(F.col(f"a.{c}").isNotNull() & (F.col(f"a.{c}") != F.col(f"b.{c}"))).count()
        assert changed == 0, c
        assert out.where(F.col(c).isNull()).count() == 0, c


def test_cv_auc_reasonable(spark):
    from strata.operators.metrics import rank_metrics
    data = _train_table(spark)
    oof, models = TR.cross_validate(data, QC.ENC_FEATS, QC.TARGET, QC.ID, TR.ModelSpec("gbt", {"maxIter": 5}), k=3)
    assert oof.count() == data.count() and len(models) == 3
    assert rank_metrics(oof, "y", "p").first()["AUROC"] > 0.7


def test_no_single_partition_exchange_in_bootstrap_rank(spark):
    plan = BS.replicate_metrics(scored(spark, SF_SMALL), "y", "p1", "id", B=20)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SinglePartition" not in plan


def test_pushdown_and_pruning_on_scored(spark):
    from strata.operators.metrics import threshold_metrics
    plan = threshold_metrics(scored(spark, SF_SMALL), "y", "p1")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1 and "ROC_AUC" in df.columns


def test_numpy_bootstrap_weights_equal_spark_expression(spark):
    s = scored(spark, SF_SMALL).select("id", "y", "p1")
    a = BS.replicate_score_groups(s, "y", "p1", "id", B=37, seed=5)
    from strata.operators.metrics import score_groups
    b = score_groups(BS.replicate_weights(s, "id", 37, 5), "y", "p1", keys=["replicate"], weight="_w")
    ra = {(r["replicate"], r["p1"]): (r["_tp"], r["_fp"]) for r in a.collect()}
    rb = {(r["replicate"], r["p1"]): (r["_tp"], r["_fp"]) for r in b.collect()}
    assert ra == rb and len(ra) > 37


def test_forest_shap_additivity_in_probability(spark):
    data = _train_table(spark)
    model = TR.fit(data, QC.ENC_FEATS, QC.TARGET, TR.ModelSpec("forest", {"numTrees": 4, "maxDepth": 3}))
    path = TR.save_model(model, TR.model_dir(spark, "test-rf-shap"))
    long = EX.tree_shap(data, model, path, QC.ENC_FEATS, QC.ID)
    per_row = long.groupBy("id").agg(F.sum("phi").alias("s"), F.first("base").alias("b"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=QC.ENC_FEATS, outputCol="_x")
    prob = model.transform(va.transform(data)).select(F.col(QC.ID).alias("id"),
                                                      vector_to_array("probability")[1].alias("m"))
    d = per_row.join(prob, "id").select(F.max(F.abs(F.col("b") + F.col("s") - F.col("m")))).first()[0]
    assert d < 1e-9


def test_posterior_sampling_deterministic_and_observed_kept(spark):
    enc = QC._encoded(spark, SF_SMALL).select(QC.ID, *QC.ENC_FEATS)
    a = IM.mice_impute(enc, QC.ID, QC.ENC_FEATS, max_iter=1, sample_posterior=True, seed=3)
    b = IM.mice_impute(enc, QC.ID, QC.ENC_FEATS, max_iter=1, sample_posterior=True, seed=3)
    c = IM.mice_impute(enc, QC.ID, QC.ENC_FEATS, max_iter=1, sample_posterior=False)
    j = a.alias("a").join(b.alias("b"), QC.ID).join(c.alias("c"), QC.ID)
    assert j.where(F.col("a.day_num") != F.col("b.day_num")).count() == 0
    assert j.where(F.col("a.day_num") != F.col("c.day_num")).count() > 0


def test_registered_fits_use_the_library_defaults(spark, monkeypatch):
    from strata.operators import embed, impute, train
    from strata.plans import q_models as Q

    gbt, forest = train.make_learner(Q.GBT), train.make_learner(Q.FOREST)
    assert (gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize()) == (500, 3, 0.02)
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (100, 10)
    assert train.make_learner(Q.LOGIT).getMaxIter() == 2000 and train.make_learner(Q.SVC).getMaxIter() == 100
    calls = []
    monkeypatch.setattr(Q, "_impute_input", lambda spark, sf: spark.range(1).selectExpr("*", *[f"0 AS `{c}`" for c in {Q.QC.ID, *Q.FEATS} - {"id"}]))
    for name in ("impute", "mice_impute", "imputation_benchmark"):
        monkeypatch.setattr(impute, name, lambda *a, _name=name, **kw: calls.append((_name, a[3:], kw)))
    for query in ("impute_mice", "impute_forest", "impute_mice_posterior", "impute_benchmark"):
        getattr(Q, query)(spark, SF_SMALL)
    (_, a1, mice), (_, a2, miss), (_, _, post), (_, _, bench) = calls
    assert a1 == ("mice",) and mice["max_iter"] == 50 and post["max_iter"] == 50
    assert a2 == ("missforest",) and not {"max_iter", "num_trees", "max_depth"} & set(miss)
    assert bench["repeats"] == 5 and bench["mice"] == {"max_iter": 50} and "forest" not in bench

    class Stop(Exception):
        pass

    def fit(df, features, y, spec, final=True):
        assert train.make_learner(spec).getMaxIter() == 500
        raise Stop

    monkeypatch.setattr(train, "fit", fit)
    df = spark.createDataFrame([(i, float(i), float(i * i % 7), i % 2) for i in range(20)], "id long, a double, b double, y int")
    with pytest.raises(Stop):
        embed.decision_grid(df, ["a", "b"], "id", "y", n=3, kind="gbt")


def test_shap_of_leaves_with_many_features_against_all_subsets():
    import itertools
    import math
    rng = np.random.default_rng(5)
    for s in (1, 2, 5, 8, 9):
        leaves = [{"value": float(rng.normal()), "feats": [(int(f), *sorted(rng.normal(size=2).tolist()), float(rng.uniform(0.1, 0.9)))
                                                          for f in sorted(rng.choice(10, s, replace=False))]} for _ in range(3)]
        leaves.append({"value": 0.5, "feats": []})
        x = rng.normal(size=(4, 10))
        phi, base = EX.shap_values(x, leaves, 10)
        want, mean = np.zeros((4, 10)), 0.0
        for leaf in leaves:
            r = [f[3] for f in leaf["feats"]]
            mean += leaf["value"] * math.prod(r)
            for row in range(4):
                a = [float(lo < x[row, f] <= hi) for f, lo, hi, _ in leaf["feats"]]
                for i, (f, *_) in enumerate(leaf["feats"]):
                    others = [j for j in range(s) if j != i]
                    for t in range(s):
                        for sub in itertools.combinations(others, t):
                            c = math.factorial(t) * math.factorial(s - t - 1) / math.factorial(s)
                            rest = math.prod(a[j] if j in sub else r[j] for j in others)
                            want[row, f] += leaf["value"] * c * rest * (a[i] - r[i])
        assert np.allclose(phi, want, atol=1e-12) and abs(base - mean) < 1e-12


def test_shap_of_a_deep_forest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12))
    y = (np.sin(3 * x[:, :6]).sum(axis=1) + x[:, 6] * x[:, 7] > 0).astype(int)
    names = [f"f{i}" for i in range(12)]
    df = spark.createDataFrame([(i, *r.tolist(), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, " + ", ".join(f"{n} double" for n in names) + ", y int")
    spec = TR.ModelSpec("forest", {"numTrees": 4})
    model = TR.fit(df, names, "y", spec)
    assert max(t.depth for t in model.trees) > 6
    path = TR.save_model(model, TR.model_dir(spark, "deep"))
    some = df.where("id % 50 = 0")
    got = {int(r["id"]): r["s"] for r in EX.tree_shap(some, model, path, names, "id").groupBy("id").agg(
        (F.first("base") + F.sum("phi")).alias("s")).collect()}
    p = {r["id"]: r["p"] for r in TR.score(model, some, names, "forest", "id", "y").collect()}
    assert len(got) == 30 and all(abs(got[i] - p[i]) < 1e-9 for i in p)
