"""Registered queries that fit models (CV training, final fit, calibration,
explanations, embeddings, iterative imputation).

Fits are not SQL-expressible, so most of these have no oracle; their
properties are covered by tests (SHAP additivity, fold balance, isotonic
monotonicity, observed cells untouched, CI ordering).  Every fit is
registered with the library defaults (500 boosted trees, 100-tree forests,
2000 logistic iterations, 10 / 50 imputation rounds, 5 benchmark repeats).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.config import ImputationCfg
from strata.operators import calibrate as CA
from strata.operators import embed as EM
from strata.operators import encode as EN
from strata.operators import explain as EX
from strata.operators import impute as IM
from strata.operators import moments as MO
from strata.operators import train as TR
from strata.operators.metrics import fold_metrics
from strata.plans import q_cohort as QC
from strata.plans.registry import register
from strata.sources.fixtures import oracle_cte, scored, table

FEATS = QC.ENC_FEATS
GBT = TR.ModelSpec("gbt")
FOREST = TR.ModelSpec("forest")
LOGIT = TR.ModelSpec("logistic")
SVC = TR.ModelSpec("linear_svc")
MICE_ROUNDS = ImputationCfg.mice_max_iter  # the job's default; the operator alone stops at 10


def _train_table(spark, sf):
    """Prepared cohort: cleaned, filtered, encoded, median-filled (I-1)."""
    enc = QC._encoded(spark, sf)
    return IM.median_fill(enc.select(QC.ID, *FEATS, QC.TARGET), FEATS)


def _cv(spark, sf, spec):
    oof, _ = TR.cross_validate(_train_table(spark, sf), FEATS, QC.TARGET, QC.ID, spec, k=5, seed=42)
    return oof


@register("cv_gbt", ops="M-1 M-2 M-3 M-8 W-1 U-1", heavy=True)
def cv_gbt(spark, sf):
    return _cv(spark, sf, GBT)


@register("cv_forest", ops="M-5 M-3", heavy=True)
def cv_forest(spark, sf):
    return _cv(spark, sf, FOREST)


@register("cv_logistic", ops="M-6 M-3", heavy=True)
def cv_logistic(spark, sf):
    return _cv(spark, sf, LOGIT)


@register("cv_linear_svc", ops="M-7 F-11 M-3", heavy=True)
def cv_linear_svc(spark, sf):
    return _cv(spark, sf, SVC)


@register("cv_fold_metrics", ops="E-10 M-3", heavy=True)
def cv_fold_metrics(spark, sf):
    return fold_metrics(_cv(spark, sf, GBT), "y", "p", "fold", 0.5, 12)


@register("final_fit_score", ops="M-4 M-8 S-7", heavy=True)
def final_fit_score(spark, sf):
    data = _train_table(spark, sf)
    model = TR.fit(data, FEATS, QC.TARGET, GBT, final=True)
    path = TR.save_model(model, TR.model_dir(spark, "gbt-final"))
    loaded = TR.load_model("gbt", path)
    return TR.score(loaded, data, FEATS, "gbt", QC.ID, QC.TARGET)


@register("importance_ci", ops="A-17", heavy=True)
def importance_ci(spark, sf):
    _, models = TR.cross_validate(_train_table(spark, sf), FEATS, QC.TARGET, QC.ID, GBT, k=5, seed=42)
    rows = TR.fold_importances(models, FEATS)
    imp = spark.createDataFrame(rows, "fold int, feature string, importance double")
    return TR.importance_ci(imp, k=5)


@register("calibrate_platt", ops="M-9", heavy=True)
def calibrate_platt(spark, sf):
    s = scored(spark, sf).select("id", "y", F.col("p1").alias("p"))
    return CA.calibrate(s, "sigmoid", "y", "p").select("id", "y", "p", "p_cal")


# the fit at a score by the max-min formula: the greatest over the scores up to
# it of the least mean label from there to any score from it on
_ISOTONIC_SQL = oracle_cte("scored") + """, g AS (
  SELECT p1 AS p, row_number() OVER (ORDER BY p1) AS k, sum(count(*)) OVER (ORDER BY p1) AS n,
         sum(sum(y)) OVER (ORDER BY p1) AS s FROM scored WHERE p1 IS NOT NULL GROUP BY p1),
means AS (SELECT a.k AS i, b.k AS j, (b.s - coalesce(c.s, 0)) / (b.n - coalesce(c.n, 0)) AS m
          FROM g a JOIN g b ON b.k >= a.k LEFT JOIN g c ON c.k = a.k - 1),
least AS (SELECT i, j AS k, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM means),
fit AS (SELECT k, max(m) AS v FROM least GROUP BY k)
SELECT id, y, p1 AS p, v AS p_cal FROM scored JOIN g ON g.p = p1 JOIN fit USING (k)"""


@register("calibrate_isotonic", _ISOTONIC_SQL, dbl=["p", "p_cal"], ops="M-9", heavy=True)
def calibrate_isotonic(spark, sf):
    s = scored(spark, sf).select("id", "y", F.col("p1").alias("p"))
    return CA.calibrate(s, "isotonic", "y", "p").select("id", "y", "p", "p_cal")


def _shap_long(spark, sf):
    data = _train_table(spark, sf)
    model = TR.fit(data, FEATS, QC.TARGET, GBT, final=True)
    path = TR.save_model(model, TR.model_dir(spark, "gbt-shap"))
    return EX.tree_shap(data, model, path, FEATS, QC.ID)


@register("shap_rows", ops="X-1 X-3 J-7", heavy=True)
def shap_rows(spark, sf):
    return _shap_long(spark, sf)


@register("shap_mean_abs", ops="X-1 X-2", heavy=True)
def shap_mean_abs(spark, sf):
    return EX.mean_abs(_shap_long(spark, sf))


@register("shap_linear", ops="X-5 M-6", heavy=True)
def shap_linear(spark, sf):
    data = _train_table(spark, sf)
    model = TR.fit(data, FEATS, QC.TARGET, LOGIT, final=True)
    return EX.mean_abs(EX.linear_shap(data, model.coefficients.toArray(), FEATS, QC.ID))


GROUP_PARENTS = ["segment", "priority_txt"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _group_sql():
    cols = [("segment", v, f"segment_{v}") for v in SEGMENTS] + [("priority_txt", v, f"priority_txt_{v}") for v in PRIORITIES]
    onehot = ", ".join(f"CAST(COALESCE(CAST({p} = '{v}' AS INTEGER), 0) AS DOUBLE) AS \"{n}\"" for p, v, n in cols)
    per = " UNION ALL ".join(
        f"SELECT '{p}' AS parent, avg(abs(\"{n}\" - m)) AS s FROM oh, (SELECT avg(\"{n}\") AS m FROM oh)"
        for p, v, n in cols)
    grade = "SELECT 'grade' AS parent, avg(abs(CAST(grade AS DOUBLE) - m)) AS s FROM oh, (SELECT avg(CAST(grade AS DOUBLE)) AS m FROM oh)"
    return (QC.PIPE + f", oh AS (SELECT id, grade, {onehot} FROM kept) "
            f"SELECT parent AS feature, sum(s) AS mean_abs_shap FROM ({per} UNION ALL {grade}) GROUP BY parent")


def _one_hot_ranking(spark, sf):
    kept = QC._kept(spark, sf)
    oh = EN.one_hot(kept.select(QC.ID, "grade", *GROUP_PARENTS), GROUP_PARENTS)
    feats = [c for c in oh.columns if c != QC.ID]
    return EX.mean_abs(EX.linear_shap(oh, [1.0] * len(feats), feats, QC.ID))


@register("shap_group_parents", _group_sql(), dbl=["mean_abs_shap"], ops="X-4 X-5 F-15 U-2 F-16")
def shap_group_parents(spark, sf):
    return EX.group_parents(_one_hot_ranking(spark, sf), GROUP_PARENTS)


@register("shap_parent_columns", "SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', '{p}_{v}')" for p, values in (("segment", SEGMENTS), ("priority_txt", PRIORITIES)) for v in values) +
          ") AS t(parent, \"column\")", ops="S-9")
def shap_parent_columns(spark, sf):
    return EX.parent_columns(_one_hot_ranking(spark, sf), GROUP_PARENTS)


@register("background_sample", oracle_cte("scored") +
          "SELECT id, y, p1 FROM scored ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 200", ops="O-2")
def background_sample(spark, sf):
    return EX.background_sample(scored(spark, sf).select("id", "y", "p1"), "id", 200, 42)


@register("separability_pca", ops="M-11", heavy=True)
def separability_pca(spark, sf):
    return EM.separability_pca(table(spark, sf, "embeddings"), "embedding", "vec_id", "label")


@register("decision_grid", ops="M-10 M-6", heavy=True)
def decision_grid(spark, sf):
    return EM.decision_grid(_train_table(spark, sf), FEATS, QC.ID, QC.TARGET, n=300, kind="logistic")


@register("decision_grid_svc", ops="M-10 M-7 F-11", heavy=True)
def decision_grid_svc(spark, sf):
    return EM.decision_grid(_train_table(spark, sf), FEATS, QC.ID, QC.TARGET, n=300, kind="linear_svc")


@register("decision_grid_gbt", ops="M-10 M-1", heavy=True)
def decision_grid_gbt(spark, sf):
    return EM.decision_grid(_train_table(spark, sf), FEATS, QC.ID, QC.TARGET, n=300, kind="gbt")


def _impute_input(spark, sf):
    return QC._encoded(spark, sf).select(QC.ID, *FEATS, QC.TARGET)


@register("impute_mice", ops="I-3 I-4 I-6 I-7 F-12 J-8", heavy=True)
def impute_mice(spark, sf):
    return IM.impute(_impute_input(spark, sf), QC.ID, FEATS, "mice", max_iter=MICE_ROUNDS, tol=1e-3, n_nearest=30)


@register("impute_mice_posterior", ops="I-3 I-5 F-13", heavy=True)
def impute_mice_posterior(spark, sf):
    return IM.mice_impute(_impute_input(spark, sf), QC.ID, FEATS, max_iter=MICE_ROUNDS, sample_posterior=True, seed=0,
                          min_value=0.0, add_indicator=True)


GRAM_COLS = ["price_txt", "half_num", "twin_num", "grade"]


def _gram_sql():
    """Sums of products of (1, predictors, target) over the rows where the
    target was seen, after the median fill."""
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in GRAM_COLS)
    fill = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), med_{c}) AS {c}, {c} IS NOT NULL AS o_{c}" for c in GRAM_COLS)
    rows = []
    for t in GRAM_COLS:
        z = ["1.0", *[c for c in GRAM_COLS if c != t], t]
        names = ["(start)", *z[1:]]
        rows += [f"SELECT '{t}' AS target, '{names[i]}' AS a, '{names[j]}' AS b, sum({z[i]} * {z[j]}) AS total FROM filled WHERE o_{t}"
                 for i in range(len(z)) for j in range(len(z))]
    return QC.PIPE + f", filled AS (SELECT {fill} FROM enc, (SELECT {med} FROM enc)) " + " UNION ALL ".join(rows)


@register("impute_gram", _gram_sql(), dbl=["total"], ops="I-3 I-1")
def impute_gram(spark, sf):
    """The normal equations of a first round: (target, a, b, total)."""
    enc = QC._encoded(spark, sf).select(QC.ID, *[F.col(c).cast("double") for c in GRAM_COLS])
    cur = IM.median_fill(enc.select("*", *[F.col(c).isNotNull().alias(f"_o_{c}") for c in GRAM_COLS]), GRAM_COLS)
    regressions = [(t, [c for c in GRAM_COLS if c != t]) for t in GRAM_COLS]
    rows = []
    for (t, ps), g in zip(regressions, MO.grams(cur, regressions)):
        names = ["(start)", *ps, t]
        rows += [(t, a, b, float(g[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "target string, a string, b string, total double")


MASK_COLS = ["price_txt", "day_num", "half_num"]


def _masked_sql():
    from strata.functions.hashing import md5_uniform_sql
    rows = [f"SELECT {r} AS repeat, '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NOT NULL AND {md5_uniform_sql(42, str(r), 'id', repr(c))} "
            f"< 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_masked, CAST(count({c}) AS BIGINT) AS n_seen FROM enc"
            for r in range(5) for c in MASK_COLS]
    return QC.PIPE + " UNION ALL ".join(rows)


@register("masked_cells", _masked_sql(), ops="I-9")
def masked_cells(spark, sf):
    """The cells that each repeat of the imputation benchmark hides."""
    enc = QC._encoded(spark, sf).select(QC.ID, *MASK_COLS)
    parts = []
    for r in range(5):
        m = IM.mask_cells(enc, QC.ID, MASK_COLS, 0.10, r, 42)
        sums = m.agg(*[F.count(f"_true_{c}").alias(f"m_{c}") for c in MASK_COLS],
                     *[F.count(F.coalesce(F.col(c), F.col(f"_true_{c}"))).alias(f"s_{c}") for c in MASK_COLS])
        parts += [sums.select(F.lit(r).alias("repeat"), F.lit(c).alias("feature"), F.col(f"m_{c}").alias("n_masked"),
                              F.col(f"s_{c}").alias("n_seen")) for c in MASK_COLS]
    return reduce(DataFrame.unionByName, parts)


@register("impute_forest", ops="I-2 I-8", heavy=True)
def impute_forest(spark, sf):
    return IM.impute(_impute_input(spark, sf), QC.ID, FEATS, "missforest")


@register("impute_benchmark", ops="I-9", heavy=True)
def impute_benchmark(spark, sf):
    return IM.imputation_benchmark(_impute_input(spark, sf).select(QC.ID, *FEATS), QC.ID, FEATS,
                                   methods=("mice", "missforest"), mask_frac=0.10, repeats=5, seed=42,
                                   mice={"max_iter": MICE_ROUNDS})


# --------------------------------------------------------- V3: documents
DOC_FEATS = ["n_chars", "n_spaces", "n_dots", "quality"]


def _docs(spark, sf):
    from strata.sources.fixtures import doc_screen
    return doc_screen(spark, sf).select("id", *[F.col(c).cast("double").alias(c) for c in DOC_FEATS], "y")


@register("class_weights_docs", oracle_cte("doc_screen") +
          "SELECT n_neg, n_pos, n_neg / greatest(n_pos, 1) AS scale_pos_weight FROM ("
          "SELECT CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, "
          "CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM doc_screen)",
          dbl=["scale_pos_weight"], ops="A-13 M-2")
def class_weights_docs(spark, sf):
    from strata.operators.profile import class_counts
    return class_counts(_docs(spark, sf), "y")


@register("cv_gbt_docs", ops="M-1 M-2 M-3 W-1", heavy=True)
def cv_gbt_docs(spark, sf):
    """Class-weighted boosted trees on the imbalanced document label."""
    oof, _ = TR.cross_validate(_docs(spark, sf), DOC_FEATS, "y", "id", GBT, k=5, seed=42)
    return oof
