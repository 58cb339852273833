"""Model training with stratified cross-validation (M-1..M-8, M-2, A-13,
A-15, A-17, F-11, S-7).

Spark ML does the fitting: each fold is one distributed ``fit`` on the rows
outside the fold (the executors build the histograms; the driver only holds
the trees / coefficients), the folds side by side (forests of large tables a few
or one at a time), then the fold's rows are scored with
``transform``.  Out-of-fold predictions of all folds form one DataFrame
(``id, fold, y, p, pred``) evaluated with :mod:`strata.operators.metrics`
grouped by fold in a single pass.

Class weighting (M-2): the positive class gets weight neg / max(pos, 1)
from the training rows of the fold (one tiny aggregate per fold); the final
model uses neg / pos and refuses a single-class table.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.clean import q, sigmoid
from strata.operators.boost import BoostedTrees
from strata.operators.folds import stratified_folds
from strata.session import cut_lineage, ensure_checkpoint_dir


def t975(df: int) -> float:
    """The 0.975 quantile of Student's t with ``df`` degrees of freedom, by
    bisection on the integrated density (0 below one degree)."""
    if df < 1:
        return 0.0
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    nodes, weights = np.polynomial.legendre.leggauss(64)

    def half(t: float) -> float:  # the mass between 0 and t
        x = (nodes + 1) * t / 2
        return float(scale * t / 2 * (weights @ (1 + x * x / df) ** (-(df + 1) / 2)))

    lo, hi = 1.0, 13.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if half(mid) < 0.475 else (lo, mid)
    return (lo + hi) / 2


@dataclass
class ModelSpec:
    """Which learner and its parameters (reference names mapped, §2.12)."""
    kind: str = "gbt"  # gbt | forest | logistic | linear_svc
    params: Mapping[str, object] = field(default_factory=dict)
    seed: int = 42


# boosted-tree parameter mapping from the reference's config names
GBT_DEFAULTS = {"maxIter": 500, "stepSize": 0.02, "maxDepth": 3, "subsamplingRate": 0.6,
                "featureSubsetStrategy": "0.7", "minInstancesPerNode": 10}


#: rows of a partition, at least, that boosted trees are fitted on: every tree
#: costs three jobs, whose tasks must be worth their start
BOOST_ROWS = 100_000
#: and at most, where the fit has the cluster to itself
BOOST_ROWS_MOST = 1_000_000
#: rows for each core that the forests fitted side by side have together at most,
#: unless one has more: beyond, further ones fill no idle cores, and each keeps
#: its rows with their draws in memory (some 540 bytes a row at 100 trees)
FOREST_ROWS = 100_000


def make_learner(spec: ModelSpec, features: str = "_x", label: str = "_y", weight: str | None = "_w"):
    """M-1 / M-5 / M-6 / M-7: the Spark ML estimator for ``spec`` (boosted trees
    with a fit of their own, see :mod:`strata.operators.boost`)."""
    p = dict(spec.params)
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if spec.kind == "gbt":
        args = {**GBT_DEFAULTS, **p}
        return BoostedTrees(seed=spec.seed, **common, **args)
    if spec.kind == "forest":
        args = {"numTrees": 100, "maxDepth": 10, **p}
        return RandomForestClassifier(seed=spec.seed, **common, **args)
    if spec.kind == "logistic":
        args = {"maxIter": 2000, "elasticNetParam": 0.0, **p}
        return LogisticRegression(**common, **args)
    if spec.kind == "linear_svc":
        args = {"maxIter": 100, **p}
        return LinearSVC(**common, **args)
    raise ValueError(f"unknown model kind {spec.kind!r}")


def positive_probability(scored: DataFrame, kind: str) -> DataFrame:
    """M-8: P(class 1); a linear SVC has no probability, so the reference's
    sigmoid of the decision score is used (F-11)."""
    if kind == "linear_svc":
        return scored.withColumn("p", sigmoid(vector_to_array("rawPrediction")[1]))
    return scored.withColumn("p", vector_to_array("probability")[1])


def _class_counts(df: DataFrame, y: str) -> tuple[int, int]:
    row = df.agg(F.sum((q(y) == 0).cast("int")).alias("neg"), F.sum((q(y) == 1).cast("int")).alias("pos")).first()
    return int(row["neg"] or 0), int(row["pos"] or 0)


def _weights(df: DataFrame, y: str, final: bool, counts: tuple[int, int] | None = None) -> DataFrame:
    """``counts`` (negatives, positives) where the caller knows them."""
    neg, pos = counts or _class_counts(df, y)
    if final and (pos == 0 or neg == 0):
        raise ValueError(f"single-class training table (neg={neg}, pos={pos}); class weight undefined")
    ratio = neg / pos if final else neg / max(pos, 1)
    return df.withColumn("_w", F.when(q(y) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


def prepare(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """P-2: assemble features (nulls refused) and the int label."""
    va = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    return va.transform(df.withColumn("_y", q(y).cast("double")))


def dealt_evenly(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` in equal partitions, one for each core (several of at most
    ``BOOST_ROWS_MOST`` rows where there are more rows), for a boosted fit alone
    on the cluster: each of its three jobs a tree lasts as long as its largest
    task, and what joins and scans leave differs in size by a factor of two.  A
    table of at most ``BOOST_ROWS`` rows stays as it is."""
    if n_rows <= BOOST_ROWS:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # no local SparkContext: leave partitioning to the server
        return df
    rounds = max(1, math.ceil(n_rows / (cores * BOOST_ROWS_MOST)))
    return df.repartition(min(cores * rounds, math.ceil(n_rows / BOOST_ROWS)))


def forests_at_once(df: DataFrame, n_rows: int, k: int) -> int:
    """How many of ``k`` forests of ``n_rows`` rows each are fitted side by side."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # no local SparkContext: the cores are not known
        return k
    return max(1, min(k, cores * FOREST_ROWS // max(1, n_rows)))


def fit(df: DataFrame, features: Sequence[str], y: str, spec: ModelSpec, final: bool = True,
        counts: tuple[int, int] | None = None):
    """Fit on ``df`` with class weights (M-2/M-4); ``counts`` (negatives,
    positives) where the caller knows them."""
    if counts is None:
        counts = _class_counts(df, y)
    if spec.kind == "gbt" and final:  # alone on the cluster; the folds of a cross-validation share it
        df = dealt_evenly(df, sum(counts))
    data = _weights(prepare(df, features, y), y, final, counts)
    return make_learner(penalised(spec, data)).fit(data)


def penalised(spec: ModelSpec, data: DataFrame) -> ModelSpec:
    """M-6 / M-7: the L2 penalty of an inverse strength ``C`` (default 1).
    ``C * sum(w * loss) + |b|^2 / 2`` has the minimum of Spark's
    ``sum(w * loss) / sum(w) + regParam * |b|^2 / 2`` for
    ``regParam = 1 / (C * sum(w))``, on the columns as they are.  An explicit
    ``regParam`` stands."""
    if spec.kind not in ("logistic", "linear_svc"):
        return spec
    params = dict(spec.params)
    strength = float(params.pop("C", 1.0))
    if "regParam" not in params:
        total = data.agg(F.sum("_w")).first()[0] or 1.0
        params.update(regParam=1.0 / (strength * float(total)), standardization=params.get("standardization", False))
    return ModelSpec(spec.kind, params, spec.seed)


def score_stages(df: DataFrame, features: Sequence[str], stages: Sequence[tuple]) -> DataFrame:
    """C-6: the probabilities of several models on each row, side by side:
    ``stages`` lists (model, kind, output column).  Narrow, so no join and no
    shuffle, and a stream is scored like a table."""
    out = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error").transform(df)
    for model, kind, name in stages:
        out = positive_probability(model.transform(out), kind).withColumnRenamed("p", name).drop(
            "rawPrediction", "probability", "prediction")
    return out.drop("_x")


def score(model, df: DataFrame, features: Sequence[str], kind: str, id_col: str, y: str,
          threshold: float = 0.5) -> DataFrame:
    """M-8: (id, y, p, pred) for every row of ``df``."""
    va = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")
    out = positive_probability(model.transform(va.transform(df)), kind)
    return out.select(q(id_col), q(y).cast("int").alias("y"), "p",
                      (F.col("p") >= F.lit(float(threshold))).cast("int").alias("pred"))


def cross_validate(df: DataFrame, features: Sequence[str], y: str, id_col: str, spec: ModelSpec,
                   k: int = 5, seed: int = 42, threshold: float = 0.5) -> tuple[DataFrame, list]:
    """M-3: stratified k-fold CV.  Returns the pooled out-of-fold
    predictions (id, fold, y, p, pred) and the k fitted models.

    The fits do not depend on each other and are submitted together, so that
    the small jobs of one fill the gaps of another (a boosted fit is a chain of
    three jobs a tree).  Forests of large tables fill the cores alone and go a
    few or one at a time, see ``forests_at_once``."""
    # k fits read the same folded table: materialise it once (reliable
    # checkpoint in the shared checkpoint folder) instead of re-deriving it
    folded = cut_lineage(stratified_folds(df, y, id_col, k, seed))
    # one scan for the class counts of all folds
    per_fold = {r["fold"]: (int(r["neg"] or 0), int(r["pos"] or 0), r["n"]) for r in folded.groupBy("fold").agg(
        F.sum((q(y) == 0).cast("int")).alias("neg"), F.sum((q(y) == 1).cast("int")).alias("pos"),
        F.count(F.lit(1)).alias("n")).collect()}
    rows, at_once, n_rows = folded, k, sum(c[2] for c in per_fold.values())
    if spec.kind == "gbt":
        rows = folded.coalesce(max(1, math.ceil(n_rows / BOOST_ROWS)))
    elif spec.kind == "forest":
        at_once = forests_at_once(folded, n_rows * (k - 1) // k, k)

    def run(i: int):
        rest = [c for f, c in per_fold.items() if f != i]
        return fit(rows.where(F.col("fold") != i), features, y, ModelSpec(spec.kind, spec.params, spec.seed + i),
                   final=False, counts=(sum(c[0] for c in rest), sum(c[1] for c in rest)))

    pool = ThreadPool(at_once)
    try:
        models = pool.map(inheritable_thread_target(df.sparkSession)(run), range(1, k + 1), chunksize=1)
    finally:
        pool.close()
    parts = [score(m, folded.where(F.col("fold") == i), features, spec.kind, id_col, y, threshold).withColumn("fold", F.lit(i))
             for i, m in enumerate(models, start=1)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return oof.select(q(id_col), "fold", "y", "p", "pred"), models


def fold_importances(models: Sequence, features: Sequence[str]) -> list[tuple[int, str, float]]:
    """Per-fold feature importances (trees: impurity importance; linear:
    absolute coefficient)."""
    rows = []
    for i, m in enumerate(models, start=1):
        if hasattr(m, "featureImportances"):
            vals = m.featureImportances.toArray()
        else:
            vals = [abs(v) for v in m.coefficients.toArray()]
        rows += [(i, f, float(v)) for f, v in zip(features, vals)]
    return rows


def importance_ci(imp: DataFrame, k: int) -> DataFrame:
    """A-17: mean, population std and t-based 95 % half width over folds,
    per feature: ``t(.975, k-1) * std / sqrt(k)`` (0 when k = 1)."""
    tq = t975(k - 1) if k > 1 else 0.0
    g = imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance"),
                                   F.stddev_pop("importance").alias("std_importance"),
                                   F.count(F.lit(1)).alias("n_folds"))
    hw = F.lit(tq) * F.col("std_importance") / F.lit(math.sqrt(k))
    return g.select("feature", "mean_importance", "std_importance", hw.alias("half_width"),
                    (F.col("mean_importance") - hw).alias("ci_low"), (F.col("mean_importance") + hw).alias("ci_high"))


def save_model(model, path: str) -> str:
    """S-7: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)
    return path


def model_dir(spark, name: str) -> str:
    """A fresh folder for a model artefact under the session's checkpoint
    folder (shared on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), "models", f"{name}-{uuid.uuid4().hex[:8]}")


def load_model(kind: str, path: str):
    """S-7: load a saved classification model."""
    from pyspark.ml.classification import (GBTClassificationModel, LinearSVCModel,
                                           LogisticRegressionModel, RandomForestClassificationModel)
    cls = {"gbt": GBTClassificationModel, "forest": RandomForestClassificationModel,
           "logistic": LogisticRegressionModel, "linear_svc": LinearSVCModel}[kind]
    return cls.load(path)
