"""Explanations (X-1..X-5, J-7, F-15, U-2, O-2).

Tree SHAP (X-1), exact and on every row.  A saved Spark tree-ensemble
model stores its nodes as a Parquet table (treeID, nodeData{id,
prediction, rawCount, leftChild, rightChild, split{featureIndex,
leftCategoriesOrThreshold, numCategories}}), read here with
``spark.read.parquet`` like any other table.  From it we build one record
per leaf: the features S on the root-to-leaf path, each with its merged
interval (lo, hi] and the product r_j of child/parent cover ratios of its
splits.  With a_j = 1 when x_j lies in the interval, the path-dependent
expectation of a tree given the features in T is
    v(T) = sum_leaves value * prod_{j in S} (a_j if j in T else r_j),
a sum of games that each involve only the leaf's own features, so the
Shapley value splits per leaf:
    phi_i += w * value * (a_i - r_i) * sum_{T in S\\{i}} |T|!(|S|-|T|-1)!/|S|!
             * prod_{j in T} a_j * prod_{j in S\\T\\{i}} r_j
          =  w * value * (a_i - r_i) * int_0^1 prod_{j in S\\{i}} (u a_j + (1 - u) r_j) du,
since int_0^1 u^t (1 - u)^(s - t - 1) du = t! (s - t - 1)! / s!.  The
integrand is a polynomial of degree |S| - 1 in u, so ceil(|S| / 2)
Gauss-Legendre nodes give the integral exactly: the work is quadratic in the
depth and trees of any depth are explained.  The leaves (no larger than the
model, which Spark keeps whole on the driver and in every task that scores)
are broadcast as arrays and evaluated with numpy, block by block, per Arrow
batch in ``mapInPandas``; rows are never moved to the driver.
``base + sum(phi) = margin`` holds up to rounding.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.clean import q
from strata.session import spread

ROW_BLOCK = 256   # rows and leaves evaluated together
LEAF_BLOCK = 512


def leaf_table(spark, model_path: str, tree_weights: Sequence[float], class_prob: bool = False) -> list[dict]:
    """Leaves of a saved tree ensemble: weight*value, features with merged
    intervals and cover ratios.  ``class_prob`` uses the leaf's class-1
    frequency (forest classifiers average these) instead of its prediction."""
    nodes = spark.read.parquet(os.path.join(model_path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.rawCount",
        "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()  # model nodes: bounded by trees x 2^depth
    trees: dict[int, dict[int, dict]] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict()
    leaves = []
    for tid, tnodes in trees.items():
        w = float(tree_weights[tid])
        root = min(tnodes)  # node ids are pre-order, root first

        def walk(nid, path):
            n = tnodes[nid]
            if n["leftChild"] < 0:
                feats: dict[int, list] = {}
                for f, lo, hi, ratio in path:
                    cur = feats.setdefault(f, [-math.inf, math.inf, 1.0])
                    cur[0], cur[1], cur[2] = max(cur[0], lo), min(cur[1], hi), cur[2] * ratio
                if class_prob:
                    st = n["impurityStats"]
                    leaf_val = float(st[1]) / float(sum(st)) if st and sum(st) > 0 else 0.0
                else:
                    leaf_val = float(n["prediction"])
                leaves.append({"value": w * leaf_val,
                               "feats": [(f, v[0], v[1], v[2]) for f, v in sorted(feats.items())]})
                return
            if n["numCategories"] not in (-1, None):
                raise ValueError("categorical splits are not supported by tree SHAP here")
            thr = float(n["leftCategoriesOrThreshold"][0])
            f = int(n["featureIndex"])
            parent = float(n["rawCount"]) or 1.0
            left, right = tnodes[n["leftChild"]], tnodes[n["rightChild"]]
            walk(n["leftChild"], path + [(f, -math.inf, thr, float(left["rawCount"]) / parent)])
            walk(n["rightChild"], path + [(f, thr, math.inf, float(right["rawCount"]) / parent)])

        walk(root, [])
    return leaves


def pack_leaves(leaves: list[dict]) -> tuple[list[tuple], float]:
    """Leaves with as many path features as arrays (value, feature, lo, hi,
    ratio), at most ``LEAF_BLOCK`` in a block, and the base value."""
    sized: dict[int, list] = {}
    for leaf in leaves:
        sized.setdefault(len(leaf["feats"]), []).append(leaf)
    base = sum(v["value"] for v in sized.pop(0, []))
    blocks = []
    for same in sized.values():
        for k in range(0, len(same), LEAF_BLOCK):
            part = same[k:k + LEAF_BLOCK]
            value = np.array([v["value"] for v in part])
            f, lo, hi, r = (np.array([[x[i] for x in v["feats"]] for v in part]) for i in range(4))
            base += float(value @ r.prod(axis=1))
            blocks.append((value, f.astype(np.int64), lo, hi, r))
    return blocks, float(base)


def _block_shap(x: np.ndarray, block: tuple, phi: np.ndarray) -> None:
    """Add the Shapley values of a block of leaves with ``s`` features each."""
    value, f, lo, hi, r = block
    s = f.shape[1]
    a = [((x[:, f[:, j]] > lo[:, j]) & (x[:, f[:, j]] <= hi[:, j])).astype(float) for j in range(s)]
    nodes, weights = np.polynomial.legendre.leggauss((s + 1) // 2)
    acc = [np.zeros_like(a[0]) for _ in range(s)]
    for u, w in zip((nodes + 1) / 2, weights / 2):
        factor = [u * a[j] + (1 - u) * r[:, j] for j in range(s)]
        after = [np.full_like(a[0], w)]  # products of the factors behind j
        for j in range(s - 1, 0, -1):
            after.append(after[-1] * factor[j])
        before = np.ones_like(a[0])
        for j in range(s):
            acc[j] += before * after[s - 1 - j]
            before = before * factor[j]
    for j in range(s):
        to = np.zeros((len(value), phi.shape[1]))
        to[np.arange(len(value)), f[:, j]] = value
        phi += (acc[j] * (a[j] - r[:, j])) @ to


def packed_shap(x: np.ndarray, blocks: list[tuple], n_features: int) -> np.ndarray:
    """phi (rows x features) of packed leaves."""
    phi = np.zeros((x.shape[0], n_features))
    for k in range(0, x.shape[0], ROW_BLOCK):
        for block in blocks:
            _block_shap(x[k:k + ROW_BLOCK], block, phi[k:k + ROW_BLOCK])
    return phi


def shap_values(x: np.ndarray, leaves: list[dict], n_features: int) -> tuple[np.ndarray, float]:
    """phi (rows x features) and the base value for a batch of rows."""
    blocks, base = pack_leaves(leaves)
    return packed_shap(x, blocks, n_features), base


def tree_shap(df: DataFrame, model, model_path: str, features: Sequence[str], id_col: str,
              log_odds: bool = True) -> DataFrame:
    """X-1 + X-3: long table (id, feature, value, phi) for every row and
    feature, plus ``base`` per row (same for all rows).  ``log_odds``
    doubles the Spark GBT margin (its probability is sigmoid(2F)).  A
    random-forest classifier is explained in probability units (mean of
    the trees' class-1 leaf frequencies)."""
    spark = df.sparkSession
    name = type(model).__name__
    forest = name == "RandomForestClassificationModel"
    if forest:
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
    else:
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0] * model.getNumTrees
    scale = 2.0 if log_odds and name == "GBTClassificationModel" else 1.0
    blocks, base = pack_leaves(leaf_table(spark, model_path, weights, class_prob=forest))
    try:  # leaves x path features: bounded by the model size
        bc = spark.sparkContext.broadcast(blocks)
    except Exception:  # no local SparkContext: ship the small table with the function
        bc = None
    feats = list(features)
    n_f = len(feats)

    def run(batches):
        packed = bc.value if bc is not None else blocks
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            phi = packed_shap(x, packed, n_f)
            ids = np.repeat(pdf[id_col].astype(str).to_numpy(), n_f)
            yield pd.DataFrame({
                "id": ids, "feature": np.tile(np.array(feats, dtype=object), len(pdf)),
                "value": x.reshape(-1), "phi": (phi * scale).reshape(-1),
                "base": np.full(len(ids), base * scale)})

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("phi", T.DoubleType()),
                           T.StructField("base", T.DoubleType())])
    rows = df.select(q(id_col).cast("string").alias(id_col), *[q(c).cast("double").alias(c) for c in feats])
    return spread(rows, id_col).mapInPandas(run, schema)


def mean_abs(long: DataFrame) -> DataFrame:
    """X-2: mean |phi| per feature (sort only for display)."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))


def linear_shap(df: DataFrame, weights: Sequence[float], features: Sequence[str], id_col: str) -> DataFrame:
    """X-5: exact SHAP of a linear score, w_j * (x_j - mean_j), as a
    projection (means from one aggregation)."""
    feats = list(features)
    means = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(feats)]).first()
    structs = [F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias("value"),
                        (F.lit(float(w)) * (q(c).cast("double") - F.lit(float(means[f"m{i}"])))).alias("phi"))
               for i, (c, w) in enumerate(zip(feats, weights))]
    return df.select(q(id_col).cast("string").alias("id"), F.explode(F.array(*structs)).alias("r")) \
        .select("id", "r.*")


def _parent(parents: Sequence[str]) -> Column:
    """The parent of the column named in ``feature``, null without one: it is
    ``<parent>_``, ``<parent>=`` or ``<parent>__`` and more (case-insensitive);
    of several that fit (``segment`` and ``segment_x``) the longest counts."""
    parent, name = F.lit(None).cast("string"), F.lower("feature")
    for p in sorted(parents, key=len):
        fits = name.startswith(f"{p.lower()}_") | name.startswith(f"{p.lower()}=")
        parent = F.when(fits, F.lit(p)).otherwise(parent)
    return parent


def parent_columns(features: DataFrame, parents: Sequence[str]) -> DataFrame:
    """S-9: (parent, column), a row for each one-hot column of ``feature``."""
    return features.select(_parent(parents).alias("parent"), F.col("feature").alias("column")) \
        .where(F.col("parent").isNotNull()).distinct()


def group_parents(ranking: DataFrame, parents: Sequence[str], value_col: str = "mean_abs_shap") -> DataFrame:
    """X-4 / F-15 / U-2: sum the scores of one-hot columns into their parent
    (S-9); other features keep their own score."""
    return (ranking.withColumn("_parent", F.coalesce(_parent(parents), F.col("feature")))
            .groupBy(F.col("_parent").alias("feature")).agg(F.sum(value_col).alias(value_col)))


def background_sample(df: DataFrame, id_col: str, n: int = 200, seed: int = 42) -> DataFrame:
    """O-2: a deterministic sample of at most n rows (md5 order), the
    background set a sampling explainer uses; the limit is the feature."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), q(id_col).cast("string"))), q(id_col)).limit(n)
