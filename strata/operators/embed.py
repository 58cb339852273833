"""Low-dimensional views (M-10, M-11).

* ``separability_pca`` (M-11): standardise (population std, as the
  reference's scaler) and project on the first two principal components
  with Spark ML ``PCA`` (the covariance is a distributed aggregate; the
  eigen-decomposition of a d x d matrix runs on the driver).
* ``decision_grid`` (M-10): refit a model (logistic, linear SVC or boosted
  trees) on the first two components of the centred data and score a regular
  grid around it (grid rows are generated by ``spark.range``, partitioned like
  any table).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.clean import q


def _pca2(df: DataFrame, vec: str) -> DataFrame:
    scaler = StandardScaler(inputCol=vec, outputCol="_std", withMean=True, withStd=True).fit(df)
    # Spark's scaler divides by the sample std; rescale to the population std
    n = df.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    std = scaler.transform(df).withColumn("_std", array_to_vector(
        F.transform(vector_to_array("_std"), lambda v: v * F.lit(factor))))
    pca = PCA(k=2, inputCol="_std", outputCol="_pc").fit(std)
    out = pca.transform(std).withColumn("_pca", vector_to_array("_pc"))
    return out.withColumn("pc1", F.col("_pca")[0]).withColumn("pc2", F.col("_pca")[1]) \
        .drop("_std", "_pc", "_pca")


def separability_pca(df: DataFrame, features: Sequence[str] | str, id_col: str, label: str) -> DataFrame:
    """M-11: (id, label, pc1, pc2)."""
    if isinstance(features, str):  # an array<float> column
        data = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    else:
        data = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="error").transform(df)
    return _pca2(data, "_v").select(q(id_col), q(label), "pc1", "pc2")


def centred_pca(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[list[float]]]:
    """The means of the columns and their first two principal axes, columns
    centred but not scaled; the largest loading of an axis is positive."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="error").transform(df)
    axes = PCA(k=2, inputCol="_v", outputCol="_pc").fit(data).pc.toArray()      # columns x 2
    means = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    out = []
    for k in range(2):
        a = axes[:, k].tolist()
        sign = 1.0 if max(a, key=abs) >= 0 else -1.0
        out.append([sign * x for x in a])
    return [float(x) for x in means], out


def decision_grid(df: DataFrame, features: Sequence[str], id_col: str, y: str, n: int = 300,
                  kind: str = "logistic", params: dict | None = None, margin: float = 1.0) -> DataFrame:
    """M-10: a model of ``kind`` (logistic | linear_svc | gbt) with the
    parameters of the model it stands for, refit with class weights on the
    centred data's first two principal components, and scored on an n x n grid
    that reaches ``margin`` beyond the projected data (gx, gy, p).  Without
    ``params`` the library defaults of the kind hold."""
    from strata.operators import train as TR

    means, axes = centred_pca(df, features)
    along = lambda axis: reduce(lambda s, t: s + t, [
        (q(c).cast("double") - F.lit(m)) * F.lit(a) for c, m, a in zip(features, means, axis)])
    proj = df.select(q(id_col), q(y), along(axes[0]).alias("pc1"), along(axes[1]).alias("pc2"))
    b = proj.agg(F.min("pc1"), F.max("pc1"), F.min("pc2"), F.max("pc2")).first()
    spec = TR.ModelSpec(kind, params or {})
    model = TR.fit(proj, ["pc1", "pc2"], y, spec, final=True)
    spark = df.sparkSession
    x0, x1, y0, y1 = float(b[0]) - margin, float(b[1]) + margin, float(b[2]) - margin, float(b[3]) + margin
    grid = spark.range(n * n).select(
        (F.lit(x0) + (F.col("id") % n) * F.lit((x1 - x0) / max(n - 1, 1))).alias("pc1"),
        (F.lit(y0) + F.floor(F.col("id") / n) * F.lit((y1 - y0) / max(n - 1, 1))).alias("pc2"))
    va = VectorAssembler(inputCols=["pc1", "pc2"], outputCol="_x")
    scored = TR.positive_probability(model.transform(va.transform(grid)), kind)
    return scored.select(F.col("pc1").alias("gx"), F.col("pc2").alias("gy"), "p")
