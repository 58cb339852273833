"""Probability calibration (M-9) and the threshold artefact (S-8).

Both calibrators are Spark ML fits on out-of-fold scores:

* Platt (sigmoid): a one-feature ``LogisticRegression`` on the score's
  logit, unregularised.
* Isotonic: ``IsotonicRegression`` (pool-adjacent-violators, distributed
  by Spark), increasing.

The calibrated model is the pair (base model, calibrator); the chosen
threshold (E-14) is saved beside it as a one-row JSON dataset.
"""

from __future__ import annotations

import os

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 1e-12


def _logit(p):
    pc = F.least(F.greatest(F.col(p), F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(pc / (F.lit(1.0) - pc))


def fit_platt(df: DataFrame, y: str = "y", p: str = "p"):
    data = VectorAssembler(inputCols=["_z"], outputCol="_zf").transform(df.withColumn("_z", _logit(p)))
    lr = LogisticRegression(featuresCol="_zf", labelCol="_yl", regParam=0.0, maxIter=100)
    return lr.fit(data.withColumn("_yl", F.col(y).cast("double")))


def apply_platt(model, df: DataFrame, p: str = "p", out: str = "p_cal") -> DataFrame:
    data = VectorAssembler(inputCols=["_z"], outputCol="_zf").transform(df.withColumn("_z", _logit(p)))
    m = model.copy().setFeaturesCol("_zf").setProbabilityCol("_prob").setRawPredictionCol("_raw") \
        .setPredictionCol("_pred")
    return m.transform(data).withColumn(out, vector_to_array("_prob")[1]).drop("_z", "_zf", "_prob", "_raw", "_pred")


def fit_isotonic(df: DataFrame, y: str = "y", p: str = "p"):
    return IsotonicRegression(featuresCol=p, labelCol="_yl", predictionCol="_iso", isotonic=True) \
        .fit(df.withColumn("_yl", F.col(y).cast("double")))


def apply_isotonic(model, df: DataFrame, out: str = "p_cal") -> DataFrame:
    return model.transform(df).withColumnRenamed("_iso", out)


def calibrate(df: DataFrame, method: str = "sigmoid", y: str = "y", p: str = "p") -> DataFrame:
    """M-9: fit on (y, p) and return df with ``p_cal``."""
    if method == "sigmoid":
        return apply_platt(fit_platt(df, y, p), df, p)
    if method == "isotonic":
        return apply_isotonic(fit_isotonic(df, y, p), df)
    raise ValueError(f"unknown calibration method {method!r}")


def fit_calibrator(df: DataFrame, method: str, y: str = "y", p: str = "p"):
    if method == "sigmoid":
        return fit_platt(df, y, p)
    if method == "isotonic":
        return fit_isotonic(df, y, p)
    raise ValueError(f"unknown calibration method {method!r}")


def calibrated_path(model_path: str) -> str:
    """S-8: the calibrator lives beside the model as ``<model>_calibrated``."""
    return model_path.rstrip("/") + "_calibrated"


def save_calibrator(model, model_path: str) -> str:
    path = calibrated_path(model_path)
    model.write().overwrite().save(path)
    return path


def load_calibrator(model_path: str, method: str):
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.regression import IsotonicRegressionModel
    cls = {"sigmoid": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}[method]
    path = calibrated_path(model_path)
    if not os.path.isdir(path) and "://" not in path:
        raise FileNotFoundError(f"calibrated model not found: {path}")
    return cls.load(path)


def apply_calibrator(model, df: DataFrame, method: str, p: str = "p", out: str = "p_cal") -> DataFrame:
    if method == "sigmoid":
        return apply_platt(model, df, p, out)
    return apply_isotonic(model.copy().setFeaturesCol(p).setPredictionCol("_iso"), df, out)


def save_threshold(spark, model_path: str, threshold: float, metric: str) -> str:
    """S-8: the chosen threshold beside the model (one-row JSON)."""
    path = os.path.join(model_path, "best_threshold")
    spark.createDataFrame([(float(threshold), metric)], "threshold double, metric string") \
        .coalesce(1).write.mode("overwrite").json(path)
    return path


def load_threshold(spark, model_path: str) -> float:
    path = os.path.join(model_path, "best_threshold")
    rows = spark.read.schema("threshold double, metric string").json(path).collect()
    if not rows:
        raise FileNotFoundError(f"threshold artefact not found: {path}")
    return float(rows[0]["threshold"])
