"""A boosted fit alone on the cluster runs on equal partitions."""

import pytest
from pyspark.sql import functions as F

from strata.operators import train as TR


def _uneven(spark, n):
    rows = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    return rows.where(F.col("x") < n // 10).coalesce(1).unionAll(rows.where(F.col("x") >= n // 10).coalesce(1))


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_boosted_fit_gets_equal_partitions(spark, monkeypatch):
    monkeypatch.setattr(TR, "BOOST_ROWS", 100)
    seen = []

    class Learner:
        def fit(self, data):
            seen.append(data)

    monkeypatch.setattr(TR, "make_learner", lambda spec: Learner())
    TR.fit(_uneven(spark, 1000), ["x"], "y", TR.ModelSpec("gbt"))
    sizes = _sizes(seen[0])
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes) == 1000 and len(sizes) == min(cores, 10)
    assert max(sizes) <= 1.2 * min(sizes)
    # every row once, with the weight of its class
    weights = {r["y"]: (r["n"], r["w"]) for r in seen[0].groupBy("y").agg(F.count("*").alias("n"), F.max("_w").alias("w")).collect()}
    assert weights == {1: (334, pytest.approx(666 / 334)), 0: (666, 1.0)}


def test_partitions_of_large_and_small_tables(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(TR, "BOOST_ROWS", 10)
    monkeypatch.setattr(TR, "BOOST_ROWS_MOST", 20)
    df = _uneven(spark, 40 * cores)
    assert TR.dealt_evenly(df, 40 * cores).rdd.getNumPartitions() == 2 * cores
    assert TR.dealt_evenly(df, 10) is df
