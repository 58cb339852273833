"""Numbering without caps, sparse one-hot columns, two models on one row, the
penalties of the linear models and the centred decision surface."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.config import DataCfg, JobCfg, TrainCfg
from strata.functions import prefix
from strata.operators import embed as EM
from strata.operators import encode as EN
from strata.operators import train as TR
from strata.plans import jobs


def test_numbers_by_ranges_and_by_hash(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 64)      # many buckets
    rng = random.Random(2)
    rows = [(k, v) for k in ("a", "b", None) for v in rng.sample([f"w{i:04d}" for i in range(3000)], 700)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(4)
    want = {(k, v): i + 1 for g in ("a", "b", None) for i, (k, v) in enumerate(sorted(r for r in rows if r[0] == g))}
    got = {(r.k, r.v): r.rn for r in prefix.sorted_numbers(df, ["k"], "v").collect()}
    assert got == want
    h = df.filter("k is not null").withColumn("h", F.md5("v"))
    ranked = {(r.k, r.v): r.rn for r in prefix.global_row_number(h, ["k"], "h", "v").collect()}
    import hashlib
    for g in ("a", "b"):
        order = sorted((v for k, v in rows if k == g), key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v))
        assert [ranked[g, v] for v in order] == list(range(1, 701))
    sums = spark.createDataFrame([(k, float(i), 1) for k in "xy" for i in range(500)], "k string, p double, n int")
    out = prefix.running_sums(sums, "p", ["n"], keys=["k"], descending=False).collect()
    assert all(r.cum_n == r.p + 1 and r.tot_n == 500 for r in out) and len(out) == 1000


def test_sparse_one_hot_of_any_number_of_levels(spark, monkeypatch):
    monkeypatch.setattr(EN, "WIDEST", 50)
    rows = [(i, f"v{i % 90:02d}" if i % 7 else None, "x" if i % 2 else "y", None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    with pytest.raises(ValueError, match="one_hot_vector"):
        EN.one_hot(df, ["a"])
    out, names = EN.one_hot_vector(df, ["a", "b", "c"])
    place = {r["index"]: (r["column"], r["value"]) for r in names.collect()}
    assert len(place) == len({a for _, a, _, _ in rows if a}) + 2
    got = {r.id: {place[i] for i, x in enumerate(r.v) if x} for r in out.select("id", vector_to_array("one_hot").alias("v")).collect()}
    assert got == {i: {(c, v) for c, v in zip("abc", r) if v is not None} for i, *r in rows}
    share = {(r.parent, r.value): r.share for r in EN.level_frequencies(df, ["a", "b"]).collect()}
    assert share["b", "x"] == 0.5


def _training(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [1.0, 50.0]
    y = (x[:, 0] + x[:, 1] / 50 + rng.normal(size=400) > 0.3).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                                 "id long, a double, b double, y int").repartition(3), x, y


def test_logistic_penalty_is_that_of_an_inverse_strength(spark):
    """The gradient of C * sum(w * loss) + |b|^2 / 2 vanishes at the fit."""
    df, x, y = _training(spark)
    for strength in (1.0, 0.01):
        m = TR.fit(df, ["a", "b"], "y", TR.ModelSpec("logistic", {"C": strength, "tol": 1e-12}), final=True)
        b = m.coefficients.toArray()
        w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
        p = 1 / (1 + np.exp(-(x @ b + m.intercept)))
        np.testing.assert_allclose(strength * x.T @ (w * (p - y)) + b, 0, atol=1e-2 * strength * 400)
        assert abs((w * (p - y)).sum()) < 1e-2
    assert TR.penalised(TR.ModelSpec("gbt"), df).params == {}


def test_decision_grid_is_centred_and_reaches_one_beyond(spark):
    df, x, y = _training(spark)
    means, axes = EM.centred_pca(df, ["a", "b"])
    np.testing.assert_allclose(means, x.mean(0), rtol=1e-9)
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    v = v * np.sign(v[np.arange(2), np.abs(v).argmax(1)])[:, None]
    np.testing.assert_allclose(axes, v, atol=1e-9)
    grid = EM.decision_grid(df, ["a", "b"], "id", "y", n=5).toPandas()
    z = (x - x.mean(0)) @ v.T
    np.testing.assert_allclose([grid.gx.min(), grid.gx.max(), grid.gy.min(), grid.gy.max()],
                               [z[:, 0].min() - 1, z[:, 0].max() + 1, z[:, 1].min() - 1, z[:, 1].max() + 1], rtol=1e-9)
    assert len(grid) == 25 and grid.p.between(0, 1).all()


def test_cascade_scores_each_row_once_by_both_models(spark, tmp_path):
    df, _, _ = _training(spark)
    twice = df.union(df.limit(5))               # repeated ids stay single rows
    cfg = JobCfg(output_dir=str(tmp_path), data=DataCfg(id_col="id", target_col="y"), training=TrainCfg(kind="logistic"))
    paths = []
    for k, f in enumerate((["a", "b"], ["a", "b"])):
        m = TR.fit(df if k == 0 else df.filter("id % 2 = 0"), f, "y", TR.ModelSpec("logistic"), final=True)
        paths.append(TR.save_model(m, f"{tmp_path}/m{k}"))
    reports = jobs.cascade(spark, cfg, twice, *paths)
    batch = sorted(map(tuple, spark.read.parquet(reports["Predictions"]).collect()))
    assert len(batch) == 405
    twice.write.parquet(f"{tmp_path}/in")
    out = jobs.cascade_stream(spark, cfg, f"{tmp_path}/in", "id long, a double, b double, y int", *paths)
    assert sorted(map(tuple, spark.read.parquet(out).select(*spark.read.parquet(reports["Predictions"]).columns).collect())) == batch
    plan = TR.score_stages(twice, ["a", "b"], jobs._stages("logistic", *paths))._jdf.queryExecution().toString()
    assert "Join" not in plan
