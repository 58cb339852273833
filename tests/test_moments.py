"""Co-moments, Gram matrices and Bayesian ridge regressions against plain numpy
versions; draws from the predictive distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import impute as IM
from strata.operators import moments as MO
from strata.operators import profile as PR


def _table(spark, n=900):
    rng = np.random.default_rng(8)
    a = rng.normal(size=n)
    x = np.stack([a, 1e6 + 2 * a + rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.full(n, 0.1), rng.normal(size=n)], axis=1)
    gone = rng.random(x.shape) < [0.1, 0.3, 0.0, 0.2, 0.99]
    rows = [(i, *[None if g else float(v) for v, g in zip(r, m)]) for i, (r, m) in enumerate(zip(x, gone))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, k double, e double").repartition(5), np.where(gone, np.nan, x)


COLS = ["a", "b", "c", "k", "e"]


def test_pair_moments(spark):
    df, x = _table(spark)
    got = MO.pair_moments(df, COLS)
    r = got.pearson()
    for i in range(5):
        for j in range(5):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            assert got.n[i, j] == both.sum()
            np.testing.assert_allclose([got.mean[i, j], got.dev[i, j]], [u.mean(), ((u - u.mean()) ** 2).sum()], rtol=1e-9, atol=1e-12)
            if 3 in (i, j):
                assert np.isnan(r[i, j])               # a constant column
            else:
                assert r[i, j] == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)
    assert np.isnan(MO.pair_moments(df.limit(0), COLS).pearson()).all()
    matrix = {(m.Feature_1, m.Feature_2): m.Correlation for m in PR.corr_matrix(df.select(*COLS)).collect()}
    assert matrix["a", "k"] is None and matrix["a", "a"] == 1.0 and len(matrix) == 25


def plain_bayes(x, y):
    """Evidence maximisation by full inverses."""
    n, xm, ym = len(y), x.mean(0), y.mean()
    x, y = x - xm, y - ym
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None
    for _ in range(300):
        inv = np.linalg.inv(lam * np.eye(x.shape[1]) + alpha * x.T @ x)
        w = alpha * inv @ x.T @ y
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
        gamma = x.shape[1] - lam * np.trace(inv)
        lam = (gamma + 2e-6) / (w @ w + 2e-6)
        alpha = (n - gamma + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
    inv = np.linalg.inv(lam * np.eye(x.shape[1]) + alpha * x.T @ x)
    return ym - xm @ w, alpha * inv @ x.T @ y, 1 / alpha, inv


def test_gram_and_bayesian_ridge(spark):
    df, x = _table(spark)
    full = IM.median_fill(df.select("id", *[F.col(c) for c in "abc"], *[F.col(c).isNotNull().alias(f"_o_{c}") for c in "abc"]), ["a", "b", "c"])
    g, h = MO.grams(full, [("a", ["b", "c"]), ("b", ["c"])])
    seen = ~np.isnan(x[:, 0])
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = np.column_stack([np.ones(seen.sum()), filled[seen][:, [1, 2, 0]]])
    np.testing.assert_allclose(g, z.T @ z, rtol=1e-12)
    assert h.shape == (3, 3)
    rng = np.random.default_rng(1)
    for n in (30, 400):
        u = rng.normal(size=(n, 4)) * [1, 3, 0.1, 2] + 5
        y = u @ [1.0, -2, 0.5, 0] + rng.normal(size=n)
        z = np.column_stack([np.ones(n), u, y])
        fit, want = MO.bayesian_ridge(z.T @ z), plain_bayes(u, y)
        np.testing.assert_allclose(fit.start, want[0], rtol=1e-5)
        np.testing.assert_allclose(fit.slope, want[1], rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose(fit.noise, want[2], rtol=1e-5)
        np.testing.assert_allclose(fit.cov, want[3], rtol=1e-4, atol=1e-9)


def test_draws_follow_the_predictive_distribution():
    u = IM._uniform(np.arange(20000, dtype=np.int64) * 7919, 3)
    assert abs(u.mean() - 0.5) < 0.01 and len(set(u)) == 20000
    free = IM._drawn(np.full(20000, 2.0), np.full(20000, 3.0), u, None, None)
    assert abs(free.mean() - 2) < 0.1 and abs(free.std() - 3) < 0.1
    held = IM._drawn(np.full(20000, 2.0), np.full(20000, 3.0), u, 0.0, 4.0)
    assert held.min() >= 0 and held.max() <= 4 and abs(held.mean() - 2) < 0.05 and held.std() > 1


@pytest.mark.parametrize("start", ["median", "mean", "most_frequent", "constant"])
def test_initial_strategies_and_orders(spark, start):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 4.0), (3, 7.0, 4.0), (4, None, 6.0), (5, 8.0, 6.0)], "id long, a double, b double")
    got = {r.id: r for r in IM.initial_fill(df, ["a", "b"], start).collect()}
    assert (got[4].a, got[1].b) == {"median": (4.0, 5.0), "mean": (4.25, 5.0), "most_frequent": (1.0, 4.0), "constant": (0.0, 0.0)}[start]
    counts = {"a": 3, "b": 1, "c": 2}
    order = {o: IM.imputation_order("abc", counts, o) for o in ("ascending", "descending", "roman", "arabic")}
    assert ["".join(v) for v in order.values()] == ["bca", "acb", "abc", "cba"]
    assert sorted(IM.imputation_order("abc", counts, "random", 5)) == list("abc")
    for bad in (lambda: IM.initial_fill(df, ["a"], "x"), lambda: IM.imputation_order("a", counts, "x"),
                lambda: IM.mice_impute(df, "id", ["a", "b"], estimator="x")):
        with pytest.raises(ValueError, match="Unknown"):
            bad()


def test_chained_regressions_recover_linear_columns(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=600), rng.normal(size=600)
    c = 3 * a - b + 1
    rows = [(i, float(a[i]), float(b[i]) if i % 7 else None, float(c[i]) if i % 5 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4)
    for estimator in ("bayesian_ridge", "ridge"):
        out = {r.id: r for r in IM.mice_impute(df, "id", ["a", "b", "c"], max_iter=30, tol=1e-9, estimator=estimator).collect()}
        one = [i for i in range(600) if (i % 7 == 0) != (i % 5 == 0)]      # rows with both gone cannot be told
        assert max(abs(out[i].c - c[i]) + abs(out[i].b - b[i]) for i in one) < 0.05
    drawn = {r.id: r.c for r in IM.mice_impute(df, "id", ["a", "b", "c"], max_iter=2, sample_posterior=True, seed=1).collect()}
    other = {r.id: r.c for r in IM.mice_impute(df.repartition(2), "id", ["a", "b", "c"], max_iter=2, sample_posterior=True, seed=1).collect()}
    assert drawn == pytest.approx(other, rel=1e-9) and any(abs(drawn[i] - c[i]) > 1e-6 for i in range(0, 600, 5))
