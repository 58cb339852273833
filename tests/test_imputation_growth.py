"""Forest imputation frees its shuffles; Gram sums leave missing rows out."""

import numpy as np

from strata.operators import impute as IM
from strata.operators import moments as MO

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _rows(spark, n=400):
    return spark.range(n).selectExpr("id", "double(id % 17) AS a", "CASE WHEN id % 9 > 0 THEN double(id % 17 + id % 5) END AS b")


def test_forest_rounds_free_their_shuffles(spark, monkeypatch):
    real, seen = IM.grow_forests, []
    monkeypatch.setattr(IM, "grow_forests", lambda *a, **b: (seen.append(spark.conf.get(KEY, None)), real(*a, **b))[1])
    before = spark.conf.get(KEY, None)
    out = IM.forest_impute(_rows(spark), "id", ["a", "b"], max_iter=2, num_trees=3, max_depth=3)
    assert seen and set(seen) == {"true"}
    assert spark.conf.get(KEY, None) == before
    assert out.where("b is null").isEmpty() and out.count() == 400


def test_grams_with_large_values_in_missing_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    gone = rng.random((300, 2)) < [0.1, 0.9]
    for big in (0.0, 1e12, float("nan")):  # in a row where the first target is missing
        v = x.copy()
        gone[0] = True, False
        v[0, 2] += big
        df = spark.createDataFrame([(*map(float, r), bool(not g[0]), bool(not g[1])) for r, g in zip(v, gone)],
                                   "a double, b double, c double, _o_a boolean, _o_b boolean").repartition(3)
        for (t, ps), got in zip(regs := [("a", ["b", "c"]), ("b", ["a", "c"])], MO.grams(df, regs)):
            keep = ~gone[:, "ab".index(t)]
            z = np.column_stack([np.ones(keep.sum()), v[keep][:, ["abc".index(p) for p in ps]], v[keep, "abc".index(t)]])
            np.testing.assert_allclose(got, z.T @ z, rtol=1e-9, atol=1e-9)
