"""Exact quantiles by brackets against Spark's exact percentile and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import profile as PR

FRACS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _table(spark, n=4000):
    rng = np.random.default_rng(3)
    rows = [(None if k == 3 else f"k{k}", float(rng.normal()), int(rng.integers(0, 3)), None, float(i) if i % 3 else None,
             float("nan") if i % 50 == 0 else float(i % 7)) for i, k in enumerate(rng.integers(0, 4, n))]
    return spark.createDataFrame(rows, "k string, a double, b int, c double, d double, e double").repartition(5)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_equal_percentile(spark, monkeypatch, accuracy):
    monkeypatch.setattr(PR, "ACCURACY", accuracy)       # 50: wide brackets with many values inside
    df = _table(spark)
    for keys in ([], ["k"]):
        got = {tuple(r)[:-1]: r.value for r in PR.exact_quantiles(df, ["a", "b", "c", "d"], FRACS, keys).collect()}
        want = {}
        for r in df.groupBy(*keys).agg(*[F.percentile(c, FRACS).alias(c) for c in "abcd"]).collect():
            want |= {(*[r[k] for k in keys], c, f): v for c in "abcd" if r[c] is not None for f, v in zip(FRACS, r[c])}
        assert got.keys() == want.keys() and got == pytest.approx(want, rel=1e-12)


def test_nan_is_above_all_numbers(spark):
    got = {r.frac: r.value for r in PR.exact_quantiles(_table(spark), ["e"], [0.0, 0.5, 1.0]).collect()}
    assert (got[0.0], got[0.5]) == (0.0, 3.0) and np.isnan(got[1.0])
    assert PR.exact_quantiles(_table(spark).limit(0), ["a"], [0.5]).count() == 0


def test_brackets_that_miss_fall_back(spark, monkeypatch):
    df = _table(spark)
    want = {tuple(r) for r in PR.exact_quantiles(df, ["a", "d"], [0.5]).collect()}
    real = F.percentile_approx
    monkeypatch.setattr(PR.F, "percentile_approx", lambda c, p, a: real(c, [0.99] * len(p), a) if isinstance(p, list) else real(c, p, a))
    assert {tuple(r) for r in PR._quantiles_by_counts(df, ["a", "d"], [0.5]).collect()} == want
    monkeypatch.setattr(PR, "_quantiles_by_counts", lambda *a: "counted")
    assert PR.exact_quantiles(df, ["a", "d"], [0.5]) == "counted"
