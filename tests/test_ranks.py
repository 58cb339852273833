"""Spearman's r by ranks per null class, against ranks taken pair by pair."""

import numpy as np
import pandas as pd
import pytest

from strata.operators import profile as PR
from strata.operators import ranks as RK


def _frame(n=700):
    rng = np.random.default_rng(3)
    base = rng.normal(size=n)
    t = pd.DataFrame({
        "a": base, "b": np.round(base + rng.normal(size=n)),        # ties
        "c": np.where(rng.random(n) < 0.6, 0.0, rng.exponential(size=n)),   # a value that most rows share
        "d": -base ** 3, "k": 7.0, "e": rng.normal(size=n), "f": rng.normal(size=n), "none": np.nan})
    gone = rng.random(n) < 0.3
    t.loc[gone, ["a", "e"]] = np.nan            # the same rows
    t.loc[rng.random(n) < 0.5, "d"] = np.nan
    t.loc[~gone, "f"] = np.nan                  # never beside a
    return t


def _spark(spark, t):
    rows = [tuple(None if x != x else float(x) for x in r) for r in t.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in t.columns)).repartition(6)


def test_null_classes():
    both = np.array([[5, 5, 3], [5, 5, 3], [3, 3, 5]])
    assert RK.null_classes(both) == [0, 0, 1]


def test_spearman_pair_by_pair(spark, monkeypatch):
    t = _frame()
    monkeypatch.setattr(RK, "CELLS", 900)       # many slices a batch
    got = RK.spearman(_spark(spark, t), list(t.columns))
    for i, a in enumerate(t):
        for j, b in enumerate(t):
            u = t[[a, b]].dropna() if a != b else t[[a]].dropna()
            x, y = u.iloc[:, 0].rank(), u.iloc[:, -1].rank()
            if len(u) < 2 or x.nunique() < 2 or y.nunique() < 2:
                assert np.isnan(got[i, j]), (a, b)
            else:
                assert got[i, j] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12), (a, b)


def test_spearman_edge_cases(spark):
    schema = "a double, b double"
    nan = float("nan")
    rows = [(1.0, 1.0), (2.0, 2.0), (nan, 3.0), (nan, 4.0), (-0.0, -1.0), (0.0, -1.0)]
    got = RK.spearman(spark.createDataFrame(rows, schema), ["a", "b"])      # NaN: the greatest, tied with itself
    x, y = [3, 4, 5.5, 5.5, 1.5, 1.5], [3, 4, 5, 6, 1.5, 1.5]
    assert got[0, 1] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    assert np.isnan(RK.spearman(spark.createDataFrame([], schema), ["a", "b"])).all()
    one = PR.corr_matrix(spark.createDataFrame([(1.0,)], "a double"), "spearman")
    assert one.columns == ["Feature_1", "Feature_2", "Correlation"] and one.count() == 0
