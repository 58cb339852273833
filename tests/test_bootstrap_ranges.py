"""The bootstrap over score ranges against the one over grouped scores."""

import random

import pytest

from strata.operators import bootstrap as BS


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranges_equal_grouped_scores(spark, monkeypatch, keys):
    rng = random.Random(4)
    # a score shared by a third of the rows, ties, nulls and NaN
    score = lambda: rng.choice([0.5, None, float("nan"), rng.random(), round(rng.random(), 1), rng.random()])
    rows = [(i, rng.choice(["a", "b", None]), 0.5 if i % 3 == 0 else score(), int(rng.random() < 0.4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, p double, y int").repartition(3)
    want = {tuple(r[k] for k in (*keys, "replicate")): r for r in BS.replicate_metrics(df, B=230, keys=keys).collect()}
    monkeypatch.setattr(BS, "GROUPED", 0)
    monkeypatch.setattr(BS, "RANGE_ROWS", 100)         # more ranges than the hot score fits in
    got = {tuple(r[k] for k in (*keys, "replicate")): r for r in BS.replicate_metrics(df, B=230, keys=keys).collect()}
    assert got.keys() == want.keys() and len(want) == 230 * (3 if keys else 1)
    for k, r in want.items():
        assert (got[k].n_pos, got[k].n_neg) == (r.n_pos, r.n_neg)
        assert (got[k].AUROC, got[k].AUPRC) == pytest.approx((r.AUROC, r.AUPRC), rel=1e-9)
