"""Cross-validation fits its folds side by side, boosted trees on few
partitions of a small table, forests of a large table one at a time."""

import threading
import time

from strata.operators import train as TR


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "id % 7 + id % 3 AS x", "int(id % 3 = 0) AS y").repartition(4)
    all_here, real, seen = threading.Barrier(3), TR.fit, {}

    def fit(data, features, y, spec, final=True, counts=None):
        all_here.wait(60)  # one after the other, the first would wait for ever
        row = data.selectExpr("sum(int(y = 0))", "sum(int(y = 1))").first()
        seen[spec.seed] = (tuple(row) == counts, data.rdd.getNumPartitions())
        return real(data, features, y, spec, final, counts)

    monkeypatch.setattr(TR, "fit", fit)
    oof, models = TR.cross_validate(df, ["x"], "y", "id", TR.ModelSpec("gbt", {"maxIter": 2}), k=3)
    assert seen == {43: (True, 1), 44: (True, 1), 45: (True, 1)}
    assert [m.getSeed() if hasattr(m, "getSeed") else m.getOrDefault("seed") for m in models] == [43, 44, 45]
    assert oof.count() == 300 and oof.select("id").distinct().count() == 300


def test_forests_of_a_large_table_are_fitted_one_at_a_time(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "id % 7 + id % 3 AS x", "int(id % 3 = 0) AS y").repartition(4)
    real, lock, now, most = TR.fit, threading.Lock(), [0], [0]

    def fit(*args, **kwargs):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.5)
        try:
            return real(*args, **kwargs)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(TR, "fit", fit)
    found = []
    for rows_a_core, at_once in ((1000, 3), (1, 1)):
        monkeypatch.setattr(TR, "FOREST_ROWS", rows_a_core)
        most[0] = 0
        oof, models = TR.cross_validate(df, ["x"], "y", "id", TR.ModelSpec("forest", {"numTrees": 3, "maxDepth": 2}), k=3)
        assert most[0] == at_once and len(models) == 3
        found.append(sorted(map(tuple, oof.collect())))
    assert len(found[0]) == 300 and found[0] == found[1]     # the same rows either way


def test_forests_side_by_side_follow_the_rows(spark, monkeypatch):
    df, cores = spark.range(1), spark.sparkContext.defaultParallelism
    monkeypatch.setattr(TR, "FOREST_ROWS", 100)
    full = 100 * cores
    assert [TR.forests_at_once(df, n, 5) for n in (0, full // 10, full // 2, full - 1, full, 10 * full)] == [5, 5, 2, 1, 1, 1]
