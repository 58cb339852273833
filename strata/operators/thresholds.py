"""E-14: best decision threshold on a grid (F1 or Youden's J).

The grid is ``lo..hi`` in steps of ``step`` (default 0.30..0.70 by 0.01,
41 thresholds), kept as integers over a denominator so the literals are
exact decimals.  Instead of pairing every row (or score) with every
threshold, each row is mapped to the index of the highest grid threshold it
clears; counts per index (at most grid size + 1 rows) then give the
confusion matrix at every threshold with a suffix sum over that tiny table.
Ties go to the lowest threshold.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _grid(lo: float, hi: float, step: float) -> tuple[list[int], int]:
    """The grid as integers over a power of ten that holds all three exactly."""
    exact = [Decimal(str(x)) for x in (lo, hi, step)]
    if exact[2] <= 0:
        raise ValueError(f"the step must be positive, not {step}")
    denom = 10 ** max(0, *(-x.as_tuple().exponent for x in exact))
    a, b, s = (int(x * denom) for x in exact)
    return list(range(a, b + 1, s)), denom


def threshold_grid(df: DataFrame, y: str = "y", p: str = "p", lo: float = 0.30, hi: float = 0.70,
                   step: float = 0.01) -> DataFrame:
    """Confusion counts, F1 and Youden's J at every grid threshold."""
    grid, denom = _grid(lo, hi, step)
    pc = F.col(p)
    idx = F.lit(-1)
    for j, t in enumerate(grid):  # highest cleared threshold wins
        idx = F.when(pc >= F.lit(t / denom), F.lit(j)).otherwise(idx)
    counts = (df.withColumn("_j", idx).groupBy("_j")
              .agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).cast("long").alias("_pos"),
                   F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).cast("long").alias("_neg")))
    spark = df.sparkSession
    g = spark.createDataFrame([(j, t) for j, t in enumerate(grid)] + [(-1, None)], "_j int, _t int")
    # grid (42 rows) x per-index counts (<= 42 rows): both sides are bounded by the grid size
    t = g.join(F.broadcast(counts), on="_j", how="left").fillna(0, subset=["_pos", "_neg"])
    suffix = Window.orderBy(F.col("_j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy()
    t = t.select(
        "_j", "_t",
        F.sum("_pos").over(suffix).alias("TP"), F.sum("_neg").over(suffix).alias("FP"),
        F.sum("_pos").over(tot).alias("_P"), F.sum("_neg").over(tot).alias("_N"),
    ).where(F.col("_j") >= 0)
    tp, fp = F.col("TP"), F.col("FP")
    fn, tn = F.col("_P") - tp, F.col("_N") - fp
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    tpr = F.when(F.col("_P") > 0, tp / F.col("_P")).otherwise(F.lit(0.0))
    tnr = F.when(F.col("_N") > 0, tn / F.col("_N")).otherwise(F.lit(0.0))
    return t.select(
        F.round(F.col("_t") / F.lit(float(denom)), 6).alias("threshold"),
        tn.cast("long").alias("TN"), fp.alias("FP"), fn.cast("long").alias("FN"), tp.alias("TP"),
        f1.alias("f1"), (tpr + tnr - 1).alias("youden"),
    )


def best_threshold(df: DataFrame, y: str = "y", p: str = "p", metric: str = "f1", lo: float = 0.30,
                   hi: float = 0.70, step: float = 0.01) -> DataFrame:
    """One row: metric name, best threshold (lowest on ties), its score."""
    if metric not in ("f1", "youden"):
        raise ValueError("metric must be f1 or youden")
    g = threshold_grid(df, y, p, lo, hi, step)
    best = g.agg(F.max(metric).alias("_best"))
    return (g.join(F.broadcast(best), F.col(metric) == F.col("_best"))
            .agg(F.min("threshold").alias("best_threshold"), F.max(metric).alias("best_score"))
            .select(F.lit(metric).alias("metric"), "best_threshold", "best_score"))
