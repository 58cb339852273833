"""Running sums and global ranks without a single-partition window.

``sum(x) OVER (ORDER BY p DESC)`` with no PARTITION BY plans an
``Exchange SinglePartition``: one task sorts everything.  Both helpers here
split the ordered domain into buckets, compute per-bucket totals (a table of
``keys x buckets`` rows), turn those into offsets with a small window, and
finish with a window partitioned by ``(keys, bucket)``.  Inputs of every size
take this path.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut_lineage

# Target rows per bucket.
ROWS_PER_BUCKET = 500_000


def running_sums(g: DataFrame, order_col: str, sum_cols: Sequence[str], keys: Sequence[str] = (),
                 descending: bool = True, n_buckets: int | None = None, probe: DataFrame | None = None) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``order_col`` order within
    ``keys``) and ``tot_<c>`` (total within ``keys``) for every ``c``.

    ``g`` must hold one row per ``(keys, order_col)`` (aggregate first), so
    the order has no ties and a ROWS frame is exact.

    A null order value is below every number and NaN above (Spark's own
    order); each has a bucket.  A null key is a key like any other.

    Buckets are cut at quantiles of ``order_col``; their number follows the
    number of rows.  The count and the bucket edges use ``probe`` (default
    ``g``): a caller whose ``g`` is costly to produce (bootstrap replicates)
    passes the cheap table it was derived from.
    """
    keys = list(keys)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    probe = g if probe is None else probe
    if n_buckets is None:
        # buckets are cut over all keys together, so they are counted over all
        # keys together too: none holds much more than ROWS_PER_BUCKET rows
        n_buckets = max(8, math.ceil(probe.count() / ROWS_PER_BUCKET))
    fracs = [i / n_buckets for i in range(1, n_buckets)]
    x = F.col(order_col).cast("double")
    finite = probe.where(F.abs(x) < float("inf"))  # neither null nor NaN
    edges = finite.agg(F.percentile_approx(x, fracs, max(10000, 20 * n_buckets)).alias("q")).first()["q"] if fracs else None
    splits = [-math.inf, *sorted({float(e) + 0.0 for e in edges or [0.0]}), math.inf]
    bucketed = Bucketizer(splits=splits, inputCol=order_col, outputCol="_bucket_d", handleInvalid="keep").transform(g)
    bucketed = bucketed.withColumn("_bucket", F.coalesce(F.col("_bucket_d").cast("int"), F.lit(-1))).drop("_bucket_d")

    border = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    totals = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wb = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    wk = Window.partitionBy(*keys)
    offsets = totals.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_of"),
        *[F.sum(f"_bt_{c}").over(wb).alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_bt_{c}").over(wk).alias(f"tot_{c}") for c in sum_cols],
    )
    # offsets has keys x buckets rows; AQE turns this into a broadcast join
    # when its measured size is under the broadcast threshold.
    same = F.col("_bucket") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    joined = bucketed.join(offsets, same, "inner")
    w = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = list(g.columns)
    for c in sum_cols:
        off, own = F.col(f"_off_{c}"), F.sum(c).over(w)
        joined = joined.withColumn(f"cum_{c}", F.coalesce(off + own, off, own))
        out += [f"cum_{c}", f"tot_{c}"]
    return joined.select(*out)


def global_row_number(df: DataFrame, keys: Sequence[str], hash_col: str, tie_col: str, n_rows: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY hash_col, tie_col)``
    computed in parallel, for a uniformly distributed hex ``hash_col``.

    The bucket is the hash's first hex digits, as many as the number of rows
    (``n_rows``, else counted) needs, so buckets are balanced by construction
    and a 2-valued key does not collapse the work onto two tasks.  Adds ``rn``
    (1-based).
    """
    keys = list(keys)
    n = df.count() if n_rows is None else n_rows
    digits = next(d for d in range(2, 16) if 16 ** d >= n / (ROWS_PER_BUCKET // 16) or d == 15)
    bucket = F.conv(F.substring(F.col(hash_col), 1, digits), 16, 10).cast("long")
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"))
    joined = b.join(offsets, on=[*keys, "_bucket"], how="inner")
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.col(hash_col), F.col(tie_col))
    return joined.withColumn("rn", F.col("_off") + F.row_number().over(w)).drop("_bucket", "_off")


def sorted_numbers(df: DataFrame, keys: Sequence[str], order_col: str, out: str = "rn") -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order_col)`` for values
    of any type, unique within ``keys``: rows are dealt by ranges, written once
    with their range, and numbered within it on top of the counts of the ranges
    before.  No window spans a whole key."""
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, *keys, order_col).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"),
                            F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_off"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    w = Window.partitionBy(*keys, "_range").orderBy(order_col)
    return dealt.join(offsets, same).withColumn(out, F.col("_off") + F.row_number().over(w)).select(*df.columns, out)
