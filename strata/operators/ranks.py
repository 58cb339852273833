"""Rank correlation of all column pairs (W-3, A-5 Spearman), without a table of
rows x pairs.

A value's rank among the rows where another column is present too depends on
that column only through its nulls.  Columns with nulls in the same rows form a
class, and each (column, value) gets its rank once per class: running counts
over (column, value), one count for every class.  The ranks are joined to the
rows x columns table once, gathered by row, and their products summed by numpy
over Arrow batches.

Rows of one column set move: rows x columns entries with one number a null
class (one number if nothing is missing).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.clean import q
from strata.functions.prefix import running_sums
from strata.operators.moments import merged, pair_moments
from strata.session import cut_lineage, spread

#: numbers of one numpy array in a task (32 MB)
CELLS = 4_000_000


def null_classes(both: np.ndarray) -> list[int]:
    """The class of each column: two columns are null in the same rows if as
    many rows hold both as hold either (``both[i, j]``: rows that hold i and j)."""
    first: list[int] = []
    of = []
    for i in range(len(both)):
        k = next((k for k, j in enumerate(first) if both[i, i] == both[j, j] == both[i, j]), len(first))
        if k == len(first):
            first.append(i)
        of.append(k)
    return of


def _slices(n: int, width: int) -> Iterator[slice]:
    step = max(1, CELLS // max(width, 1))
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def spearman(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Spearman's r of every pair over the rows where both are present: ties
    share the mean rank, NaN is above all numbers, a pair with a constant column
    or without common rows has no r (NaN).

    Ranks are taken around their mean, in halves, so the sums lose no digits to
    the size of the ranks.
    """
    p = len(cols)
    # a row's number must not change when a lost task runs again
    rows = cut_lineage(spread(df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])))
    there = rows.select(*[F.when(F.col(f"x{i}").isNotNull(), 0.0).alias(f"x{i}") for i in range(p)])
    both = pair_moments(there, [f"x{i}" for i in range(p)]).n
    of = null_classes(both)
    lead = [of.index(k) for k in range(max(of) + 1)]          # a column of each class
    sums = [f"c{k}" for k in range(len(lead))]

    cells = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"x{i}").alias("v")) for i in range(p)]),
                               lambda r: r["v"].isNotNull()))
    counted = rows.select(cells.alias("r"), *[F.col(f"x{j}").isNotNull().cast("long").alias(c) for c, j in zip(sums, lead)])
    counts = counted.groupBy("r.col", "r.v").agg(*[F.sum(c).alias(c) for c in sums])
    upto = running_sums(cut_lineage(counts), "v", sums, keys=["col"], descending=False)
    # twice the rank less its mean: 2 * upto - times - all
    ranks = upto.select("col", "v", F.array(*[(2 * F.col(f"cum_{c}") - F.col(c) - F.col(f"tot_{c}")).cast("double")
                                              for c in sums]).alias("rank"))
    ranked = rows.withColumn("row", F.monotonically_increasing_id()).select("row", cells.alias("r")) \
        .select("row", "r.col", "r.v").join(ranks, ["col", "v"])
    gathered = ranked.groupBy("row").agg(F.collect_list(F.struct("col", "rank")).alias("all")).select("all")
    at = np.array(of)

    def parts(b) -> dict[int, np.ndarray]:
        total = np.zeros((2, p, p))
        lists = b.column(0)
        ends = np.asarray(lists.offsets)
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        col = flat.field("col").to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(ends))
        rank = flat.field("rank").flatten().to_numpy().reshape(len(col), len(sums))
        for s in _slices(len(lists), 2 * p * p):
            r = np.zeros((s.stop - s.start, p, p))
            seen = np.zeros((s.stop - s.start, p))
            mine = slice(*np.searchsorted(row, [s.start, s.stop]))
            r[row[mine] - s.start, col[mine]] = rank[mine][:, at]      # of a column, beside every other one
            seen[row[mine] - s.start, col[mine]] = 1.0
            r *= seen[:, None, :]
            total[0] += np.einsum("nij,nji->ij", r, r)
            total[1] += np.einsum("nij,nij->ij", r, r)
        return {0: total.ravel()}

    co, dev = merged(gathered, parts, np.add).get(0, np.zeros(2 * p * p)).reshape(2, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((dev > 0) & (dev.T > 0), co / np.sqrt(dev * dev.T), np.nan)
