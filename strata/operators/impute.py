"""Imputation (I-1..I-9, F-12, F-13, J-8).

* ``median_fill`` (I-1): exact medians of all columns (by default from
  distinct-value counts and running sums, so no column is buffered in one
  task), then ``coalesce``.
* ``mice_impute`` (I-3..I-7): chained Bayesian ridge regressions.  A round
  sums the Gram matrices of all target columns in one scan
  (``operators.moments``); the solves, of (p+1)^2 numbers each, run on the
  driver, one more scan predicts.  Lineage is cut every round.
* ``forest_impute`` (I-2): forests of all columns with nulls, grown together
  on binned columns (``operators.forest``); a job to grow, one to predict and
  one checkpoint a round.
* ``imputation_benchmark`` (I-9): hash-masked cells per (repeat, id,
  feature), imputed by each method, scored by RMSE/MAE per feature.

Observed cells are never changed (I-7): every method writes
``coalesce(observed, imputed)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.clean import q
from strata.functions.hashing import md5_uniform
from strata.operators.forest import LOCAL_ROWS, bin_edges, grow_forests, targets_at_once, to_bins
from strata.operators.moments import bayesian_ridge, grams, pair_moments
from strata.operators.moments import ridge as ridge_fit
from strata.session import cut_lineage, freed_shuffles


def medians(df: DataFrame, cols: Sequence[str], exact: bool | str = "distributed") -> dict[str, float | None]:
    """Exact medians (``percentile``), approximate ones (``exact=False``), or
    exact ones computed without a per-column value buffer
    (``exact="distributed"``, see :func:`strata.operators.profile.exact_quantiles`)."""
    if exact == "distributed":
        from strata.operators.profile import exact_quantiles
        got = {r["feature"]: r["value"] for r in exact_quantiles(df, cols, [0.5]).collect()}  # one row per column
        return {c: (None if got.get(c) is None else float(got[c])) for c in cols}
    aggs = [(F.percentile(q(c).cast("double"), F.lit(0.5)) if exact
             else F.percentile_approx(q(c).cast("double"), 0.5, 10000)).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).first()
    return {c: (None if row[f"m{i}"] is None else float(row[f"m{i}"])) for i, c in enumerate(cols)}


def median_fill(df: DataFrame, cols: Sequence[str], exact: bool | str = "distributed") -> DataFrame:
    """I-1: fill nulls with each column's exact median."""
    med = medians(df, cols, exact)
    return df.select(*[F.coalesce(q(c).cast("double"), F.lit(med[c])).alias(c) if c in med else q(c)
                       for c in df.columns])


def initial_fill(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> DataFrame:
    """The values that chained imputation starts from: each column's median,
    mean, most frequent value (the least of equally frequent ones) or 0."""
    if strategy == "median":
        return median_fill(df, cols)
    if strategy == "mean":
        row = df.agg(*[F.avg(q(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).first()
        values = {c: row[f"v{i}"] for i, c in enumerate(cols)}
    elif strategy == "constant":
        values = dict.fromkeys(cols, 0.0)
    elif strategy == "most_frequent":
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("double").alias("v")) for c in cols])).alias("r")) \
            .select("r.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        best = cells.groupBy("c").agg(F.max_by(F.col("v"), F.struct(F.col("n"), -F.col("v"))).alias("v"))
        values = {r["c"]: r["v"] for r in best.collect()}        # one row a column
    else:
        raise ValueError(f"Unknown initial strategy '{strategy}'")
    return df.select(*[F.coalesce(q(c).cast("double"), F.lit(values.get(c))).alias(c) if c in cols else q(c) for c in df.columns])


def imputation_order(with_nulls: Sequence[str], counts, order: str = "ascending", seed: int = 0) -> list[str]:
    """The order in which a round takes the columns with nulls: by number of
    nulls, as they stand (roman), from the last one back (arabic), or random."""
    cols = list(with_nulls)
    if order in ("ascending", "descending"):
        return sorted(cols, key=lambda c: (counts[c], c) if order == "ascending" else (-counts[c], c))
    if order in ("roman", "arabic"):
        return cols if order == "roman" else cols[::-1]
    if order == "random":
        return [cols[i] for i in np.random.default_rng(seed).permutation(len(cols))]
    raise ValueError(f"Unknown imputation order '{order}'")


def mice_impute(df: DataFrame, id_col: str, cols: Sequence[str], max_iter: int = 10, tol: float = 1e-3,
                estimator: str = "bayesian_ridge", ridge: float = 1e-6, n_nearest: int | None = 30, min_value: float | None = None,
                max_value: float | None = None, add_indicator: bool = False, initial_strategy: str = "median",
                order: str = "ascending", sample_posterior: bool = False, seed: int = 0) -> DataFrame:
    """I-3: chained Bayesian ridge regressions (``estimator="ridge"``: least
    squares with the fixed penalty ``ridge``).

    Starts from ``initial_strategy``; predictors of a column are its
    ``n_nearest`` most correlated ones (I-4, ties by name).  A round reads the
    table twice: one scan sums the Gram matrices of all columns with nulls, one
    predicts them, each from the values that the columns before it in ``order``
    have just got.  Stops when ``max |new - old| < tol * max |observed|`` (I-6)
    or after ``max_iter``.  ``sample_posterior`` (I-5) draws each value from the
    predictive distribution, the variance being that of the noise and that of
    the slopes, cut off at ``min_value`` and ``max_value``; a draw is a function
    of (seed, id, column, round), so reruns and retries agree.
    """
    cols = list(cols)
    counts = df.agg(*[F.sum(q(c).isNull().cast("int")).alias(c) for c in cols]).first()
    cols = _observed(df, cols, counts)
    with_nulls = imputation_order([c for c in cols if counts[c] > 0], counts, order, seed)
    if estimator not in ("bayesian_ridge", "ridge"):
        raise ValueError(f"Unknown estimator '{estimator}'")
    base = df.select(q(id_col), *[q(c).cast("double").alias(c) for c in cols],
                     *[q(c).isNotNull().alias(f"_o_{c}") for c in cols],
                     *[q(c) for c in df.columns if c not in cols and c != id_col])
    cur = initial_fill(base, cols, initial_strategy)
    if not with_nulls:
        return _finish(cur, df, id_col, cols, add_indicator)
    cur = cut_lineage(cur.withColumn("_h", F.xxhash64(F.lit(seed), q(id_col).cast("string"))))
    r = np.abs(np.nan_to_num(pair_moments(cur, cols).pearson()))
    scale = max(abs(v) for v in cur.agg(*[F.max(F.abs(q(c))).alias(c) for c in cols]).first() if v is not None) or 1.0
    nearest = {}
    for c in with_nulls:
        others = sorted((p for p in cols if p != c), key=lambda p: (-r[cols.index(c), cols.index(p)], p))
        nearest[c] = sorted(others if n_nearest is None else others[:n_nearest], key=cols.index)
    for it in range(max_iter):
        found = grams(cur.drop("_d"), [(c, nearest[c]) for c in with_nulls])
        fits = {c: bayesian_ridge(g) if estimator == "bayesian_ridge" else ridge_fit(g, ridge)
                for c, g in zip(with_nulls, found)}
        cur = cut_lineage(_chained(cur.drop("_d"), cols, nearest, fits, min_value, max_value, it if sample_posterior else None))
        moved = cur.agg(F.max("_d")).first()[0] or 0.0
        if moved < tol * scale:
            break
    return _finish(cur, df, id_col, cols, add_indicator)


def _uniform(row_hash: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each row (by its 64-bit hash) and draw."""
    h = row_hash.view(np.uint64) ^ np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _drawn(mean: np.ndarray, sd: np.ndarray, u: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """Normal values at the quantiles ``u``, cut off at the bounds."""
    from statistics import NormalDist
    unit = NormalDist()
    out = np.empty(len(mean))
    for i, (m, s, x) in enumerate(zip(mean.tolist(), sd.tolist(), u.tolist())):
        if s <= 0:
            out[i] = m
            continue
        a = 0.0 if low is None else unit.cdf((low - m) / s)
        b = 1.0 if high is None else unit.cdf((high - m) / s)
        x = a + x * (b - a)
        out[i] = m + s * unit.inv_cdf(min(max(x, 1e-15), 1 - 1e-15))
    return np.clip(out, -np.inf if low is None else low, np.inf if high is None else high)


def _chained(cur: DataFrame, cols: Sequence[str], nearest, fits, low, high, draw_round: int | None) -> DataFrame:
    """``cur`` with the missing cells predicted column after column; ``_d`` is
    the largest change in the row."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1)
            h = b.column("_h").to_numpy()
            moved = np.zeros(len(x))
            for k, (c, fit) in enumerate(fits.items()):
                gone = np.flatnonzero(~b.column(f"_o_{c}").to_numpy(zero_copy_only=False))
                z = x[gone][:, [cols.index(p) for p in nearest[c]]]
                y = fit.start + z @ fit.slope
                if draw_round is not None:
                    z = z - fit.center
                    sd = np.sqrt(fit.noise + np.maximum((z @ fit.cov * z).sum(axis=1), 0.0))
                    y = _drawn(y, sd, _uniform(h[gone], draw_round * len(fits) + k), low, high)
                y = np.clip(y, -np.inf if low is None else low, np.inf if high is None else high)
                moved[gone] = np.maximum(moved[gone], np.abs(y - x[gone, cols.index(c)]))
                x[gone, cols.index(c)] = y
            new = {c: pa.array(x[:, i].copy()) for i, c in enumerate(cols)}
            yield pa.RecordBatch.from_arrays([*(new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)), pa.array(moved)],
                                             [*b.schema.names, "_d"])

    return cur.mapInArrow(run, T.StructType([*cur.schema.fields, T.StructField("_d", T.DoubleType())]))


def _finish(cur: DataFrame, df: DataFrame, id_col: str, cols: Sequence[str], add_indicator: bool) -> DataFrame:
    extra = [c for c in df.columns if c not in cols and c != id_col]
    out = [q(id_col), *[q(c) for c in cols]]
    if add_indicator:
        out += [(~F.col(f"_o_{c}")).cast("int").alias(f"{c}_was_missing") for c in cols]
    return cur.select(*out, *[q(c) for c in extra])


def _observed(df: DataFrame, cols: Sequence[str], counts) -> list[str]:
    """The columns with a value in some row.  A column without any can
    neither be predicted nor predict; it passes through as it is."""
    n = df.count()
    return [c for c in cols if (counts[c] or 0) < n]


def forest_impute(df: DataFrame, id_col: str, cols: Sequence[str], max_iter: int = 10, num_trees: int = 100,
                  max_depth: int = 10, seed: int = 42, tol: float = 1e-3, max_bins: int = 32,
                  local_rows: int = LOCAL_ROWS) -> DataFrame:
    """I-2: iterative random-forest imputation, see ``operators.forest``.

    From the median fill on, each round grows the forests of the columns with
    nulls from the values of the round before (groups of columns, ascending null
    count, whose trees fit the driver; a later group sees the earlier ones' new
    values), and predicts the missing cells.  All columns are binned once, at
    ``max_bins`` quantiles.  Stops when ``max |new - old| < tol * max |observed|``
    (I-6).  The reference grows trees to unlimited depth; here ``max_depth``."""
    cols = list(cols)
    counts = df.agg(*[F.sum(q(c).isNull().cast("int")).alias(c) for c in cols]).first()
    cols = _observed(df, cols, counts)
    with_nulls = sorted([c for c in cols if counts[c] > 0], key=lambda c: (counts[c], c))
    if not with_nulls:
        return df
    base = df.select(q(id_col), *[q(c).cast("double").alias(c) for c in cols],
                     *[q(c).isNotNull().alias(f"_o_{c}") for c in cols],
                     F.xxhash64(F.lit(seed), q(id_col)).alias("_h"),
                     *[q(c) for c in df.columns if c not in cols and c != id_col])
    cur = cut_lineage(median_fill(base, cols))
    scale = max(abs(v) for v in cur.agg(*[F.max(F.abs(q(c))).alias(c) for c in cols]).first() if v is not None) or 1.0
    edges = bin_edges(cur, cols, max_bins)
    group = targets_at_once(num_trees, max_depth, local_rows, cur.count())
    groups = [with_nulls[i:i + group] for i in range(0, len(with_nulls), group)]
    for it in range(max_iter):
        moved = 0.0
        for k, some in enumerate(groups):
            first = (it * len(groups) + k) * num_trees * group
            with freed_shuffles(df.sparkSession):  # rows x trees are shuffled; gone when the forests are grown
                cur = cut_lineage(_predicted(cur.drop("_d"), cols, some, edges, grow_forests(
                    cur.drop("_d"), cols, some, edges, num_trees, max_depth, first, local_rows)))
            moved = max(moved, cur.agg(F.max("_d")).first()[0] or 0.0)
        if moved < tol * scale:
            break
    return _finish(cur, df, id_col, cols, False)


def _predicted(cur: DataFrame, cols: Sequence[str], targets: Sequence[str], edges, forests) -> DataFrame:
    """``cur`` with the missing cells of ``targets`` predicted; ``_d`` is the
    largest change in the row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1)
            bins = to_bins(x, edges)
            moved = np.zeros(len(x))
            new = {}
            for t in targets:
                j = cols.index(t)
                gone = np.flatnonzero(~b.column(f"_o_{t}").to_numpy(zero_copy_only=False))
                own = bins[gone]
                own[:, j] = 0
                y = forests[t].predict(own)
                moved[gone] = np.maximum(moved[gone], np.abs(y - x[gone, j]))
                v = x[:, j].copy()
                v[gone] = y
                new[t] = pa.array(v)
            yield pa.RecordBatch.from_arrays([*(new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)), pa.array(moved)],
                                             [*b.schema.names, "_d"])

    from pyspark.sql import types as T
    return cur.mapInArrow(run, T.StructType([*cur.schema.fields, T.StructField("_d", T.DoubleType())]))


METHODS = {"mice": "mice", "missforest": "forest", "miss_forest": "forest", "miss-forest": "forest",
           "forest": "forest"}


def impute(df: DataFrame, id_col: str, cols: Sequence[str], method: str = "mice", **kw) -> DataFrame:
    """I-8: dispatch by method name; unknown names raise."""
    m = METHODS.get(str(method).strip().lower())
    if m is None:
        raise ValueError(f"Unknown imputation method '{method}'")
    return mice_impute(df, id_col, cols, **kw) if m == "mice" else forest_impute(df, id_col, cols, **kw)


def mask_cells(df: DataFrame, id_col: str, cols: Sequence[str], frac: float = 0.10, repeat: int = 0,
               seed: int = 42) -> DataFrame:
    """I-9: hide a deterministic ``frac`` of the observed cells (md5 of
    seed:repeat:id:feature), keeping the true values in ``_true_<c>``."""
    out = [q(id_col)]
    for c in cols:
        u = md5_uniform(seed, F.lit(repeat), q(id_col), F.lit(c))
        hide = q(c).isNotNull() & (u < F.lit(float(frac)))
        out += [F.when(hide, F.lit(None).cast("double")).otherwise(q(c).cast("double")).alias(c),
                F.when(hide, q(c).cast("double")).alias(f"_true_{c}")]
    rest = [q(c) for c in df.columns if c not in cols and c != id_col]
    return df.select(*out, *rest)


def imputation_errors(imputed: DataFrame, masked: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """RMSE / MAE per feature over the masked cells (join on id)."""
    truth = masked.select(q(id_col), *[F.col(f"_true_{c}") for c in cols])
    j = imputed.select(q(id_col), *[q(c) for c in cols]).join(truth, on=id_col)
    long = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (q(c) - F.col(f"_true_{c}")).alias("err"))
                                        for c in cols])).alias("r")).select("r.*").where(F.col("err").isNotNull())
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n_masked"),
                                       F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
                                       F.avg(F.abs("err")).alias("mae"))


def imputation_benchmark(df: DataFrame, id_col: str, cols: Sequence[str], methods: Sequence[str] = ("mice", "missforest"),
                         mask_frac: float = 0.10, repeats: int = 5, seed: int = 42, parallelism: int = 4, **kw) -> DataFrame:
    """I-9: (method, repeat, feature, n_masked, rmse, mae).  The repeats do not
    depend on each other; ``parallelism`` of them are submitted at a time, so
    that the small jobs of one fill the gaps of another."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    def run(r: int) -> list[DataFrame]:
        masked = cut_lineage(mask_cells(df, id_col, cols, mask_frac, r, seed))
        base = masked.select(q(id_col), *[q(c) for c in cols])
        return [imputation_errors(impute(base, id_col, cols, m, **kw.get(METHODS[m.lower()], {})), masked, id_col, cols)
                .select(F.lit(m).alias("method"), F.lit(r).alias("repeat"), "*") for m in methods]

    pool = ThreadPool(max(1, parallelism))
    try:
        with freed_shuffles(df.sparkSession):  # the session's setting, for all threads
            parts = [p for some in pool.map(inheritable_thread_target(df.sparkSession)(run), range(repeats)) for p in some]
    finally:
        pool.close()
    return reduce(DataFrame.unionByName, parts)
