"""Profiling reports (A-1, A-2, A-5..A-11, A-14, A-13, W-3).

Every report is ONE aggregation pass over the cohort computing all columns'
statistics together (partial aggregation per task, a single-row or
per-group result), then reshaped to one row per feature with
``explode(array(struct...))``.  Rows are never sorted; reports (rows =
features) are small and are ordered only for display.

Exact percentiles (``percentile``, linear interpolation like numpy) keep a
count per distinct value; ``exact=False`` switches to ``percentile_approx``
for large continuous columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.clean import numeric_columns, q
from strata.functions.prefix import running_sums
from strata.operators.moments import pair_moments
from strata.operators.ranks import spearman
from strata.session import cut_lineage, spread


def _rows(structs: list[Column]) -> Column:
    return F.explode(F.array(*structs)).alias("r")


def quantile_table(df: DataFrame, cols: Sequence[str], fracs: Sequence[float], names: Sequence[str],
                   keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(keys, feature, <name per frac>): exact quantiles from
    :func:`exact_quantiles` (no per-column buffer), or approximate ones.
    One row per (keys, feature): bounded by the schema x key count."""
    keys = list(keys)
    if exact:
        long = exact_quantiles(df, cols, fracs, keys)
        return long.groupBy(*keys, "feature").agg(
            *[F.max(F.when(F.col("frac") == F.lit(float(f)), F.col("value"))).alias(n) for f, n in zip(fracs, names)])
    a = df.groupBy(*[q(k) for k in keys]).agg(
        *[F.percentile_approx(q(c).cast("double"), [float(f) for f in fracs], 10000).alias(f"p{i}")
          for i, c in enumerate(cols)])
    return a.select(*keys, _rows([F.struct(F.lit(c).alias("feature"),
                                           *[F.col(f"p{i}")[j].alias(n) for j, n in enumerate(names)])
                                  for i, c in enumerate(cols)])).select(*keys, "r.*")


# ---------------------------------------------------------------- A-1 / A-2
def overview(df: DataFrame) -> DataFrame:
    """A-1: one row per column with its type and the table's row count."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    cols = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                     F.lit(f.dataType.simpleString()).alias("dtype")) for i, f in enumerate(df.schema.fields)]
    return n.select("n_rows", _rows(cols)).select("r.*", "n_rows")


def describe_all(df: DataFrame, exact: bool = True) -> DataFrame:
    """A-2: count, unique, top, freq (columns of any type but numeric, by
    their text; binary ones by their hexadecimal digits); mean, std, min,
    25/50/75 %, max (numeric columns); one row per column.

    Numeric statistics: one aggregation.  The others: one
    ``groupBy(feature, value).count()`` over the unpivoted columns,
    then two aggregations per feature (no window over a feature, since a
    high-cardinality text column such as an id would fill one partition).
    Ties for ``top`` go to the smallest value.
    """
    spark = df.sparkSession
    num = numeric_columns(df)
    txt = [c for c in df.columns if c not in num]
    kinds = dict(df.dtypes)
    parts = []
    if num:
        aggs = []
        for i, c in enumerate(num):
            x = q(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        a = df.agg(*aggs)
        basic = a.select(_rows([F.struct(
            F.lit(c).alias("feature"), F.col(f"n{i}").cast("long").alias("count"),
            F.lit(None).cast("long").alias("unique"), F.lit(None).cast("string").alias("top"),
            F.lit(None).cast("long").alias("freq"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
            F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(num)])).select("r.*")
        qt = quantile_table(df, num, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], exact=exact)
        parts.append(basic.join(F.broadcast(qt), "feature", "left").select(
            "feature", "count", "unique", "top", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"))
    if txt:
        long = df.select(_rows([F.struct(F.lit(c).alias("feature"), (
            F.hex(q(c)) if kinds[c] == "binary" else q(c).cast("string")).alias("value")) for c in txt])) \
            .select("r.*").where(F.col("value").isNotNull())
        vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
        per = vc.groupBy("feature").agg(F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"),
                                       F.max("cnt").alias("freq"))
        # per has one row per column (bounded by the schema): broadcast it
        top = (vc.join(F.broadcast(per.select("feature", F.col("freq").alias("cnt"))), on=["feature", "cnt"])
               .groupBy("feature").agg(F.min("value").alias("top")))
        names = spark.createDataFrame([(c,) for c in txt], "feature string")
        t = (names.join(F.broadcast(per), "feature", "left").join(F.broadcast(top), "feature", "left")
             .select("feature", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                     F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"), "top",
                     F.col("freq").cast("long").alias("freq"),
                     *[F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "q25", "q50", "q75", "max")]))
        parts.append(t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- A-8 / A-9
def skewness(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """A-8: bias-corrected sample skewness per numeric feature (null when
    n < 3, 0 for a constant column, as pandas)."""
    cols = numeric_columns(df, exclude)
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs += [F.skewness(x).alias(f"g{i}"), F.count(x).alias(f"n{i}"),
                 (F.min(x) == F.max(x)).alias(f"s{i}")]
    a = df.agg(*aggs)

    def g1(i):
        n = F.col(f"n{i}").cast("double")
        return (F.when(n < 3, F.lit(None).cast("double"))
                .when(F.col(f"s{i}"), F.lit(0.0))  # constant column (exact test)
                .otherwise(F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2)))

    return a.select(_rows([F.struct(F.lit(c).alias("feature"), g1(i).alias("skewness"))
                           for i, c in enumerate(cols)])).select("r.*")


def outliers_percentile(df: DataFrame, exclude: Sequence[str] = (), lower_q: float = 0.01,
                        upper_q: float = 0.99, exact: bool = True) -> DataFrame:
    """A-9: percentile bounds (linear interpolation) and strict outlier
    counts.  Pass 1: all bounds in one aggregation (driver reads one row);
    pass 2: all counts in one aggregation with the bounds as literals."""
    cols = numeric_columns(df, exclude)
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string")
    lo_name, hi_name = f"q{int(lower_q * 100)}", f"q{int(upper_q * 100)}"
    # bounds: one row per feature (bounded by the schema), read on the driver
    qt = {r["feature"]: (r["lo"], r["hi"]) for r in
          quantile_table(df, cols, [lower_q, upper_q], ["lo", "hi"], exact=exact).collect()}
    aggs = []
    kept = []
    for i, c in enumerate(cols):
        bounds = qt.get(c)
        if bounds is None or bounds[0] is None:
            continue  # all-null column: no row, as the reference skips it
        lo, hi = float(bounds[0]), float(bounds[1])
        x = q(c).cast("double")
        kept.append((i, c, lo, hi))
        aggs += [F.sum((x < lo).cast("int")).alias(f"l{i}"), F.sum((x > hi).cast("int")).alias(f"h{i}"),
                 F.count(x).alias(f"n{i}")]
    a = df.agg(*aggs)
    structs = [F.struct(
        F.lit(c).alias("feature"), F.lit(lo).alias(lo_name), F.lit(hi).alias(hi_name),
        F.col(f"l{i}").cast("long").alias("n_low_outliers"), F.col(f"h{i}").cast("long").alias("n_high_outliers"),
        F.col(f"n{i}").cast("long").alias("n_total"),
        (F.col(f"l{i}") / F.col(f"n{i}")).alias("pct_low_outliers"),
        (F.col(f"h{i}") / F.col(f"n{i}")).alias("pct_high_outliers")) for i, c, lo, hi in kept]
    return a.select(_rows(structs)).select("r.*")


# --------------------------------------------------------------- A-10 / A-11
def by_target(df: DataFrame, target: str, exclude: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """A-10: per target class and feature: count, mean, median, std (sample),
    min, max.  One ``groupBy(target)`` aggregation for all features.  Rows
    without a target belong to no class."""
    df = df.filter(q(target).isNotNull())
    cols = numeric_columns(df, [target, *exclude])
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    g = df.groupBy(q(target).alias(target)).agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").cast("long").alias("count"),
                        F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                        F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(cols)]
    basic = g.select(q(target), _rows(structs)).select(target, "r.*")
    med = quantile_table(df, cols, [0.5], ["median"], keys=[target], exact=exact)
    # both sides: one row per (class, feature)
    return basic.join(med, [target, "feature"], "left").select(
        target, "feature", "count", "mean", "median", "std", "min", "max")


def category_by_target(df: DataFrame, category: str, target: str) -> DataFrame:
    """A-11: row count per (category, target)."""
    return df.groupBy(q(category).alias(category), q(target).alias(target)).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- A-13
def class_counts(df: DataFrame, y: str = "y") -> DataFrame:
    """A-13 / M-2: class counts and the negative/positive weight ratio
    (neg / max(pos, 1), the per-fold form)."""
    return df.agg(F.sum((q(y) == 0).cast("int")).cast("long").alias("n_neg"),
                  F.sum((q(y) == 1).cast("int")).cast("long").alias("n_pos")) \
        .select("n_neg", "n_pos", (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("scale_pos_weight"))


# --------------------------------------------------------------------- A-14
def violin_summary(df: DataFrame, exclude: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """A-14: the numbers behind a quartile violin: n, min, quartiles, max."""
    cols = numeric_columns(df, exclude)
    aggs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    a = df.agg(*aggs)
    basic = a.select(_rows([F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").cast("long").alias("n"), F.col(f"a{i}").alias("min"),
        F.col(f"b{i}").alias("max")) for i, c in enumerate(cols)])).select("r.*")
    qt = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], exact=exact)
    return basic.join(F.broadcast(qt), "feature", "left").select("feature", "n", "min", "q25", "q50", "q75", "max")


def violin_density(df: DataFrame, exclude: Sequence[str] = (), n_bins: int = 20) -> DataFrame:
    """A-14: equal-width histogram over [min, max] per feature (the density
    a violin draws).  Bounds from one aggregation; counts from one
    ``groupBy(feature, bin)`` over the unpivoted columns."""
    cols = numeric_columns(df, exclude)
    st = df.agg(*[F.min(q(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                *[F.max(q(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    structs = []
    for i, c in enumerate(cols):
        lo, hi = st[f"a{i}"], st[f"b{i}"]
        if lo is None:
            continue
        x = q(c).cast("double")
        width = float(hi - lo) if hi != lo else 1.0
        # least() skips nulls in Spark: guard so a null value gets no bin
        b = F.when(x.isNotNull(), F.least(F.floor((x - F.lit(float(lo))) / F.lit(width) * F.lit(n_bins)),
                                          F.lit(n_bins - 1))).cast("int")
        structs.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    long = df.select(_rows(structs)).select("r.*").where(F.col("bin").isNotNull())
    return long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- A-5..A-7, J-5, W-3
def _pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r; null (not an error) when either side is
    constant.  Constancy is tested exactly with min = max: a merged
    ``stddev_pop`` of a constant column can come out as ~1e-17 on
    multi-partition input instead of 0."""
    xm = F.when(y.isNotNull(), x)
    ym = F.when(x.isNotNull(), y)
    const = (F.min(xm) == F.max(xm)) | (F.min(ym) == F.max(ym))
    return F.when(~const, F.try_divide(F.covar_pop(x, y), F.stddev_pop(xm) * F.stddev_pop(ym)))


def corr_matrix(df: DataFrame, method: str = "pearson", digits: int = 3) -> DataFrame:
    """A-5: correlation of every ordered pair of numeric columns, rounded
    half-even to ``digits`` (long form: Feature_1, Feature_2, Correlation).
    Pearson: the co-moments of all pairs in one scan.  Spearman (W-3): see
    :func:`strata.operators.ranks.spearman`."""
    cols = numeric_columns(df)
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "Feature_1 string, Feature_2 string, Correlation double")
    r = spearman(df, cols) if method == "spearman" else pair_moments(spread(df), cols).pearson()
    return _correlations(df.sparkSession, cols, r, digits)


def _correlations(spark, cols: Sequence[str], r, digits: int) -> DataFrame:
    """The matrix in long form; null where it is not a number."""
    rows = [(a, b, float(r[i][j]) if r[i][j] == r[i][j] else None) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(rows, "Feature_1 string, Feature_2 string, Correlation double").withColumn(
        "Correlation", F.bround("Correlation", digits))


def correlated_pairs(matrix: DataFrame, columns_order: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """A-6 / A-7: upper triangle (by column position) of the rounded matrix,
    absolute value, kept when >= threshold."""
    pos = {c: i for i, c in enumerate(columns_order)}
    if len(pos) < 2:
        return matrix.sparkSession.createDataFrame([], "Feature_1 string, Feature_2 string, Correlation double")
    idx = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    return (matrix.where(idx[F.col("Feature_1")] < idx[F.col("Feature_2")])
            .select("Feature_1", "Feature_2", F.abs("Correlation").alias("Correlation"))
            .where(F.col("Correlation") >= F.lit(float(threshold))))


def ordered(report: DataFrame, *order: Column) -> DataFrame:
    """O-1: a small report (rows = features, thresholds, ...) in display
    order, as one sorted partition; always pass a name as the last key so
    ties are deterministic.  Never used on cohort-sized tables."""
    return report.coalesce(1).sortWithinPartitions(*order)


#: accuracy of the approximate quantiles that bracket the exact ones
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], fracs: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles (numpy 'linear', Spark
    ``percentile``) without holding a column's values in one buffer:
    (keys, feature, frac, value).

    Approximate quantiles a little below and above each frac bracket the order
    statistics at ranks floor / ceil of frac * (n - 1); the values below a
    bracket are counted, and only those inside (some ``8 / ACCURACY`` of the
    rows, equal ones once) are shuffled and numbered.  Nulls are left out, NaN
    is above all numbers, a null key is a key."""
    keys, fracs = list(keys), [float(f) for f in fracs]
    cols = list(cols)
    if not cols or not fracs:
        return df.sparkSession.createDataFrame([], "feature string, frac double, value double")
    margin = 4.0 / ACCURACY
    ends = [x for f in fracs for x in (max(f - margin, 0.0), min(f + margin, 1.0))]
    aggs = [a for i, c in enumerate(cols) for a in (
        F.count(q(c).cast("double")).alias(f"_n{i}"), F.percentile_approx(q(c).cast("double"), ends, ACCURACY).alias(f"_e{i}"))]
    brackets = df.select(*[q(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[q(c) for c in cols if c not in keys],
                         *[q(k) for k in keys]).groupBy(*[f"_k{j}" for j in range(len(keys))]).agg(*aggs)
    rows = df.select(*[q(k).alias(f"_r{j}") for j, k in enumerate(keys)],
                     *[q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    if keys:
        brackets = cut_lineage(brackets)        # a row a key
        same = [F.col(f"_r{j}").eqNullSafe(F.col(f"_k{j}")) for j in range(len(keys))]
        rows = rows.join(brackets, reduce(lambda a, b: a & b, same))
    else:
        one = brackets.first()
        rows = rows.select("*", *[F.lit(one[f"_n{i}"]).alias(f"_n{i}") for i in range(len(cols))],
                           *[(F.array(*[F.lit(float(v)) for v in one[f"_e{i}"]]) if one[f"_e{i}"] is not None
                              else F.lit(None).cast("array<double>")).alias(f"_e{i}") for i in range(len(cols))])
    part = [f"_r{j}" for j in range(len(keys))]
    at = [(i, j) for i in range(len(cols)) for j in range(len(fracs))]
    low, high = (lambda i, j: F.col(f"_e{i}")[2 * j]), (lambda i, j: F.col(f"_e{i}")[2 * j + 1])
    below = rows.groupBy(*part).agg(*[F.sum((F.col(f"_x{i}") < low(i, j)).cast("long")).alias(f"b{i}_{j}") for i, j in at],
                                    *[F.first(f"_n{i}").alias(f"n{i}") for i in range(len(cols))])
    item = lambda i, j, *more: F.struct(F.lit(i).alias("c"), F.lit(j).alias("f"), *more)
    below = below.select(*[F.col(c).alias(f"_b{c}") for c in part], _rows([item(
        i, j, F.coalesce(F.col(f"b{i}_{j}"), F.lit(0)).alias("below"), F.col(f"n{i}").alias("n")) for i, j in at])).select(
        *[f"_b{c}" for c in part], F.col("r.c").alias("_c"), F.col("r.f").alias("_f"), "r.below", "r.n").where("n > 0")
    inside = rows.select(*part, F.explode(F.filter(F.array(*[item(i, j, F.when(
        (F.col(f"_x{i}") >= low(i, j)) & (F.col(f"_x{i}") <= high(i, j)), F.struct(F.col(f"_x{i}").alias("v"))).alias("x"))
        for i, j in at]), lambda r: r["x"].isNotNull())).alias("r")).select(*part, "r.c", "r.f", F.col("r.x.v").alias("v"))
    held = inside.groupBy(*part, "c", "f", "v").agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy(*part, "c", "f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("times").over(w))
    same = [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in part] + [F.col("c") == F.col("_c"), F.col("f") == F.col("_f")]
    frac = F.element_at(F.array(*[F.lit(f) for f in fracs]), F.col("f") + 1)
    pos = frac * (F.col("n") - 1)
    upto, start = F.col("below") + F.col("upto"), F.col("below") + F.col("upto") - F.col("times")
    holds = lambda rank: (start <= rank) & (rank < upto)
    g = held.join(below, reduce(lambda a, b: a & b, same)).groupBy(*part, "c", "f").agg(
        F.max(F.when(holds(F.floor(pos)), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil(pos)), F.col("v"))).alias("hi"),
        F.first(pos).alias("pos"), F.first(frac).alias("frac"))
    share = F.col("pos") - F.floor("pos")
    # equal neighbours return the value itself (an interpolated copy can be
    # 1 ulp off, which moves data points across bin edges)
    found = cut_lineage(g.select(
        *[F.col(c).alias(k) for c, k in zip(part, keys)], F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1).alias("feature"),
        "frac", F.when((share == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(
            F.col("lo") + (F.col("hi") - F.col("lo")) * share).alias("value")))
    n_held = [F.sum((F.col(f"_n{i}") > 0).cast("long")) for i in range(len(cols))]
    wanted = sum(x or 0 for x in brackets.agg(*n_held).first()) if keys else sum(one[f"_n{i}"] > 0 for i in range(len(cols)))
    missed = found.agg(F.count("value")).first()[0] < wanted * len(fracs)
    return _quantiles_by_counts(df, cols, fracs, keys) if missed else found


def _quantiles_by_counts(df: DataFrame, cols: Sequence[str], fracs: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """:func:`exact_quantiles` by running counts over all distinct values, for
    quantiles that the brackets miss."""
    keys = list(keys)
    long = df.select(*[q(k) for k in keys], _rows([F.struct(F.lit(c).alias("feature"),
                                                            q(c).cast("double").alias("v")) for c in cols])) \
        .select(*keys, "r.*").where(F.col("v").isNotNull())
    cnt = long.groupBy(*keys, "feature", "v").agg(F.count(F.lit(1)).alias("c"))
    rs = running_sums(cnt, "v", ["c"], keys=[*keys, "feature"], descending=False)
    fr = rs.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fracs])))
    pos = F.col("frac") * (F.col("tot_c") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    start = F.col("cum_c") - F.col("c")  # 0-based rank of this value's first copy
    picked = fr.where(((start <= lo) & (lo < F.col("cum_c"))) | ((start <= hi) & (hi < F.col("cum_c"))))
    g = picked.groupBy(*keys, "feature", "frac").agg(
        F.max(F.when((start <= lo) & (lo < F.col("cum_c")), F.col("v"))).alias("_lo"),
        F.max(F.when((start <= hi) & (hi < F.col("cum_c")), F.col("v"))).alias("_hi"),
        F.first(pos).alias("_pos"))
    w = F.col("_pos") - F.floor(F.col("_pos"))
    # equal neighbours return the value itself (an interpolated copy can be
    # 1 ulp off, which moves data points across bin edges)
    return g.select(*keys, "feature", "frac",
                    F.when((w == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(
                        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * w).alias("value"))
