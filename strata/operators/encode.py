"""Categorical encoding and scaling (F-7, W-4, J-2, S-6, F-16, F-17).

The mapping ``(column, value, code)`` is a DataFrame: distinct values per
categorical column (partial aggregation before the shuffle), numbered
1..N in code-point order.  Applying it is a left join per column; no
broadcast is forced: AQE measures the materialised mapping at run time and
turns the join into a broadcast join only when it is under the broadcast
threshold (a high-cardinality "categorical" stays a shuffle join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.clean import numeric_columns, q
from strata.functions.prefix import sorted_numbers
from strata.session import cut_lineage

#: columns that a wide one-hot table may get
WIDEST = 10_000


def ordinal_mapping(df: DataFrame, cols: Sequence[str], start_index: int = 1) -> DataFrame:
    """W-4: one row per (column, distinct non-null value) with its code."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, code int")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value"))
                                          for c in cols])).alias("r")).select("r.*")
    distinct = pairs.where(F.col("value").isNotNull()).distinct()
    return sorted_numbers(distinct, ["column"], "value", "code").withColumn(
        "code", (F.col("code") + F.lit(start_index - 1)).cast("int"))


def apply_mapping(df: DataFrame, mapping: DataFrame, cols: Sequence[str]) -> DataFrame:
    """J-2: replace each categorical value by its code (null stays null)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    out = df
    for c in cols:
        m = mapping.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(m, q(c).cast("string") == F.col(f"_v_{c}"), "left")
    return out.select(*[F.col(f"_c_{c}").alias(c) if c in cols else q(c) for c in df.columns])


def ordinal_encode(df: DataFrame, cols: Sequence[str], start_index: int = 1) -> tuple[DataFrame, DataFrame]:
    """F-7: codes 1..N by sorted value, original column positions kept."""
    mapping = ordinal_mapping(df, cols, start_index)
    return apply_mapping(df, mapping, cols), mapping


def one_hot(df: DataFrame, cols: Sequence[str], mapping: DataFrame | None = None) -> DataFrame:
    """F-16: ``<col>_<value>`` 0/1 columns for each categorical value.  A table
    can only have so many columns: beyond ``WIDEST`` levels use
    :func:`one_hot_vector`."""
    cols = [c for c in cols if c in df.columns]
    mapping = mapping if mapping is not None else ordinal_mapping(df, cols)
    rows = mapping.orderBy("column", "code").limit(WIDEST + 1).collect()
    if len(rows) > WIDEST:
        raise ValueError(f"over {WIDEST} levels: use one_hot_vector, whose result is one sparse column")
    levels = {}
    for r in rows:
        levels.setdefault(r["column"], []).append(r["value"])
    out = []
    for c in df.columns:
        if c in cols:
            out += [F.coalesce((q(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                    for v in levels.get(c, [])]
        else:
            out.append(q(c))
    return df.select(*out)


def one_hot_vector(df: DataFrame, cols: Sequence[str], out: str = "one_hot", mapping: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """F-16 for any number of levels: ``cols`` become one sparse vector column
    ``out`` (a null value has no entry), and the dictionary ``(index, column,
    value)`` says what each place stands for.  Codes come by join, so nothing
    but the number of levels of each column reaches the driver."""
    cols = [c for c in cols if c in df.columns]
    mapping = cut_lineage(mapping if mapping is not None else ordinal_mapping(df, cols))
    sizes = {r["column"]: r["n"] for r in mapping.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, n = {}, 0
    for c in cols:
        first[c], n = n, n + max(sizes.get(c, 0), 1)
    start = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(first[c]))])
    dictionary = mapping.select((start[F.col("column")] + F.col("code") - 1).cast("long").alias("index"), "column", "value")
    coded = apply_mapping(df.select("*", *[q(c).alias(f"_code_{i}") for i, c in enumerate(cols)]),
                          mapping.replace({c: f"_code_{i}" for i, c in enumerate(cols)}, subset=["column"]),
                          [f"_code_{i}" for i in range(len(cols))])

    # a null has the code behind the last one, which the encoder leaves out
    places = [F.coalesce(F.col(f"_code_{i}") - 1, F.lit(max(sizes.get(c, 0), 1))).cast("double").alias(
        f"_place_{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": max(sizes.get(c, 0), 1)}}) for i, c in enumerate(cols)]
    parts = [f"_part_{i}" for i in range(len(cols))]
    placed = coded.select(*[q(c) for c in df.columns if c not in cols], *places)
    encoder = OneHotEncoder(inputCols=[f"_place_{i}" for i in range(len(cols))], outputCols=parts, handleInvalid="keep").fit(placed)
    whole = VectorAssembler(inputCols=parts, outputCol=out).transform(encoder.transform(placed))
    return whole.select(*[q(c) for c in df.columns if c not in cols], out), dictionary


def level_frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """X-4 from sparse columns: (parent, value, share) of each level; a 0/1
    column of share f with coefficient b has the mean absolute linear SHAP
    value ``2 |b| f (1 - f)``."""
    n = df.count()
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("parent"), q(c).cast("string").alias("value")) for c in cols])).alias("r"))
    return pairs.select("r.*").where(F.col("value").isNotNull()).groupBy("parent", "value").agg(
        (F.count(F.lit(1)) / F.lit(max(n, 1))).alias("share"))


def _stats(df: DataFrame, cols: Sequence[str]):
    return df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                  *[F.min(q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                  *[F.max(q(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
# a constant column scales by 1: tested with min == max, never std == 0 (a
# merged std of a constant column can be ~1e-17 on multi-partition input)


def scale(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard",
          exclude: Sequence[str] = ()) -> DataFrame:
    """F-17: standard ((x-mean)/population std, scale 1 on zero variance) or
    min-max ((x-min)/(max-min), range 1 when constant); nulls stay null.
    One aggregation for all statistics, then one select."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    if not cols:
        return df
    st = _stats(df, cols)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(q(c))
            continue
        i = cols.index(c)
        if method == "standard":
            mu, sd = st[f"m{i}"], st[f"s{i}"]
            sd = sd if (sd and st[f"a{i}"] != st[f"b{i}"]) else 1.0
            out.append(((q(c) - F.lit(float(mu or 0.0))) / F.lit(float(sd))).alias(c))
        elif method == "minmax":
            lo, hi = st[f"a{i}"], st[f"b{i}"]
            rng = (hi - lo) if (hi is not None and lo is not None and hi != lo) else 1.0
            out.append(((q(c) - F.lit(float(lo if lo is not None else 0.0))) / F.lit(float(rng))).alias(c))
        else:
            raise ValueError(f"unknown scaling {method!r}")
    return df.select(*out)
