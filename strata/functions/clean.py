"""Cleaning, retyping and row/column filters (F-1..F-14, P-1..P-5, P-9,
P-11, A-3, A-4, A-12).

The retyping of dirty text columns (F-1) is data-dependent: which columns
become numeric is decided by ONE aggregation over all string columns
(``max(rlike)`` per column, partial aggregation per task), the driver reads
that one-row result, and a single ``select`` applies the casts.  Nothing is
evaluated row-at-a-time in Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

# fixed values: the inequality pattern ("<a" / "> a" lab values) and the
# strict numeric-token guard used instead of a plain cast
INEQUALITY_RE = r"^\s*([<>])\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*$"
NUMERIC_RE = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# fixed values: tokens a CSV/Excel reader treats as missing by default
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def q(c: str) -> Column:
    """Column by name, safe for names with dots, spaces or symbols."""
    return F.col(f"`{c}`")


def strict_double(c: Column) -> Column:
    """F-5: text -> double only for plain numeric tokens, else null
    (``try_cast`` alone would also accept '1.0d' or '12f')."""
    return F.when(c.rlike(NUMERIC_RE), F.trim(c).try_cast("double"))


_WS = " \t\n\r\f\u000b"


def inequality_sign(c: Column) -> Column:
    """First non-blank character ('<' or '>' for a matched inequality)."""
    return F.substring(F.ltrim(c, F.lit(_WS)), 1, 1)


def parse_inequality(c: Column, eps: float) -> Column:
    """F-2: '<a' -> a - eps, '>a' -> a + eps; null when not an inequality.

    Only values whose first non-blank character is '<' or '>' reach the
    regex, and only pattern-validated numbers reach the cast (a failed cast
    is costly; most values are plain numbers)."""
    sign = inequality_sign(c)
    matched = sign.isin("<", ">") & c.rlike(INEQUALITY_RE)
    num = F.regexp_extract(c, INEQUALITY_RE, 2).cast("double")
    return F.when(matched, F.when(sign == "<", num - F.lit(float(eps))).otherwise(num + F.lit(float(eps))))


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """P-4: numeric columns minus exclusions."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


@dataclass
class RetypePlan:
    """Per-column outcome of F-1."""
    inequality: list[str] = field(default_factory=list)   # rule (a)
    numeric: list[str] = field(default_factory=list)      # rule (b), coerced
    text: list[str] = field(default_factory=list)         # left as text
    eps: dict[str, float] = field(default_factory=dict)


def plan_retype(df: DataFrame, eps: float = 0.1, eps_overrides: Mapping[str, float] | None = None,
                exclude: Sequence[str] = (), id_col: str | None = None) -> RetypePlan:
    """One aggregation pass: does any value match the inequality pattern /
    the numeric guard, per string column.  With ``id_col`` the same pass
    counts null ids, which are refused (a null id would otherwise count as
    present in the row-missingness rate)."""
    cols = string_columns(df, exclude)
    plan = RetypePlan()
    if not cols and id_col is None:
        return plan
    aggs = [F.sum(q(id_col).isNull().cast("int")).alias("_null_ids")] if id_col else []
    for i, c in enumerate(cols):
        aggs.append(F.max(q(c).rlike(INEQUALITY_RE).cast("int")).alias(f"m{i}"))
        aggs.append(F.max(q(c).rlike(NUMERIC_RE).cast("int")).alias(f"n{i}"))
    row = df.agg(*aggs).first()
    if id_col and (row["_null_ids"] or 0) > 0:
        raise ValueError(f"{row['_null_ids']} rows have a null {id_col!r}; ids must be present")
    overrides = dict(eps_overrides or {})
    for i, c in enumerate(cols):
        plan.eps[c] = float(overrides.get(c, eps))
        if row[f"m{i}"] == 1:
            plan.inequality.append(c)
        elif row[f"n{i}"] == 1:
            plan.numeric.append(c)
        else:
            plan.text.append(c)
    return plan


def apply_retype(df: DataFrame, plan: RetypePlan) -> DataFrame:
    """F-1 (one select): inequality columns -> +/-eps or numeric or null;
    numeric columns -> strict numeric or null; text columns unchanged."""
    out = []
    for c in df.columns:
        if c in plan.inequality:
            v = F.coalesce(parse_inequality(q(c), plan.eps[c]), strict_double(q(c)))
            out.append(v.alias(c))
        elif c in plan.numeric:
            out.append(strict_double(q(c)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def clean_inequalities(df: DataFrame, id_col: str, eps: float = 0.1,
                       eps_overrides: Mapping[str, float] | None = None,
                       exclude: Sequence[str] = ()) -> tuple[DataFrame, RetypePlan]:
    """F-1..F-6: id to text, then the whole-column retyping decision.
    The per-value pattern work is spread over all cores when the input
    arrives in fewer partitions (see :func:`strata.session.spread`)."""
    from strata.session import spread
    df = spread(df.withColumn(id_col, q(id_col).cast("string")), id_col)
    plan = plan_retype(df, eps, eps_overrides, exclude=[id_col, *exclude], id_col=id_col)
    return apply_retype(df, plan), plan


def quality_issues(raw: DataFrame, plan: RetypePlan, id_col: str) -> DataFrame:
    """F-3: one row per '<a' value that became negative after eps
    (id, feature, raw_value, value, issue)."""
    cols = plan.inequality
    if not cols:
        return raw.sparkSession.createDataFrame([], "id string, feature string, raw_value string, value double, issue string")
    stacked = raw.select(
        q(id_col).cast("string").alias("id"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), q(c).alias("raw_value"),
                                     parse_inequality(q(c), plan.eps[c]).alias("value")) for c in cols])).alias("r"),
    ).select("id", "r.*")
    return (stacked.where(F.col("value").isNotNull() & (inequality_sign(F.col("raw_value")) == "<"))
            .where(F.col("value") < 0)
            .withColumn("issue", F.lit("negative value after eps")))


def null_tokens_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """S-10: reader-level missing tokens become null in string columns."""
    return df.select(*[F.when(q(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(q(c)).alias(c)
                       if c in string_columns(df) else q(c) for c in df.columns])


# --------------------------------------------------------------------------
# P-5 / A-3 / A-4: missingness
# --------------------------------------------------------------------------
def missing_count(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    cols = list(cols or df.columns)
    total = F.lit(0)
    for c in cols:
        total = total + q(c).isNull().cast("int")
    return total


def row_missing_report(df: DataFrame, id_col: str) -> DataFrame:
    """A-3: patient_id, missing_count, missing_rate over ALL columns."""
    n = len(df.columns)
    mc = missing_count(df)
    return df.select(q(id_col).cast("string").alias("patient_id"), mc.cast("long").alias("missing_count"),
                     (mc / F.lit(float(n))).alias("missing_rate"))


def drop_high_row_missing(df: DataFrame, id_col: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """P-5: keep rows with missing rate strictly below ``threshold``;
    also return the dropped-rows report (sort it only for display)."""
    n = len(df.columns)
    rate = missing_count(df) / F.lit(float(n))
    kept = df.where(rate < F.lit(float(threshold)))
    dropped = row_missing_report(df, id_col).where(F.col("missing_rate") >= F.lit(float(threshold)))
    return kept, dropped


def column_missing_report(df: DataFrame) -> DataFrame:
    """A-4: feature, n_missing, missing_rate for every column (one pass)."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(q(c).isNull().cast("int")).alias(f"m{i}")
                                              for i, c in enumerate(df.columns)]
    a = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").cast("long").alias("n_missing"))
                               for i, c in enumerate(df.columns)]))
    return (a.select("_n", rows.alias("r")).select("r.*", "_n")
            .select("feature", "n_missing", (F.col("n_missing") / F.col("_n")).alias("missing_rate")))


# --------------------------------------------------------------------------
# P-1..P-3, P-11: projections
# --------------------------------------------------------------------------
def drop_features(df: DataFrame, cols: Sequence[str], enabled: bool = True) -> DataFrame:
    """P-1: drop configured features when enabled; unknown names ignored."""
    return df.drop(*cols) if enabled else df


def target_column(df: DataFrame, configured: str | None) -> str:
    """P-3: the configured target if present, else the last column."""
    return configured if configured and configured in df.columns else df.columns[-1]


def split_xy(df: DataFrame, id_col: str, target_col: str) -> tuple[DataFrame, list[str]]:
    """P-2: (id, features..., y int) with feature names; error if the id or
    target column is missing."""
    missing = [c for c in (id_col, target_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    feats = [c for c in df.columns if c not in (id_col, target_col)]
    return df.select(q(id_col), *[q(c) for c in feats], q(target_col).cast("int").alias("y")), feats


def order_columns(df: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """P-11: ID first, features, target last."""
    feats = [c for c in df.columns if c not in (id_col, target_col)]
    return df.select(q(id_col), *[q(c) for c in feats], q(target_col))


# --------------------------------------------------------------------------
# F-8..F-14: scalar transforms
# --------------------------------------------------------------------------
def round_half_even_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F-8: numpy-style half-to-even rounding to integers (bround, not round)."""
    cols = set(cols)
    return df.select(*[F.bround(q(c), 0).cast("long").alias(c) if c in cols else q(c) for c in df.columns])


def negative_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-12: feature, n_negative, min_value, neg_fraction for columns with
    negatives (one aggregation pass over all candidate columns)."""
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, n_negative long, min_value double, neg_fraction double")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.sum((q(c) < 0).cast("int")).alias(f"n{i}"), F.min(q(c)).alias(f"m{i}"),
                 F.count(q(c)).alias(f"c{i}")]
    a = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").cast("long").alias("n_negative"),
        F.col(f"m{i}").cast("double").alias("min_value"),
        F.when(F.col(f"c{i}") > 0, F.col(f"n{i}") / F.col(f"c{i}")).alias("neg_fraction"))
        for i, c in enumerate(cols)]))
    return a.select(rows.alias("r")).select("r.*").where(F.col("n_negative") > 0)


def apply_log1p(df: DataFrame, cols: Sequence[str], check: bool = True) -> DataFrame:
    """F-9 / F-10: log1p on ``cols``; with ``check`` a negative value in any
    of them raises (strict mode) after one aggregation pass."""
    if check and cols:
        neg = negative_report(df, cols).select("feature").collect()
        if neg:
            raise ValueError(f"negative values in columns selected for log1p: {[r[0] for r in neg]}")
    cols = set(cols)
    return df.select(*[F.log1p(q(c)).alias(c) if c in cols else q(c) for c in df.columns])


def sigmoid(z: Column) -> Column:
    """F-11."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """F-12: clip to [lo, hi] (either bound optional); null stays null
    (Spark's greatest/least skip nulls, so guard explicitly)."""
    orig = c
    if lo is not None:
        c = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        c = F.least(c, F.lit(float(hi)))
    return F.when(orig.isNotNull(), c)


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F-13: ``<c>_was_missing`` 0/1 for every feature."""
    return df.select(*[q(c) for c in df.columns],
                     *[q(c).isNull().cast("int").alias(f"{c}_was_missing") for c in cols])


def rescale_for_display(df: DataFrame, target_col: str, max_norm: float = 10.0,
                        exclude: Sequence[str] = ()) -> DataFrame:
    """P-9: numeric non-target columns with max > max_norm become
    ``max_norm*(x-min)/(max-min)`` renamed ``"<c> *"`` (unchanged when
    max = min).  One aggregation for all min/max, then one select."""
    cols = numeric_columns(df, exclude=[target_col, *exclude])
    if not cols:
        return df
    row = df.agg(*[F.min(q(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(q(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            if hi is not None and hi > max_norm and hi != lo:
                out.append((F.lit(float(max_norm)) * (q(c) - F.lit(float(lo))) / F.lit(float(hi - lo))).alias(f"{c} *"))
                continue
        out.append(q(c))
    return df.select(*out)
