"""Registered queries over the ``cohort_raw`` view: cleaning, missingness,
encoding, scaling and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions import clean as CL
from strata.operators import encode as EN
from strata.operators import profile as PR
from strata.operators.cascade import derive_m2_cohort
from strata.plans.registry import register
from strata.session import cut_lineage
from strata.sources.fixtures import cohort_raw, oracle_cte

# cohort configuration (the reference's preprocessing config, on this view)
ID, TARGET = "id", "target"
CATEGORICAL = ["segment"]
EPS = 0.1
DROP_MISSING = 0.5
CORR_THRESHOLD = 0.9
LOG_EXCLUDE = ["signed_num", "bal_txt"]
RAW_COLS = ["id", "price_txt", "bal_txt", "segment", "priority_txt", "day_num", "half_num", "twin_num",
            "signed_num", "const_num", "grade", "target"]
RAW_NUM = ["day_num", "half_num", "twin_num", "signed_num", "const_num", "grade", "target"]
# after F-1 on this view: the two inequality columns become numeric
CLEAN_NUM = ["price_txt", "bal_txt", "day_num", "half_num", "twin_num", "signed_num", "const_num", "grade", "target"]
ENC_NUM = ["price_txt", "bal_txt", "segment", "day_num", "half_num", "twin_num", "signed_num", "const_num",
           "grade", "target"]
ENC_FEATS = [c for c in ENC_NUM if c != TARGET]

W = oracle_cte("cohort_raw")


# ------------------------------------------------------------------ pipeline
# The cleaned and the encoded cohort are materialised once (reliable
# checkpoints, like the snapshots the preparation job writes), so the
# several small aggregations a report needs read them instead of re-deriving
# the cohort from the raw files each time.
def _clean(spark, sf):
    cleaned, plan = CL.clean_inequalities(cohort_raw(spark, sf), ID, EPS)
    return cut_lineage(cleaned), plan


def _kept(spark, sf):
    cleaned, _ = _clean(spark, sf)
    kept, _ = CL.drop_high_row_missing(cleaned, ID, DROP_MISSING)
    return kept


def _encoded(spark, sf):
    enc, _ = EN.ordinal_encode(_kept(spark, sf), CATEGORICAL)
    return cut_lineage(enc)


# ------------------------------------------------------------------- SQL
INEQ = CL.INEQUALITY_RE
NUM = CL.NUMERIC_RE


def _sql_ineq(c):
    return (f"COALESCE(CASE regexp_extract({c}, '{INEQ}', 1) "
            f"WHEN '<' THEN TRY_CAST(regexp_extract({c}, '{INEQ}', 2) AS DOUBLE) - {EPS!r} "
            f"WHEN '>' THEN TRY_CAST(regexp_extract({c}, '{INEQ}', 2) AS DOUBLE) + {EPS!r} END, "
            f"CASE WHEN regexp_matches({c}, '{NUM}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)")


CLEAN_SQL = (f"SELECT id, {_sql_ineq('price_txt')} AS price_txt, {_sql_ineq('bal_txt')} AS bal_txt, segment, "
             f"priority_txt, day_num, half_num, twin_num, signed_num, const_num, grade, target FROM cohort_raw")
NULLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in RAW_COLS)
KEPT_SQL = f"SELECT * FROM cleaned WHERE CAST({NULLS} AS DOUBLE) / {len(RAW_COLS)} < {DROP_MISSING!r}"
MAP_SQL = ("SELECT 'segment' AS \"column\", value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code "
           "FROM (SELECT DISTINCT segment AS value FROM kept WHERE segment IS NOT NULL)")
ENC_SQL = ("SELECT k.id, k.price_txt, k.bal_txt, m.code AS segment, k.priority_txt, k.day_num, k.half_num, "
           "k.twin_num, k.signed_num, k.const_num, k.grade, k.target FROM kept k LEFT JOIN map m ON k.segment = m.value")
PIPE = W + f", cleaned AS ({CLEAN_SQL}), kept AS ({KEPT_SQL}), map AS ({MAP_SQL}), enc AS ({ENC_SQL}) "


# ---------------------------------------------------------- cleaning group
@register("clean_inequalities", PIPE + "SELECT * FROM cleaned", ops="F-1 F-2 F-4 F-5 F-6 S-10")
def clean_inequalities(spark, sf):
    return _clean(spark, sf)[0]


@register("quality_issues", PIPE + " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, {c} AS raw_value, "
    f"TRY_CAST(regexp_extract({c}, '{INEQ}', 2) AS DOUBLE) - {EPS!r} AS value, 'negative value after eps' AS issue "
    f"FROM cohort_raw WHERE regexp_extract({c}, '{INEQ}', 1) = '<' "
    f"AND TRY_CAST(regexp_extract({c}, '{INEQ}', 2) AS DOUBLE) - {EPS!r} < 0" for c in ("price_txt", "bal_txt")),
    dbl=["value"], ops="F-3")
def quality_issues(spark, sf):
    raw = cohort_raw(spark, sf)
    _, plan = _clean(spark, sf)
    return CL.quality_issues(raw, plan, ID)


@register("row_missing", PIPE + f"SELECT id AS patient_id, CAST({NULLS} AS BIGINT) AS missing_count, "
          f"CAST({NULLS} AS DOUBLE) / {len(RAW_COLS)} AS missing_rate FROM cleaned", dbl=["missing_rate"], ops="A-3")
def row_missing(spark, sf):
    return CL.row_missing_report(_clean(spark, sf)[0], ID)


@register("drop_high_missing", PIPE + "SELECT * FROM kept", ops="P-5")
def drop_high_missing(spark, sf):
    return _kept(spark, sf)


@register("dropped_rows", PIPE + f"SELECT * FROM (SELECT id AS patient_id, CAST({NULLS} AS BIGINT) AS missing_count, "
          f"CAST({NULLS} AS DOUBLE) / {len(RAW_COLS)} AS missing_rate FROM cleaned) WHERE missing_rate >= {DROP_MISSING!r}",
          dbl=["missing_rate"], ops="P-5 A-3 O-1")
def dropped_rows(spark, sf):
    cleaned, _ = _clean(spark, sf)
    return CL.drop_high_row_missing(cleaned, ID, DROP_MISSING)[1]


@register("column_missing", PIPE + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, "
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*) AS missing_rate FROM cleaned" for c in RAW_COLS),
    dbl=["missing_rate"], ops="A-4")
def column_missing(spark, sf):
    return CL.column_missing_report(_clean(spark, sf)[0])


# ----------------------------------------------------------- projections
DROP_LIST = ["priority_txt", "const_num", "not_a_column"]


@register("drop_features", W + "SELECT " + ", ".join(c for c in RAW_COLS if c not in DROP_LIST) + " FROM cohort_raw",
          ops="P-1")
def drop_features(spark, sf):
    return CL.drop_features(cohort_raw(spark, sf), DROP_LIST, enabled=True)


@register("split_xy", PIPE + "SELECT id, " + ", ".join(c for c in RAW_COLS if c not in (ID, TARGET))
          + ", CAST(target AS INTEGER) AS y FROM kept", ops="P-2 P-3")
def split_xy(spark, sf):
    kept = _kept(spark, sf)
    return CL.split_xy(kept, ID, CL.target_column(kept, TARGET))[0]


_REVERSED = [c for c in reversed(RAW_COLS) if c not in (ID, TARGET)]


@register("order_columns", W + "SELECT " + ", ".join(f"{c} AS c{i:02d}" for i, c in enumerate([ID, *_REVERSED, TARGET]))
          + " FROM cohort_raw", ops="P-11")
def order_columns(spark, sf):
    """Columns named by their place, so that the order shows in the values."""
    raw = cohort_raw(spark, sf).select(*RAW_COLS)
    shuffled = raw.select(TARGET, *[c for c in reversed(raw.columns) if c != TARGET])
    out = CL.order_columns(shuffled, ID, TARGET)
    return out.toDF(*[f"c{i:02d}" for i in range(len(out.columns))])


# ---------------------------------------------------------------- encoding
@register("encoding_map", PIPE + "SELECT * FROM map", ops="W-4 S-6")
def encoding_map(spark, sf):
    return EN.ordinal_mapping(_kept(spark, sf), CATEGORICAL)


@register("ordinal_encode", PIPE + "SELECT * FROM enc", ops="F-7 J-2 W-4")
def ordinal_encode(spark, sf):
    return _encoded(spark, sf)


@register("one_hot", PIPE + "SELECT id, " + ", ".join(
    f"CAST(COALESCE(CAST(segment = '{v}' AS INTEGER), 0) AS INTEGER) AS \"segment_{v}\""
    for v in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM kept", ops="F-16")
def one_hot(spark, sf):
    kept = _kept(spark, sf)
    out = EN.one_hot(kept, CATEGORICAL)
    return out.select(ID, *[c for c in out.columns if c.startswith("segment_")])


def _scale_sql(method):
    cols = ENC_FEATS
    if method == "standard":
        stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
        exprs = ", ".join(f"({c} - COALESCE(m_{c}, 0.0)) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END) AS {c}"
                          for c in cols)
    else:
        stats = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in cols)
        exprs = ", ".join(f"({c} - COALESCE(a_{c}, 0.0)) / (CASE WHEN b_{c} IS NULL OR b_{c} = a_{c} THEN 1.0 "
                          f"ELSE b_{c} - a_{c} END) AS {c}" for c in cols)
    return PIPE + f"SELECT id, {exprs} FROM enc, (SELECT {stats} FROM enc)"


@register("scale_standard", _scale_sql("standard"), dbl=ENC_FEATS, ops="F-17")
def scale_standard(spark, sf):
    return EN.scale(_encoded(spark, sf), ENC_FEATS, "standard").select(ID, *ENC_FEATS)


@register("scale_minmax", _scale_sql("minmax"), dbl=ENC_FEATS, ops="F-17")
def scale_minmax(spark, sf):
    return EN.scale(_encoded(spark, sf), ENC_FEATS, "minmax").select(ID, *ENC_FEATS)


# ------------------------------------------------------- scalar transforms
@register("round_half_even", PIPE + "SELECT id, CAST(round_even(half_num, 0) AS BIGINT) AS half_num, "
          "CAST(round_even(grade, 0) AS BIGINT) AS grade FROM cleaned", ops="F-8 F-14")
def round_half_even(spark, sf):
    return CL.round_half_even_int(_clean(spark, sf)[0], ["half_num", "grade"]).select(ID, "half_num", "grade")


LOG_COLS = [c for c in ENC_FEATS if c not in LOG_EXCLUDE]


@register("log1p_features", PIPE + "SELECT id, " + ", ".join(f"ln(1 + {c}) AS {c}" for c in LOG_COLS) + " FROM enc",
          dbl=LOG_COLS, ops="F-9 F-10 P-4")
def log1p_features(spark, sf):
    enc = _encoded(spark, sf)
    cols = CL.numeric_columns(enc, [ID, TARGET, *LOG_EXCLUDE])
    return CL.apply_log1p(enc, cols, check=True).select(ID, *cols)


@register("negative_report", PIPE + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative, "
    f"CAST(min({c}) AS DOUBLE) AS min_value, sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) / count({c}) AS neg_fraction FROM enc"
    for c in ENC_FEATS) + ") WHERE n_negative > 0", dbl=["min_value", "neg_fraction"], ops="A-12")
def negative_report(spark, sf):
    return CL.negative_report(_encoded(spark, sf), ENC_FEATS)


def _rescale_sql():
    stats = ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in ENC_FEATS)
    sel = []
    for c in ["id", "price_txt", "bal_txt", "segment", "priority_txt", "day_num", "half_num", "twin_num",
              "signed_num", "const_num", "grade", "target"]:
        if c in ENC_FEATS:
            sel.append(f"CASE WHEN b_{c} > 10 AND b_{c} <> a_{c} THEN 10.0 * ({c} - a_{c}) / (b_{c} - a_{c}) END AS \"{c} *\"")
            sel.append(f"CASE WHEN NOT (b_{c} > 10 AND b_{c} <> a_{c}) THEN {c} END AS \"{c}\"")
        else:
            sel.append(c)
    return PIPE + f"SELECT {', '.join(sel)} FROM enc, (SELECT {stats} FROM enc)"


RESCALED = ["price_txt", "bal_txt", "day_num", "twin_num", "signed_num"]


@register("rescale_display", PIPE + "SELECT id, " + ", ".join(
    f"10.0 * ({c} - a_{c}) / (b_{c} - a_{c}) AS \"{c} *\"" for c in RESCALED) + " FROM enc, (SELECT " + ", ".join(
    f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in RESCALED) + " FROM enc)",
    dbl=[f"{c} *" for c in RESCALED], ops="P-9")
def rescale_display(spark, sf):
    out = CL.rescale_for_display(_encoded(spark, sf), TARGET, 10.0, exclude=[ID])
    return out.select(ID, *[c for c in out.columns if c.endswith(" *")])


# ---------------------------------------------------------------- profiling
@register("overview", W + "SELECT column_name, position, dtype, n_rows FROM (VALUES " + ", ".join(
    f"('{c}', {i}, '{t}')" for i, (c, t) in enumerate(zip(RAW_COLS, ["string"] * 5 + ["double"] * 5 + ["int", "int"])))
    + ") v(column_name, position, dtype), (SELECT count(*) AS n_rows FROM cohort_raw)", ops="A-1")
def overview(spark, sf):
    return PR.overview(cohort_raw(spark, sf))


def _describe_sql():
    parts = []
    for c in RAW_NUM:
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, "
            f"CAST(NULL AS BIGINT) AS freq, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, "
            f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, "
            f"CAST(max({c}) AS DOUBLE) AS max FROM cohort_raw")
    for c in ["id", "price_txt", "bal_txt", "segment", "priority_txt"]:
        parts.append(
            f"SELECT '{c}', CAST(sum(cnt) AS BIGINT), count(*), min(CASE WHEN cnt = mx THEN v END), CAST(max(cnt) AS BIGINT), "
            f"NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT v, cnt, max(cnt) OVER () AS mx FROM "
            f"(SELECT {c} AS v, count(*) AS cnt FROM cohort_raw WHERE {c} IS NOT NULL GROUP BY {c}))")
    return W + " UNION ALL ".join(parts)


@register("describe_all", _describe_sql(), dbl=["mean", "std", "min", "q25", "q50", "q75", "max"], ops="A-2")
def describe_all(spark, sf):
    return PR.describe_all(cohort_raw(spark, sf))


PROF_FEATS = ENC_FEATS  # prepared table, target excluded, id is text


@register("skewness", PIPE + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN count({c}) < 3 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0.0 "
    f"ELSE skewness(CAST({c} AS DOUBLE)) END AS skewness FROM enc" for c in PROF_FEATS),
    dbl=["skewness"], ops="A-8")
def skewness(spark, sf):
    return PR.skewness(_encoded(spark, sf), exclude=[TARGET])


@register("outliers", PIPE + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, lo AS q1, hi AS q99, CAST(sum(CASE WHEN x < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_low_outliers, "
    f"CAST(sum(CASE WHEN x > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_high_outliers, count(x) AS n_total, "
    f"sum(CASE WHEN x < lo THEN 1 ELSE 0 END) / count(x) AS pct_low_outliers, "
    f"sum(CASE WHEN x > hi THEN 1 ELSE 0 END) / count(x) AS pct_high_outliers "
    f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM enc), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) AS lo, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS hi FROM enc) GROUP BY lo, hi" for c in PROF_FEATS),
    dbl=["q1", "q99", "pct_low_outliers", "pct_high_outliers"], ops="A-9")
def outliers(spark, sf):
    return PR.outliers_percentile(_encoded(spark, sf), exclude=[TARGET])


@register("by_target", PIPE + " UNION ALL ".join(
    f"SELECT target, '{c}' AS feature, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, stddev_samp(CAST({c} AS DOUBLE)) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM enc GROUP BY target" for c in PROF_FEATS),
    dbl=["mean", "median", "std", "min", "max"], ops="A-10")
def by_target(spark, sf):
    return PR.by_target(_encoded(spark, sf), TARGET)


@register("category_by_target", W + "SELECT segment, target, count(*) AS n FROM cohort_raw GROUP BY segment, target",
          ops="A-11")
def category_by_target(spark, sf):
    return PR.category_by_target(cohort_raw(spark, sf), "segment", TARGET)


@register("violin_summary", PIPE + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM enc" for c in PROF_FEATS),
    dbl=["min", "q25", "q50", "q75", "max"], ops="A-14")
def violin_summary(spark, sf):
    return PR.violin_summary(_encoded(spark, sf), exclude=[TARGET])


@register("violin_density", PIPE + "SELECT feature, bin, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(least(floor((CAST({c} AS DOUBLE) - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 20), 19) AS INTEGER) AS bin "
    f"FROM enc, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM enc) WHERE {c} IS NOT NULL"
    for c in PROF_FEATS) + ") GROUP BY feature, bin", ops="A-14")
def violin_density(spark, sf):
    return PR.violin_density(_encoded(spark, sf), exclude=[TARGET], n_bins=20)


def _pearson_sql(a, b):
    return (f"CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END) * "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END) = 0 THEN NULL ELSE "
            f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / (stddev_pop(CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END) * "
            f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END)) END")


CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS Feature_1, '{b}' AS Feature_2, round_even({_pearson_sql(a, b)}, 3) AS Correlation FROM cohort_raw"
    for a in RAW_NUM for b in RAW_NUM)


@register("corr_matrix", W + CORR_SQL, dbl=["Correlation"], ops="A-5 J-5")
def corr_matrix(spark, sf):
    return PR.corr_matrix(cohort_raw(spark, sf), "pearson")


PAIR_COLS = ["price_txt", "bal_txt", "day_num", "half_num", "twin_num", "signed_num", "grade"]


@register("corr_pairs", PIPE + " UNION ALL ".join(
    f"SELECT '{a}' AS Feature_1, '{b}' AS Feature_2, Correlation FROM (SELECT abs(round_even({_pearson_sql(a, b)}, 3)) AS Correlation "
    f"FROM enc) WHERE Correlation >= {CORR_THRESHOLD!r}" for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]),
    dbl=["Correlation"], ops="A-6 A-7")
def corr_pairs(spark, sf):
    """On the cleaned cohort, where a price and its double are correlated."""
    enc = _encoded(spark, sf).select(*PAIR_COLS)
    return PR.correlated_pairs(PR.corr_matrix(enc, "pearson"), PAIR_COLS, CORR_THRESHOLD)


@register("one_hot_dictionary", PIPE + "SELECT CAST(code - 1 AS BIGINT) AS \"index\", \"column\", value, "
          "CAST((SELECT count(*) FROM kept WHERE segment = value) AS BIGINT) AS n FROM map", ops="F-16 W-4")
def one_hot_dictionary(spark, sf):
    """The sparse one-hot vectors summed up by place, with the dictionary."""
    from pyspark.ml.functions import vector_to_array
    vectors, names = EN.one_hot_vector(_kept(spark, sf).select(ID, *CATEGORICAL), CATEGORICAL)
    sums = vectors.select(F.posexplode(vector_to_array("one_hot")).alias("at", "v")).groupBy("at").agg(
        F.sum("v").cast("long").alias("n"))
    return names.join(sums, F.col("index") == F.col("at")).select("index", "column", "value", "n")


def _spearman_sql():
    parts = []
    for i, a in enumerate(RAW_NUM):
        for b in RAW_NUM[i:]:
            ranked = (f"SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) AS ra, "
                      f"(rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) AS rb FROM "
                      f"(SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM cohort_raw "
                      f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
            r = (f"CASE WHEN stddev_pop(ra) * stddev_pop(rb) = 0 THEN NULL ELSE covar_pop(ra, rb) / "
                 f"(stddev_pop(ra) * stddev_pop(rb)) END")
            parts.append(f"SELECT '{a}' AS Feature_1, '{b}' AS Feature_2, round_even({r}, 3) AS Correlation FROM ({ranked})")
            if a != b:
                parts.append(f"SELECT '{b}', '{a}', round_even({r}, 3) FROM ({ranked})")
    return W + " UNION ALL ".join(parts)


@register("corr_spearman", _spearman_sql(), dbl=["Correlation"], ops="A-5 W-3")
def corr_spearman(spark, sf):
    return PR.corr_matrix(cohort_raw(spark, sf), "spearman")


# -------------------------------------------------- targets and weights
@register("derive_m1", W + "SELECT id, grade, CAST(grade > 0 AS INTEGER) AS y FROM cohort_raw", ops="P-6")
def derive_m1(spark, sf):
    from strata.operators.cascade import derive_m1_target
    return cohort_raw(spark, sf).select(ID, "grade", derive_m1_target("grade", "y"))


@register("derive_m2", W + "SELECT id, grade, CAST(grade >= 3 AS INTEGER) AS y FROM cohort_raw WHERE grade >= 1",
          ops="P-7 P-8")
def derive_m2(spark, sf):
    return derive_m2_cohort(cohort_raw(spark, sf).select(ID, "grade"), "grade", "y")


@register("class_weights", W + "SELECT n_neg, n_pos, n_neg / greatest(n_pos, 1) AS scale_pos_weight FROM ("
          "SELECT CAST(sum(CASE WHEN grade = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg, "
          "CAST(sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM cohort_raw)",
          dbl=["scale_pos_weight"], ops="A-13 M-2")
def class_weights(spark, sf):
    from strata.operators.cascade import derive_m1_target
    return PR.class_counts(cohort_raw(spark, sf).select(derive_m1_target("grade", "y")), "y")


# -------------------------------------------------------- simple imputation
IMP_FEATS = [c for c in ENC_FEATS]


@register("impute_median", PIPE + "SELECT id, " + ", ".join(f"COALESCE({c}, med_{c}) AS {c}" for c in IMP_FEATS)
          + ", target FROM enc, (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in IMP_FEATS)
          + " FROM enc)", dbl=IMP_FEATS, ops="I-1 J-4 J-8")
def impute_median(spark, sf):
    from strata.operators.impute import median_fill
    enc = _encoded(spark, sf)
    return median_fill(enc.select(ID, *IMP_FEATS, TARGET), IMP_FEATS)


@register("missing_indicator", PIPE + "SELECT id, " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {c}_was_missing" for c in IMP_FEATS) + " FROM enc", ops="F-13")
def missing_indicator(spark, sf):
    enc = _encoded(spark, sf)
    out = CL.missing_indicators(enc, IMP_FEATS)
    return out.select(ID, *[f"{c}_was_missing" for c in IMP_FEATS])
