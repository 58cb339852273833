"""T1: tiny literal fixtures, one per exact-semantics item."""

import math

import pytest
from pyspark.sql import functions as F

from strata.functions import clean as CL
from strata.functions.prefix import running_sums
from strata.operators import metrics as M
from strata.operators import profile as PR
from strata.operators import thresholds as TH
from strata.operators.impute import median_fill
from strata.operators.train import t975


def test_ece_zero_outside_bins_but_calibration_first_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.5), (1, 1.0)], "y int, p double")
    ece = M.ece(df, "y", "p", n_bins=2).first()["ECE"]
    # p=0 is in no ECE bin; bins (0,.5] -> |.5-1|, (.5,1] -> |1-1|; weights 1/3
    assert ece == pytest.approx(1 / 3 * 0.5)
    cal = {r["bin"]: r["n"] for r in M.calibration_curve(df, "y", "p", 2).collect()}
    assert cal == {0: 2, 1: 1}  # p=0 counts in the first calibration bin


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-1.5,)], "x double")
    out = [r[0] for r in CL.round_half_even_int(df, ["x"]).collect()]
    assert out == [0, 2, 2, -2]


def test_skew4(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert PR.skewness(df).first()["skewness"] == pytest.approx(1.763632614803888, rel=1e-12)


def test_skew_constant_and_small(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, None)], "c double, s double")
    got = {r["feature"]: r["skewness"] for r in PR.skewness(df).collect()}
    assert got["c"] == 0.0 and got["s"] is None


def test_median4(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,), (None,)], "x double")
    vals = [r[0] for r in median_fill(df, ["x"]).collect()]
    assert vals[-1] == 6.0


def test_pairwise_and_constant_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (10.0, 7.0, 1.0)],
                               "a double, b double, c double")
    m = {(r[0], r[1]): r[2] for r in PR.corr_matrix(df, digits=16).collect()}
    assert m[("a", "b")] == pytest.approx(0.9108967638407169, rel=1e-12)
    assert m[("a", "c")] is None  # constant column: null, no exception


def test_coerce_tokens(spark):
    vals = ["1.0d", "12f", "1,000", "", ".5", "5.", "1e5", " 12 "]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(CL.strict_double(F.col("s"))).collect()]
    assert got == [None, None, None, None, 0.5, 5.0, 100000.0, 12.0]


def test_inequality_rules(spark):
    df = spark.createDataFrame([("1", "<5", "a"), ("2", "> 60 ", "b"), ("3", "<=5", "c"), ("4", "7", "d"),
                                ("5", "oops", "e")], "id string, lab string, txt string")
    out, plan = CL.clean_inequalities(df, "id", eps=0.1)
    assert plan.inequality == ["lab"] and plan.text == ["txt"]
    got = [r["lab"] for r in out.orderBy("id").collect()]
    assert got == [4.9, 60.1, None, 7.0, None]


def test_majority_text_numeric_column(spark):
    # rule (b): one parseable value makes the column numeric; the rest -> null
    df = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "4")], "id string, v string")
    out, plan = CL.clean_inequalities(df, "id")
    assert plan.numeric == ["v"]
    assert [r["v"] for r in out.orderBy("id").collect()] == [None, None, 4.0]


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "y int, p double")
    assert M.pr_points(df, "y", "p").count() == 0
    r = M.rank_metrics(df, "y", "p").first()
    assert r["AUROC"] is None and r["AUPRC"] is None
    from strata.operators.train import _weights
    with pytest.raises(ValueError):
        _weights(df, "y", final=True)


def test_auc_ap_ties_against_bruteforce(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (1, 0.5), (0, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, p double")
    r = M.rank_metrics(df, "y", "p").first()
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert r["AUROC"] == pytest.approx(auc)
    # step-sum AP over distinct thresholds
    ths = sorted({p for _, p in rows}, reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        rec = tp / len(pos)
        ap += (rec - prev_r) * tp / (tp + fp)
        prev_r = rec
    assert r["AUPRC"] == pytest.approx(ap)


def test_two_phase_prefix_equals_one_phase(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.rand(3) * 1000).alias("p"),
                                  (F.col("id") % 3).alias("c"))
    g = df.groupBy("k", "p").agg(F.sum("c").alias("c"))
    a = running_sums(g, "p", ["c"], keys=["k"])
    b = running_sums(g, "p", ["c"], keys=["k"], n_buckets=16)
    ja = {(r["k"], r["p"]): (r["cum_c"], r["tot_c"]) for r in a.collect()}
    jb = {(r["k"], r["p"]): (r["cum_c"], r["tot_c"]) for r in b.collect()}
    assert ja == jb


def test_threshold_grid_matches_direct(spark):
    rows = [(1, 0.31), (0, 0.45), (1, 0.7), (0, 0.69), (1, 0.5), (0, 0.2)]
    df = spark.createDataFrame(rows, "y int, p double")
    grid = {round(r["threshold"], 2): r for r in TH.threshold_grid(df, "y", "p").collect()}
    for t in (0.3, 0.45, 0.5, 0.7):
        tp = sum(1 for y, p in rows if y == 1 and p >= t)
        fp = sum(1 for y, p in rows if y == 0 and p >= t)
        assert (grid[t]["TP"], grid[t]["FP"]) == (tp, fp)


def test_t_quantiles_by_integration():
    def cdf(t, v):  # Simpson integration of the Student t density
        c = math.gamma((v + 1) / 2) / (math.sqrt(v * math.pi) * math.gamma(v / 2))
        n, h = 4000, t / 4000
        s = sum((1 if i in (0, n) else (4 if i % 2 else 2)) * c * (1 + (i * h) ** 2 / v) ** (-(v + 1) / 2)
                for i in range(n + 1))
        return 0.5 + s * h / 3
    for v in (1, 4, 9, 29):
        assert cdf(t975(v), v) == pytest.approx(0.975, abs=1e-7)


def test_rank_metrics_two_phase_path_identical(spark):
    df = spark.range(4000).select((F.col("id") % 2).cast("int").alias("y"),
                                  F.round(F.rand(11), 3).alias("p"), (F.col("id") % 3).alias("k"))
    a = {r["k"]: (r["AUROC"], r["AUPRC"]) for r in M.rank_metrics(df, "y", "p", keys=["k"]).collect()}
    b = {r["k"]: (r["AUROC"], r["AUPRC"]) for r in M.rank_metrics(df, "y", "p", keys=["k"], n_buckets=8).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == pytest.approx(b[k][0], rel=1e-12) and a[k][1] == pytest.approx(b[k][1], rel=1e-12)


def test_null_id_refused(spark):
    df = spark.createDataFrame([("1", "<5"), (None, "7")], "id string, lab string")
    with pytest.raises(ValueError):
        CL.clean_inequalities(df, "id")


def test_exact_quantiles_distributed_equal_percentile(spark):
    df = spark.range(3000).select(F.round(F.rand(5) * 50, 1).alias("a"),
                                  F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 17).alias("b"),
                                  (F.col("id") % 3).alias("k"))
    fr = [0.01, 0.25, 0.5, 0.99]
    got = {(r["k"], r["feature"], r["frac"]): r["value"] for r in PR.exact_quantiles(df, ["a", "b"], fr, ["k"]).collect()}
    ref = df.groupBy("k").agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(f) for f in fr])).alias(c)
                                for c in ("a", "b")]).collect()
    for r in ref:
        for c in ("a", "b"):
            for f, v in zip(fr, r[c]):
                assert got[(r["k"], c, f)] == pytest.approx(v, rel=1e-12, abs=1e-12)
    two = {(r["k"], r["feature"], r["frac"]): r["value"] for r in
           PR.exact_quantiles(df.repartition(4), ["a"], [0.5], ["k"]).collect()}
    assert all(two[key] == pytest.approx(got[key]) for key in two)
    assert median_fill(df.select("b"), ["b"], exact="distributed").agg(F.max("b")).first()[0] is not None


def test_thresholds_of_any_step():
    from strata.operators.thresholds import _grid
    assert _grid(0.3, 0.7, 0.01) == (list(range(30, 71)), 100)
    assert _grid(0.3, 0.31, 0.005) == ([300, 305, 310], 1000)
    assert _grid(0.305, 0.35, 0.015) == ([305, 320, 335, 350], 1000)


def test_t_quantile_beyond_thirty_degrees():
    assert t975(30) == pytest.approx(2.0422724563012373, abs=1e-9)
    assert t975(31) == pytest.approx(2.0395134463964077, abs=1e-9)


def test_ordinary_tables_that_used_to_fail(spark, tmp_path):
    from strata.operators import explain, folds, impute, profile
    from strata.sources import io
    path = tmp_path / "c.csv"
    path.write_text('id,a,b\n1,"a ""big"" one",99999999999999999999\n2,x,5\n')
    df = io.read_cohort(spark, str(path))
    assert df.collect()[0].a == 'a "big" one' and dict(df.dtypes)["b"] == "double"
    rows = spark.createDataFrame([(i, float(i), None if i % 5 == 0 else 2.0 * i, None) for i in range(40)],
                                 "id long, a double, b double, c double")
    done = impute.mice_impute(rows, "id", ["a", "b", "c"], max_iter=2)
    assert done.filter("b is null").count() == 0
    full = rows.select("id", "a")
    assert impute.forest_impute(full, "id", ["a"], max_iter=1, num_trees=2).count() == 40
    with pytest.raises(ValueError, match="8 rows"):
        folds.stratified_folds(rows.withColumn("y", (rows.b > 9).cast("int")), "y", "id")
    t = spark.createDataFrame([(1, 1.0), (None, 5.0)], "t int, x double")
    assert [r.t for r in profile.by_target(t, "t").collect()] == [1]
    r = spark.createDataFrame([("segment_A", 1.0), ("segment_x_B", 2.0)], "feature string, mean_abs_shap double")
    assert {x.feature: x.mean_abs_shap for x in explain.group_parents(r, ["segment", "segment_x"]).collect()} == {
        "segment": 1.0, "segment_x": 2.0}


@pytest.mark.parametrize("n_buckets", [None, 1, 2, 5])
def test_running_sums_keep_null_and_nan(spark, n_buckets):
    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, 0.0, 0.25, 0.5, 0.75, 1.0]
    rows = [(k, v, i + 1) for k in ("a", None) for i, v in enumerate(values)] + [("only null", None, 3), ("only nan", nan, 4)]
    g = spark.createDataFrame(rows, "k string, p double, c long").repartition(3)
    place = lambda v: (v is not None, v is not None and v != v, 0.0 if v is None or v != v else v)
    for descending in (True, False):
        want = {}
        for k in {r[0] for r in rows}:
            mine, run = sorted([r for r in rows if r[0] == k], key=lambda r: place(r[1]), reverse=descending), 0
            for _, v, c in mine:
                run += c
                want[k, place(v)] = (run, sum(r[2] for r in mine))
        got = running_sums(g, "p", ["c"], keys=["k"], descending=descending, n_buckets=n_buckets).collect()
        assert len(got) == len(rows)
        assert {(r["k"], place(r["p"])): (r["cum_c"], r["tot_c"]) for r in got} == want


def test_quantiles_and_rank_metrics_of_many_buckets_with_null_and_nan(spark, monkeypatch):
    from strata.functions import prefix
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 10)
    nan = float("nan")
    df = spark.createDataFrame([(i % 2, None if i % 10 == 0 else nan if i % 10 == 1 else i / 100.0) for i in range(300)],
                               "y int, x double")
    got = {r["frac"]: r["value"] for r in PR.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()}
    kept = sorted(i / 100.0 for i in range(300) if i % 10 > 1)
    assert got[0.0] == kept[0] and got[0.5] == (kept[134] + kept[135]) / 2 and got[1.0] != got[1.0]
    row = M.rank_metrics(df, "y", "x").first()
    assert (row["n_pos"], row["n_neg"]) == (150, 150)


def test_describe_columns_of_every_type(spark):
    df = spark.sql("SELECT * FROM VALUES (true, DATE'2024-01-02', TIMESTAMP'2024-01-02 03:04:05', X'FF', array(1, 2)), "
                   "(true, DATE'2024-01-01', NULL, X'FE', array(1, 2)), (false, DATE'2024-01-02', NULL, X'FE', NULL) AS t(b, d, t, x, a)")
    got = {r["feature"]: (r["count"], r["unique"], r["top"], r["freq"]) for r in PR.describe_all(df).collect()}
    assert got == {"b": (3, 2, "true", 2), "d": (3, 2, "2024-01-02", 2), "t": (1, 1, "2024-01-02 03:04:05", 1),
                   "x": (3, 2, "FE", 2), "a": (2, 1, "[1, 2]", 2)}
    both = PR.describe_all(df.selectExpr("1.5 AS n", "d")).collect()
    assert sorted(r["feature"] for r in both) == ["d", "n"]


def test_parent_columns(spark):
    from strata.operators.explain import parent_columns
    df = spark.createDataFrame([("seg_A",), ("SEG=B",), ("seg_x_C",), ("age",)], "feature string")
    got = {tuple(r) for r in parent_columns(df, ["seg", "seg_x"]).collect()}
    assert got == {("seg", "seg_A"), ("seg", "SEG=B"), ("seg_x", "seg_x_C")}
