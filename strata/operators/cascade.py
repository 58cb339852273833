"""Two-stage hierarchical cascade (P-6..P-8, C-1..C-7).

Scoring and combining are narrow projections: one stage, no shuffle, and
they accept a streaming DataFrame unchanged.  Reports (metrics, agreement)
are single aggregation passes over the combined table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators import metrics as M


def derive_m1_target(grade: str = "grade", out: str = "y") -> Column:
    """P-6: any toxicity, grade > 0."""
    return (F.col(grade) > 0).cast("int").alias(out)


def derive_m2_cohort(df: DataFrame, grade: str = "grade", out: str = "y") -> DataFrame:
    """P-7: keep grade >= 1; severe (P-8) is the positive class."""
    return df.where(F.col(grade) >= 1).withColumn(out, final_label(grade, out))


def final_label(grade: str = "grade", out: str = "y") -> Column:
    """P-8: the cascade's ground truth, grade >= 3."""
    return (F.col(grade) >= 3).cast("int").alias(out)


def combine(df: DataFrame, p1: str = "p1", p2: str = "p2", threshold: float = 0.5) -> DataFrame:
    """C-1: M1 negative -> label 0 with M1's probability; otherwise M2's
    label and probability.  M2 is scored on every row (the agreement table
    needs it on M1 negatives too)."""
    pred1 = M.predict_label(p1, threshold)
    pred2 = M.predict_label(p2, threshold)
    return (df.withColumn("y_pred_m1", pred1).withColumn("y_pred_m2", pred2)
            .withColumn("y_pred", F.when(F.col("y_pred_m1") == 0, F.lit(0)).otherwise(F.col("y_pred_m2")))
            .withColumn("y_prob", F.when(F.col("y_pred_m1") == 0, F.col(p1)).otherwise(F.col(p2))))


def predictions(df: DataFrame, id_col: str = "id", y: str = "y", p1: str = "p1", p2: str = "p2",
                threshold: float = 0.5) -> DataFrame:
    """C-5: the cascade prediction table, all rows, both stages' scores."""
    c = combine(df, p1, p2, threshold)
    return c.select(
        F.col(id_col).alias("ID"), F.col(y).cast("int").alias("y_true"), "y_pred", "y_prob",
        F.col(p1).alias("y_prob_pred_m1"), "y_pred_m1", F.col(p2).alias("y_prob_pred_m2"), "y_pred_m2",
    )


def outcome(pred: DataFrame) -> DataFrame:
    """C-7: the patient-level outcome class from the two stage labels."""
    label = (F.when(F.col("y_pred_m1") == 0, F.lit("Grade 0"))
             .when(F.col("y_pred_m2") == 0, F.lit("Grade 1-2"))
             .otherwise(F.lit("Grade 3-5")))
    return pred.select("ID", label.alias("outcome"))


def cascade_metrics(pred: DataFrame, threshold: float = 0.5, n_bins: int = 5) -> DataFrame:
    """C-2 + C-4: metrics of the final probability (label = prob >= t),
    plus its ECE with the cascade's bin count."""
    thr = M.threshold_metrics(pred, "y_true", "y_prob", threshold, n_bins)
    rk = M.rank_metrics(pred, "y_true", "y_prob").select(
        F.col("AUROC").alias("ROC_AUC"), F.col("AUPRC").alias("PR_AUC"))
    out = M.join_on_keys(thr, rk, [])
    return out.select("Accuracy", "Precision", "Recall", "F1", "Specificity", "NPV", "PPV",
                      "ROC_AUC", "PR_AUC", "Brier", "TN", "FP", "FN", "TP", "ECE")


def cascade_ece(pred: DataFrame, n_bins: int = 5) -> DataFrame:
    """C-4: ECE of the final probability."""
    return M.ece(pred, "y_true", "y_prob", n_bins)


AGREEMENT_ROWS = [
    # fixed values: the agreement table's row labels, in the reference's order
    "GT=1 and M1=1 and M2=1",
    "GT=0 and M1=0 and M2=0",
    "GT=1 and models disagree",
    "GT=0 and models disagree",
    "GT=1 total",
    "GT=0 total",
    "Total samples",
]


def agreement(pred: DataFrame) -> DataFrame:
    """C-3: seven counts with percent of total and percent within the
    ground-truth class (rounded half-even to 4 places; null for the total
    row and for an empty class)."""
    y, m1, m2 = F.col("y_true"), F.col("y_pred_m1"), F.col("y_pred_m2")
    dis = m1 != m2

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    a = pred.agg(
        cnt((y == 1) & (m1 == 1) & (m2 == 1)).alias("c0"),
        cnt((y == 0) & (m1 == 0) & (m2 == 0)).alias("c1"),
        cnt((y == 1) & dis).alias("c2"),
        cnt((y == 0) & dis).alias("c3"),
        cnt(y == 1).alias("c4"),
        cnt(y == 0).alias("c5"),
        F.count(F.lit(1)).alias("c6"),
    )
    within = ["c4", "c5", "c4", "c5", "c4", "c5", None]
    pairs = []
    for i, label in enumerate(AGREEMENT_ROWS):
        den = F.col(within[i]) if within[i] else F.lit(None).cast("long")
        pairs.append(F.struct(
            F.lit(label).alias("Metric"), F.col(f"c{i}").alias("Count"),
            F.bround(F.col(f"c{i}") / F.col("c6"), 4).alias("Percent_of_total"),
            F.when(den > 0, F.bround(F.col(f"c{i}") / den, 4)).alias("Percent_within_GT"),
        ))
    return a.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def keyed_cascade(scores_m1: DataFrame, scores_m2: DataFrame, labels: DataFrame, id_col: str = "id",
                  threshold: float = 0.5) -> DataFrame:
    """J-1/J-3: stage scores persisted as separate tables are aligned by
    an inner equi-join on the id (both sides are cohort-sized, so this is a
    shuffle join co-partitioned on id; no broadcast)."""
    joined = labels.join(scores_m1, on=id_col, how="inner").join(scores_m2, on=id_col, how="inner")
    return predictions(joined, id_col=id_col, y="y", p1="p1", p2="p2", threshold=threshold)
