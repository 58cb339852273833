"""Registered queries for sources, sinks and the streaming path: each writes
a dataset derived from the given tables, reads it back through the
library's reader, and is checked against SQL over the original tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from strata.functions.clean import NULL_TOKENS
from strata.operators import cascade as C
from strata.operators import encode as EN
from strata.plans import q_cohort as QC
from strata.plans import q_scored as QS
from strata.plans.registry import register
from strata.sources import io as IO
from strata.sources.fixtures import SCORED_SQL, cohort_raw, oracle_cte, scored, table

_TOK = ", ".join("'" + t.replace("'", "''") + "'" for t in NULL_TOKENS)


def _nt(c):
    return f"CASE WHEN {c} IN ({_TOK}) THEN NULL ELSE {c} END"


TYPED_SQL = oracle_cte("cohort_raw") + (
    f"SELECT CAST(id AS BIGINT) AS id, {_nt('price_txt')} AS price_txt, {_nt('bal_txt')} AS bal_txt, "
    f"{_nt('segment')} AS segment, {_nt('priority_txt')} AS priority_txt, day_num, half_num, twin_num, signed_num, "
    f"const_num, CAST(grade AS BIGINT) AS grade, CAST(target AS BIGINT) AS target FROM cohort_raw")


@register("typed_load", TYPED_SQL, dbl=["day_num", "half_num", "twin_num", "signed_num", "const_num"],
          ops="S-1 S-3 S-10 S-4")
def typed_load(spark, sf):
    """CSV sink of the raw cohort, then the all-text read + load-time typing."""
    path = IO.write_cohort_csv(cohort_raw(spark, sf), os.path.join(IO.scratch_dir(spark, "cohort-csv"), "c.csv"))
    return IO.read_cohort(spark, path, typed=True)


@register("csv_roundtrip", oracle_cte("cohort_raw") + "SELECT id, " + ", ".join(
    _nt(c) + f" AS {c}" for c in ["price_txt", "bal_txt", "segment", "priority_txt"]) + " FROM cohort_raw",
    ops="S-1 S-10")
def csv_roundtrip(spark, sf):
    """Text columns survive a CSV round trip (spaces kept, null tokens -> null)."""
    raw = cohort_raw(spark, sf).select("id", "price_txt", "bal_txt", "segment", "priority_txt")
    path = IO.write_cohort_csv(raw, os.path.join(IO.scratch_dir(spark, "text-csv"), "t.csv"))
    df = IO.read_cohort(spark, path, typed=False)
    from strata.functions.clean import null_tokens_to_null
    return null_tokens_to_null(df).select(F.col("id").cast("string").alias("id"), "price_txt", "bal_txt",
                                          "segment", "priority_txt")


@register("csv_line_breaks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest "
          "FROM documents", ops="S-1")
def csv_line_breaks(spark, sf):
    """Whole texts, line breaks and quotes in them, through the CSV sink and
    the reader that puts records together from splits."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = IO.write_cohort_csv(docs, os.path.join(IO.scratch_dir(spark, "documents-csv"), "d.csv"))
    back = IO.read_cohort(spark, path, typed=False, multi_line=True)
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@register("report_roundtrip", oracle_cte("scored") + f", cp AS ({QS.CASCADE_PRED_SQL}) " + QS._agreement_sql(),
          dbl=["Percent_of_total", "Percent_within_GT"], ops="S-5 O-1 C-3")
def report_roundtrip(spark, sf):
    """Multi-sheet report (summary, agreement) written per sheet, read back."""
    pred = C.predictions(scored(spark, sf), "id", "y", "p1", "p2", 0.5)
    path = IO.scratch_dir(spark, "cascade-report")
    IO.write_report({"Summary": C.cascade_metrics(pred), "Agreement_Analysis": C.agreement(pred)}, path)
    return IO.read_report(spark, path, "Agreement_Analysis")


@register("mapping_json", QC.PIPE + "SELECT * FROM map", ops="S-6 W-4")
def mapping_json(spark, sf):
    mapping = EN.ordinal_mapping(QC._kept(spark, sf), QC.CATEGORICAL)
    path = IO.write_mapping(mapping, os.path.join(IO.scratch_dir(spark, "mapping"), "encoding_mappings.json"))
    return IO.read_mapping(spark, path)


def _artefact_sql():
    # the best-threshold oracle, renamed to the artefact's columns
    inner = oracle_cte("scored") + QS._best_threshold_sql("f1")
    return f"SELECT best_threshold AS threshold, metric FROM ({inner})"


@register("threshold_artefact", _artefact_sql(), dbl=["threshold"], ops="S-8 E-14")
def threshold_artefact(spark, sf):
    """E-14's chosen threshold saved beside a model folder and read back."""
    from strata.operators import calibrate as CA
    from strata.operators import thresholds as TH
    best = TH.best_threshold(scored(spark, sf), "y", "p1", "f1").first()
    folder = IO.scratch_dir(spark, "model")
    CA.save_threshold(spark, folder, best["best_threshold"], "f1")
    return spark.read.schema("threshold double, metric string").json(os.path.join(folder, "best_threshold"))


@register("cascade_stream", oracle_cte("scored") + QS.CASCADE_PRED_SQL, ops="C-1 C-5 C-6 streaming")
def cascade_stream(spark, sf):
    """The cascade as a Structured Streaming query over the orders files
    (file source, availableNow trigger, Parquet sink), read back as a table."""
    from strata.streaming.score_stream import stream_cascade
    orders = os.path.join(sf, "orders.parquet")
    schema = spark.read.parquet(orders).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    folder, glob = (orders, None) if os.path.isdir(orders) else (sf, "orders.parquet")
    out = stream_cascade(spark, folder, ddl, lambda raw: spark.sql(SCORED_SQL, orders=raw), glob=glob)
    return spark.read.parquet(out)
