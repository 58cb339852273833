"""Derived fixture views over the given tables (see FIXTURES.md part B).

The SQL text below is the single definition of each view: Spark runs it
through ``spark.sql`` with the base tables bound as DataFrame parameters
(no global temp views), and the DuckDB oracle embeds the same text as a
CTE.  Every view is a projection / join over whole base tables, so its
size grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# V1: dirty cohort typed as text (cleaning, profiling, encoding, imputation, training)
COHORT_RAW_SQL = """
SELECT cast(o_orderkey AS varchar(20)) AS id,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL
            WHEN o_orderkey % 11 = 0 THEN concat('<', cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)))
            WHEN o_orderkey % 13 = 0 THEN concat(' > ', cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)), ' ')
            WHEN o_orderkey % 17 = 0 THEN NULL
            ELSE cast(cast(floor(o_totalprice) AS bigint) AS varchar(20)) END AS price_txt,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL
            WHEN o_custkey % 9 = 0 THEN '<0.05'
            WHEN o_orderkey % 19 = 0 THEN 'n/a'
            WHEN o_orderkey % 23 = 0 THEN '<=5'
            ELSE cast(cast(floor(c_acctbal) AS bigint) AS varchar(20)) END AS bal_txt,
       CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       o_orderpriority AS priority_txt,
       CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE cast(dayofyear(o_orderdate) AS double) END AS day_num,
       CASE WHEN o_orderkey % 31 = 0 OR o_orderkey % 29 = 0 THEN NULL ELSE cast(o_custkey % 5 AS double) + 0.5 END AS half_num,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE cast(2 * floor(o_totalprice) + 1 AS double) END AS twin_num,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE c_acctbal END AS signed_num,
       cast(1.0 AS double) AS const_num,
       cast(least(5, greatest(0, floor(o_totalprice / 90000) + (o_orderkey % 3) - 1)) AS int) AS grade,
       CASE WHEN least(5, greatest(0, floor(o_totalprice / 90000) + (o_orderkey % 3) - 1)) >= 3 THEN 1 ELSE 0 END AS target
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# V2: given labels and two stage scores (metrics, bootstrap, thresholds, cascade)
SCORED_SQL = """
SELECT o_orderkey AS id,
       CASE WHEN o_totalprice + o_custkey * 100 > 300000 THEN 1 ELSE 0 END AS y,
       round(1.0 / (1.0 + exp(-(o_totalprice / 200000.0 - 1.0))), 2) AS p1,
       round(1.0 / (1.0 + exp(-((o_totalprice + o_custkey * 60) / 200000.0 - 1.5))), 2) AS p2,
       CASE WHEN o_orderpriority < '3' THEN 'a' ELSE 'b' END AS model
FROM {orders}
"""

# V3: a real imbalanced label over documents (training, class weights)
DOC_SCREEN_SQL = """
SELECT d.doc_id AS id, d.n_chars AS n_chars,
       length(d.text) - length(replace(d.text, ' ', '')) AS n_spaces,
       length(d.text) - length(replace(d.text, '.', '')) AS n_dots,
       l.quality AS quality, l.toxic AS y
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

VIEW_SQL = {
    "cohort_raw": (COHORT_RAW_SQL, ("orders", "customer")),
    "scored": (SCORED_SQL, ("orders",)),
    "doc_screen": (DOC_SCREEN_SQL, ("documents", "labels")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture view as a Spark DataFrame."""
    if name == "vectors":
        return table(spark, sf_dir, "embeddings")
    sql, bases = VIEW_SQL[name]
    frames = {b: table(spark, sf_dir, b) for b in bases}
    return spark.sql(sql, **frames)


def cohort_raw(spark, sf_dir):
    return view(spark, sf_dir, "cohort_raw")


def scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


def doc_screen(spark, sf_dir):
    return view(spark, sf_dir, "doc_screen")


def oracle_cte(*names: str) -> str:
    """``WITH`` clause defining the named views for the DuckDB oracle."""
    parts = []
    for n in names:
        sql, bases = VIEW_SQL[n]
        parts.append(f"{n} AS ({sql.format(**{b: b for b in bases}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
