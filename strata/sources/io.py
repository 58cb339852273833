"""Readers and writers (S-1..S-10).

* ``read_cohort`` (S-1/S-2/S-3): by extension -- CSV (header, every column
  read as text, then S-10 typing), Parquet, JSON.  Excel is not a Spark
  source; it is rejected with the other unknown extensions.
* ``type_columns`` (S-10): reader-level null tokens become null; then ONE
  aggregation decides per text column whether every non-null token is an
  integer / a number, and one ``select`` applies the casts.
* ``write_snapshot`` (S-4), ``write_report`` (S-5: one dataset per sheet),
  ``write_mapping`` (S-6: JSON), ``read_report``.

Paths for artefacts default to folders under the session's checkpoint
directory, which on a cluster is the shared folder it names.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.clean import NULL_TOKENS, null_tokens_to_null, q, string_columns
from strata.session import ensure_checkpoint_dir
from strata.sources import csv_records

# fixed values: integer and general number tokens accepted at load time
INT_TOKEN = r"^\s*[-+]?\d+\s*$"
NUM_TOKEN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

SUPPORTED = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory (shared on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(spark), "artefacts", f"{name}-{uuid.uuid4().hex[:8]}")


def type_columns(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """S-10: a text column becomes bigint when every non-null token is an
    integer that fits, double when every non-null token is numeric (so is a
    column with a larger integer), else stays text;
    an all-null column stays text."""
    df = null_tokens_to_null(df, tokens)
    cols = string_columns(df)
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        present = q(c).isNotNull()
        aggs += [F.sum(present.cast("int")).alias(f"n{i}"),
                 F.sum((present & q(c).rlike(INT_TOKEN) & F.trim(q(c)).try_cast("long").isNotNull()).cast("int")).alias(f"i{i}"),
                 F.sum((present & q(c).rlike(NUM_TOKEN)).cast("int")).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            n, ni, nd = row[f"n{i}"] or 0, row[f"i{i}"] or 0, row[f"d{i}"] or 0
            if n > 0 and ni == n:
                out.append(F.trim(q(c)).cast("long").alias(c))
                continue
            if n > 0 and nd == n:
                out.append(F.trim(q(c)).cast("double").alias(c))
                continue
        out.append(q(c))
    return df.select(*out)


def read_cohort(spark: SparkSession, path: str, typed: bool = True, multi_line: bool = False) -> DataFrame:
    """S-1..S-3: read a cohort file by extension.  CSV quotes are doubled
    inside quoted cells; ``multi_line`` also reads line breaks inside them, a
    large file in many tasks (:mod:`strata.sources.csv_records`)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = SUPPORTED.get(ext)
    if fmt is None:
        raise ValueError(f"unsupported file type {ext!r}; use one of {sorted(SUPPORTED)}")
    if fmt == "csv":
        # every column as text (no inference pass), empty cells kept as ''
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
              .option("escape", '"').option("multiLine", multi_line)
              .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
        if multi_line:
            df = csv_records.read_csv(spark, path, df.columns)     # Spark has read the header only
        return type_columns(df) if typed else df
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path)


def write_cohort_csv(df: DataFrame, path: str) -> str:
    """CSV sink with a header (nulls written as empty cells)."""
    (df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_snapshot(df: DataFrame, path: str) -> str:
    """S-4: one Parquet dataset per intermediate artefact."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_report(sheets: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """S-5: a multi-sheet report as one dataset per sheet under ``path``."""
    out = {}
    for name, df in sheets.items():
        p = os.path.join(path, name)
        df.write.mode("overwrite").format(fmt).option("header", True).save(p)
        out[name] = p
    return out


def read_report(spark: SparkSession, path: str, sheet: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(os.path.join(path, sheet))


def write_mapping(mapping: DataFrame, path: str) -> str:
    """S-6: the category mapping (column, value, code) as JSON lines."""
    mapping.coalesce(1).write.mode("overwrite").json(path)
    return path


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column string, value string, code int").json(path)
