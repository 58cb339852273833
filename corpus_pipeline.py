"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all rows its predecessor kept.  All but the last return the
columns of ``documents``; ``run`` writes each result as Parquet in the shared
checkpoint folder and reads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import mixing, packing, quality, secret_scans, simhash
from strata.llm.common import prepare, table, work_path
from strata.llm.queries import tokenizer_path


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` counted anew where there is one."""
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
                        for c in docs.columns])


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  It learns from the labelled
    ones among ``docs`` that are not held out."""
    prepare(spark)
    net = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, net).filter("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: three-word shingles, at
    most two differing bits."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found replaced by a mark."""
    prepare(spark)
    return _like(docs, secret_scans.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time a document is taken."""
    prepare(spark)
    return _like(docs, mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their place in a sequence."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Neither the network nor the tokenizer can be stated in SQL; the tests hold
#: every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
