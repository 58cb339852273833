"""Token counts through a digest cache.

Each text's SHA-256 and the SHA-256 of the tokenizer file are joined to a
stored table of counts; only distinct texts that the table lacks are encoded,
and their counts are appended to it.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bpe
from strata.llm.common import keep_columns, prepare, text_of, work_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def _stored(spark, cache: str, version: str) -> DataFrame:
    """Counts of this tokenizer version; one row per digest, since two jobs
    may have appended the same text."""
    try:
        df = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], CACHE_SCHEMA)
    return (df.filter(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str | None = None,
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (``n_tokens > limit``) to every row.

    ``cache`` is the folder of the stored counts (default: a new one); it
    grows by the distinct texts that it lacked.  Normalised content is the
    text itself with null as empty: any stronger normalisation would change
    counts.  Null and empty texts have 0 tokens; repeated rows stay; rows
    come in no order; an input column named like an output is replaced; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or work_path(spark, "token-cache")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    version = hashlib.sha256(spec.encode()).hexdigest()
    new = ["n_bytes", "n_tokens", "over_limit"]
    text = text_of(text_col)
    digest = F.unhex(F.sha2(text, 256))

    texts = docs.select(digest.alias("digest"), text.alias("text"))
    # one text per digest (map-side combined: copies leave a task once), then
    # only those that the cache lacks reach the encoder
    misses = (texts.groupBy("digest").agg(F.first("text").alias("text"))
              .join(_stored(spark, cache, version).select("digest"), "digest", "left_anti"))

    def count(batches):
        import pandas as pd
        enc = bpe.encoder(spec)
        for b in batches:
            n = [len(ids) // 4 for ids in enc.encode(b["text"].tolist())]
            yield pd.DataFrame({"tokenizer": version, "digest": b["digest"], "n_tokens": n})

    misses.mapInPandas(count, CACHE_SCHEMA).write.mode("append").parquet(cache)

    # unique digests, cut so that the join sees two plain inputs (a text that
    # a third of the rows share is then split by the adaptive skew join)
    known = _stored(spark, cache, version).withColumnRenamed("digest", "_llm_d").checkpoint()
    rows = docs.select(*keep_columns(docs, new), F.octet_length(text).cast("long").alias("n_bytes"),
                       digest.alias("_llm_digest"))
    return (rows.join(known, F.col("_llm_digest") == F.col("_llm_d"), "left")
            .withColumn("over_limit", F.col("n_tokens") > limit)
            .select(*[c for c in rows.columns if c != "_llm_digest"], "n_tokens", "over_limit"))
