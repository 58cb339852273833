"""Registered queries of this package: name -> callable and DuckDB text."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import prepare, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.token_counts import token_counts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_path()).drop("text")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.url_filters import filter_urls
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.secret_scans import BASE, scan_secrets, span_text
    docs = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *[of(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"),
                       span_text(F.col("spans")).alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.quality import fit, held_out, score
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.common import cut
    from strata.llm.simhash import hex_of, simhash_components, with_fingerprints
    marked = with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return simhash_components(cut(marked.select("doc_id", "_llm_fp")), max_bits=2).select(
        "doc_id", hex_of().alias("fingerprint"), "component_id")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.posting_lists import nearest
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.common import cut
    from strata.llm.mixing import mix_sources, sized
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix_sources(cut(docs.drop("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.rp_forest import link_vectors
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return link_vectors(rows).select("vec_id", "n_links", "component_id", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.suffix_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.conversations import damaged, digests, repair
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(rows))
    found = report.join(digests(repaired).withColumnRenamed("conv", "conv_"), F.col("conv").eqNullSafe(F.col("conv_")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm.suffix_tree_lm import score_texts
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), held)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from strata.llm.alignment import align_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokenizers(docs, tokenizer_path(), public_tokenizers.path(PIECES))[0]


_ALL = (op1_token_counts, op2_url_filters, op3_secret_scans, op4_quality, op5_simhash, op6_nearest, op7_mixing, op8_packing,
        op9_embedding_dedup, op10_suffix_dedup, op11_conversation_repair, op12_lm_scores, op13_tokenizer_alignment)


def _prepared(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _prepared(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from strata.llm import rp_forest, suffix_dedup, url_filters
    return {"op2_url_filters": url_filters.ORACLE, "op9_embedding_dedup": rp_forest.ORACLE,
            "op10_suffix_dedup": suffix_dedup.ORACLE}
