"""The corpus pipeline, stage by stage and as a whole, and every registered query of the package."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from strata.llm import quality
from strata.llm.queries import QUERIES

KEY = "q7Zx2Lw9Vb4Nt8Rk1Hs6Yd3Fg5Jm0Pc"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng, folder = random.Random(7), str(tmp_path_factory.mktemp("sf"))
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(words, k=60)) if i % 3 else "#$%& " * 30 + str(rng.random())
        docs.append((i, text + (f" {KEY}" if i % 10 == 1 else ""), "ab"[i % 2]))
    docs += [(200 + i, docs[i][1], "a") for i in (1, 2, 4)]
    df = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in docs], "doc_id long, text string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    df.select("doc_id", F.when(F.col("text").startswith("#"), 0).otherwise(1).alias("quality")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.example.org/p/{i}") for i in range(20)], "page_id long, url string") \
        .write.parquet(f"{folder}/pages.parquet")
    v = np.random.default_rng(1).normal(size=(300, 8))
    spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{folder}/embeddings.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}.") for c in range(25) for t in range(c % 7 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(CP.STAGES)
    net = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id: r.text for r in stage["quality_classifier"](spark, docs, sf).collect()}
    assert good == {i: t for i, t in text.items() if net.score(t) >= 0.5} and 0 < len(good) < len(text)
    some = docs.where(~F.col("text").startswith("#"))
    left = [r.text for r in stage["simhash_near_dedup"](spark, some, sf).collect()]
    assert sorted(left) == sorted({t for t in text.values() if not t.startswith("#")})
    clean = {r.doc_id: (r.text, r.n_chars) for r in stage["secret_scans"](spark, some, sf).collect()}
    want = {i: t.replace(KEY, "[SECRET]") for i, t in text.items() if not t.startswith("#")}
    assert clean == {i: (t, len(t)) for i, t in want.items()}
    mixed = stage["mixing"](spark, some, sf)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(text[r.doc_id].split())


def test_run_is_the_chain_of_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in CP.STAGES:
        docs = stage(spark, docs, sf)
    want, got = docs.collect(), CP.run(spark, sf).collect()
    assert got and Counter(map(str, got)) == Counter(map(str, want))


@pytest.mark.parametrize("name", list(QUERIES))
def test_every_query_gives_a_row_for_what_it_reads(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    reads = {"op2": 20, "op6": 3 * 10, "op9": 300, "op11": 25}
    assert len(rows) == reads.get(name.split("_")[0], 123) or name.startswith("op8")
    assert rows
