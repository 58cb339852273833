"""What a Python worker holds between and within the stages of op8 and op13."""

from types import SimpleNamespace

import pyarrow as pa
import pytest

pytest.importorskip("strata.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from strata.llm import alignment, bpe, packing  # noqa: E402


def test_last_alignment_stage_drops_the_tokenizers(monkeypatch):
    monkeypatch.setitem(alignment._LOADED, ("a", "b"), (object(), object()))
    assert list(alignment._sum_up(iter([]))) == []
    assert not alignment._LOADED


def test_blocks_give_the_memory_of_their_tables_back(monkeypatch):
    released = []
    monkeypatch.setattr(alignment.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(1)))
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(alignment, "BLOCK", 30)
    monkeypatch.setattr(alignment, "_block", lambda block, ids, kind, texts, a, b: (block, ids))
    rows = pa.RecordBatch.from_pydict({"id": list(range(5)), "text": ["x" * 20] * 5})
    assert list(alignment._blocks(lambda: (None, None))([rows])) == [(k, [k]) for k in range(5)]
    assert len(released) == 5


def test_packing_encodes_few_documents_at_once(spark):
    # an id for each text that is encoded together with this one
    encode = lambda: lambda texts: [b"\1\0\0\0" * len(texts)] * len(texts)
    docs = spark.range(1300).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = packing.pieces(docs, encode).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1300))
    assert max(r["length"] for r in got) <= packing.STEP_ROWS + 1


def test_forgotten_encoder_is_made_anew():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    first = bpe.encoder(spec)
    want = first.encode(["some words, some more"])
    bpe.forget()
    assert not bpe._ENCODERS
    assert bpe.encoder(spec) is not first and bpe.encoder(spec).encode(["some words, some more"]) == want
