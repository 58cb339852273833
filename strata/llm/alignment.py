"""Alignment of two tokenizers over the bytes of the same texts.

Both tokenizers' tokens cover a text's bytes, so every overlap of an A and a B
token is one range between two neighbouring token ends of either.  In a task,
Arrow does the work for many documents at once: lists of ids are flattened with
their parent indices, byte lengths become ends by sums segmented by document,
and as the ends of either kind ascend by (document, end), merging both gives
each range the next A and B token.  ``Table.group_by`` counts the linked id
pairs of a block; Spark adds the counts up over all blocks and tells each block
the sums of its own pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bpe
from strata.llm.blocks import pack, parts_for, unpack
from strata.llm.common import cut, prepare, work_path

BLOCK = 4 << 20       # bytes of texts in a block
STEP = 1 << 20        # bytes of texts that Arrow aligns at once
MAX_KEPT = 400_000    # words whose pieces a worker keeps; beyond, it starts anew
LONG = 60             # characters; longer words are not kept

_WORDS = re.compile(r" *[^ ]+| +\Z")
_LOADED: dict[tuple, tuple] = {}


class _Entries:
    """The bytes of a vocabulary's tokens, their lengths, and the ids' decimals."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = pa.array(tokens, pa.binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.decimals = pa.array([str(i) for i in range(len(tokens))], pa.string())


class _Bytes:
    """Token ids of byte-level BPE and the bytes of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.encoder = bpe.Encoder(f.read())
        tok = self.encoder.tok
        tok.encode_special_tokens = True      # their strings are plain text
        self.encoder.special = []
        back = {c: b for b, c in bpe._byte_letters().items()}
        entries: list[bytes] = [b""] * tok.get_vocab_size()
        for s, i in tok.get_vocab().items():
            entries[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.entries = _Entries(entries)

    def ids(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode([" " + t if t else "" for t in texts])


class _Pieces(dict):
    """Piece ids of the sentencepiece model and the bytes of each.  Where no
    piece has a space mark behind another character, merges never cross the
    start of a word, so words are encoded once each and kept."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.entries = _Entries([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                                 for i, p in enumerate(pieces)])

    def learn(self, words: Iterable[str]) -> None:
        """Keeps the ids of words, which the library gives in one call."""
        # it puts one space before a word itself, but none into an empty text
        words = [w for w in words if w]
        self[""] = _u32([self.model.piece_to_id("▁")])[0]
        self.update(zip(words, _u32(*self.model.encode(words, num_threads=1))))

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return _u32(*self.model.encode(texts, num_threads=1))
        words = [_words(t) if t else [] for t in texts]
        used = set().union(*words)
        new = used.difference(self)
        if len(self) + len(new) > MAX_KEPT:
            self.clear()
            new = used
        self.learn(new)
        out = [b"".join(map(self.__getitem__, w)) for w in words]
        if len(self) > MAX_KEPT:
            self.clear()
        else:
            for w in new:
                if len(w) > LONG:
                    del self[w]
        return out


def _words(text: str) -> list[str]:
    """The words of a text, each without the space before it; spaces beyond
    one stay at the word that follows, or are a word of their own at the end."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in _WORDS.findall(" " + text)]
    return text.split(" ")


def _u32(*lists: list[int]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    data = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    ends = list(accumulate((4 * len(x) for x in lists), initial=0))
    return [data[i:j] for i, j in pairwise(ends)]


def _tokenizers(a: str, b: str):
    """The worker's tokenizers, loaded once."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a, b) not in _LOADED:
        _LOADED.clear()
        _LOADED[a, b] = _Bytes(a), _Pieces(b)
    return _LOADED[a, b]


def _lists(ids: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def _ends(lists: pa.Array, entries: _Entries):
    """Document, id and end (bytes of the document up to it) of each token."""
    doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    ids = lists.flatten()
    run = np.cumsum(entries.lengths[ids.to_numpy()])
    # segmented: less the sum before the document's first token
    return doc, ids, run - np.concatenate([[0], run])[lists.offsets.to_numpy()[:-1]][doc]


def _same_bytes(lists: pa.Array, entries: _Entries, texts: list[bytes]) -> np.ndarray:
    """For each document, whether its tokens' bytes are its text's."""
    ids = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(entries.lengths[ids.to_numpy()])])[lists.offsets.to_numpy()]
    data = entries.bytes.take(ids).buffers()[2]
    got = data.to_pybytes()[:int(ends[-1])] if data is not None else b""
    want = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    if (ends == want).all() and got == b"".join(texts):
        return np.ones(len(texts), bool)
    return np.array([got[i:j] == t for i, j, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts)], bool)


def _joined(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """The strings between two ends, joined."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), by)


def align(texts: list[str], a, b) -> dict:
    """Tokens, groups and links of some documents.  ``links`` has a row for
    each link: its document and both ids; documents without tokens have none."""
    bytes_ = [(" " + t).encode() if t else b"" for t in texts]
    la, lb = _lists(a.ids(texts)), _lists(b.ids(texts))
    good = _same_bytes(la, a.entries, bytes_) & _same_bytes(lb, b.entries, bytes_)
    if not good.all():
        none = pa.array([], la.type.value_type)
        la, lb = (pa.array([x.values if g else none for x, g in zip(some, good)], some.type) for some in (la, lb))
    (doc_a, id_a, end_a), (doc_b, id_b, end_b) = _ends(la, a.entries), _ends(lb, b.entries)
    # document and byte of each end; both sequences ascend, so merging takes one pass
    keys = [(doc << 40) + end for doc, end in ((doc_a, end_a), (doc_b, end_b))]
    order = np.argsort(np.concatenate(keys), kind="stable")
    merged, of_a = np.concatenate(keys)[order], order < len(keys[0])
    final = np.concatenate([merged[1:] != merged[:-1], np.ones(min(1, len(merged)), bool)])    # of equal ends the last
    both = np.concatenate([[False], merged[1:] == merged[:-1]])[:len(merged)][final]
    upto_a, in_b = np.cumsum(of_a)[final], ~of_a[final]
    upto_b = np.flatnonzero(final) + 1 - upto_a
    doc = merged[final] >> 40
    # the range up to an end of one kind lies in the next token of the other
    links = pa.table({"doc": doc, "a": id_a.take(pa.array(upto_a - (both | ~in_b))), "b": id_b.take(pa.array(upto_b - in_b))})

    group_doc = doc[both]
    strings = [_joined(of.entries.decimals.take(ids), upto[both], ",") for of, ids, upto in ((a, id_a, upto_a), (b, id_b, upto_b))]
    groups = pc.binary_join_element_wise(*strings, "|")
    n_groups = np.bincount(group_doc, minlength=len(texts))
    whole = _joined(groups, np.cumsum(n_groups), ";").to_pylist()
    return {"n_a": np.diff(la.offsets.to_numpy()), "n_b": np.diff(lb.offsets.to_numpy()), "n_groups": n_groups,
            "n_links": np.bincount(doc, minlength=len(texts)),
            "groups_sha256": [hashlib.sha256(w.encode()).hexdigest() if n else "" for w, n in zip(whole, n_groups)],
            "links": links}


def _steps(texts: list[str], size: int) -> Iterator[slice]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _block(block: int, ids: list, id_type, texts: list[str], a, b) -> pa.RecordBatch:
    """One row: the documents' figures, the distinct id pairs with their
    counts, and the pair of every link."""
    per_doc: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    tables = []
    for part in _steps(texts, STEP):
        out = align(texts[part], a, b)
        for k, v in per_doc.items():
            v += list(out[k]) if k == "groups_sha256" else out[k].tolist()
        tables.append(out["links"].select(["a", "b"]))
    links = pa.concat_tables(tables)
    pair = pc.add(pc.shift_left(pc.cast(links["a"], pa.int64()), pa.scalar(32, pa.int64())), pc.cast(links["b"], pa.int64()))
    counts = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by([("pair_count", "descending")])
    which = pc.index_in(pair, counts["pair"].combine_chunks()).combine_chunks()     # frequent pairs get small numbers
    pairs = counts["pair"].to_numpy()
    row = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type))]
    row += [pa.array([per_doc[k]], pa.list_(pa.int64())) for k in ("n_a", "n_b", "n_groups", "n_links")]
    row += [pa.array([per_doc["groups_sha256"]], pa.list_(pa.string())),
            pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.arange(len(pairs))), pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF),
                 counts["pair_count"].combine_chunks()], ["k", "a", "b", "n"])),
            pa.array([pack(which.to_numpy().astype(np.int64))], pa.binary())]
    return pa.RecordBatch.from_arrays(row, ["block", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "which"])


def _blocks(load: Callable) -> Callable:
    """Rows (id, text) -> blocks of at most ``BLOCK`` bytes of text, or of one
    longer text."""
    def run(batches):
        a, b = load()
        part, k = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                if size and size + len(t) > BLOCK:
                    yield _block(part + k, ids, batch.schema.field(0).type, texts, a, b)
                    ids, texts, size, k = [], [], 0, k + 1
                    pa.default_memory_pool().release_unused()   # the aligned tables
                ids.append(i)
                texts.append(t)
                size += len(t) + 1
        if texts:
            yield _block(part + k, ids, batch.schema.field(0).type, texts, a, b)
        pa.default_memory_pool().release_unused()
    return run


def _sum_up(batches):
    """Adds the counts of each document's links up."""
    _LOADED.clear()     # the worker may have aligned before; nothing is encoded here
    for batch in batches:
        for i in range(batch.num_rows):
            told = batch.column("told")[i].values
            n = 0 if told is None else len(told)
            count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if n:
                k = told.field("k").to_numpy()
                count[k], best[k] = told.field("count").to_numpy(), told.field("best").to_numpy()
            of = unpack(batch.column("which")[i].as_py(), "<i8")
            links = batch.column("n_links")[i].values.to_numpy()
            at = np.concatenate([[0], np.cumsum(links)])
            cols = [batch.column(c)[i].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links")]
            for some in (best, count):
                run = np.concatenate([[0], np.cumsum(some[of])])
                cols.append(pa.array(run[at[1:]] - run[at[:-1]]))
            yield pa.RecordBatch.from_arrays([*cols, batch.column("groups_sha256")[i].values], OUT)


OUT = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id"
                     ) -> tuple[DataFrame, DataFrame]:
    """How the tokens of a byte-level BPE (A, a file of ``tokenizers``) and of
    a sentencepiece model (B) lie over each text with a space before it.

    First result, a row per input row: ``id``, ``n_a``, ``n_b`` (tokens),
    ``n_groups`` (cut where both end), ``n_links`` (overlapping pairs of
    tokens), ``n_best`` (links whose id pair is the most frequent one of its B
    id, ties included), ``count_sum`` (over links, the corpus-wide count of the
    id pair) and ``groups_sha256``.  Second result: ``(a, b, count, best)`` per
    id pair of the corpus.

    Null and empty texts, and texts whose tokens' bytes are not the text's, have
    zeros and an empty digest.  Rows that share an id, or have none, are texts
    of their own and repeated rows count each.  Only the id and the text are
    read, so other columns cannot clash.  An empty table gives empty results.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = (f"block long, ids array<{kind}>, {lists}, groups_sha256 array<string>, "
              "pairs array<struct<k: long, a: long, b: long, n: long>>, which binary")
    folder = work_path(spark, "alignment")
    docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _blocks(lambda: _tokenizers(a_path, b_path)), schema).write.parquet(folder)
    blocks = spark.read.schema(schema).parquet(folder)

    asked = blocks.select("block", F.inline("pairs"))
    counts = cut(asked.groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy(F.col("b").alias("b_")).agg(F.max("count").alias("most"))
    pairs = counts.join(most, F.col("b") == F.col("b_")).select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    n_parts = parts_for(docs, text_col, BLOCK)
    told = asked.select("block", "k", F.col("a").alias("a_"), F.col("b").alias("b_")).join(
        pairs, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).repartition(n_parts, "block").groupBy(F.col("block").alias("block_")).agg(
        F.collect_list(F.struct("k", "count", F.col("best").cast("long").alias("best"))).alias("told"))
    out = blocks.drop("pairs").repartition(n_parts, "block").join(told, F.col("block") == F.col("block_"), "left").drop("block_").mapInArrow(
        _sum_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col), pairs
