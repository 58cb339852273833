"""A probabilistic suffix tree over words, learned from a corpus and used to
score texts.

The tree holds contexts of 0 to ``depth`` words.  A context is counted if it
occurs ``min_count`` times in the training texts, and is kept if its next
words diverge from those of the context one word shorter (which must be kept
itself): the sum over its occurrences of the log ratio between its own smoothed
probability, the occurrence left out, and the shorter one's must reach
``min_gain``.  A word's probability comes from the longest kept suffix of its
history; distributions are smoothed by the next shorter context,
``(n + strength * shorter) / (N + strength)``, down to single words.

Spark holds the documents as blocks of word numbers.  Counts of all n-grams
and the sums of the divergence test are added up over all blocks by ``blocks``;
nothing that is gathered has a cap.  The sums are integers (log ratios in units
of ``1 / UNIT``), so the tree does not depend on how documents lie in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from strata.llm.blocks import ODD, answered, ask, kept_by_block, mixed, pack, parts_for, sums_of, unpack
from strata.llm.common import prepare, work_path

BLOCK = 4 << 20        # bytes of texts in a block
KEYS = 1 << 21         # tokens for each bucket of keys
UNIT = 1 << 20
END = 0                # stands for the end of a text; no word has this number
ADD = 0.1              # added to each count of a single word


def _words(text: pa.Array):
    """Lower-cased words of all texts in a row and how many each text has."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    lists = pc.ascii_split_whitespace(t)
    flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(some).as_py():
        flat, of = flat.filter(some), of[some.to_numpy(zero_copy_only=False)]
    return flat, np.bincount(of, minlength=len(text))


def _block(text: pa.Array):
    """Vocabulary (64-bit hashes), word numbers and the end of each text."""
    flat, n = _words(text)
    d = flat.dictionary_encode()
    vocab = np.array([END] + [xxh3_64_intdigest(w) or 1 for w in d.dictionary.to_pylist()], np.uint64)
    ends = np.cumsum(n + 1)
    codes = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = False
    codes[inside] = d.indices.to_numpy().astype(np.int64) + 1
    # frequent words get small numbers, which pack better
    times = np.bincount(codes, minlength=len(vocab))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return vocab[order], rank[codes], ends


def _cut_blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows (id, held, text) -> blocks of at most ``BLOCK`` bytes of text, or
    of one longer text."""
    part, k = TaskContext.get().partitionId(), 0
    held_back: list[pa.RecordBatch] = []

    def emit(some):
        nonlocal k
        t = pa.Table.from_batches(some).combine_chunks()
        vocab, codes, ends = _block(t.column(2).combine_chunks() if t.num_rows else t.column(2))
        held = t.column(1).to_numpy()
        train = np.repeat(~held, np.diff(ends, prepend=0))
        row = [pa.array([(part << 32) + k], pa.int64()), pa.array([t.column(0).to_pylist()], pa.list_(t.schema.field(0).type)),
               pa.array([np.packbits(held).tobytes()], pa.binary()), pa.array([pack(ends)], pa.binary()),
               pa.array([pack(vocab)], pa.binary()), pa.array([pack(codes)], pa.binary()),
               pa.array([len(codes)], pa.int64()), pa.array([int(train.sum())], pa.int64())]
        k += 1
        return pa.RecordBatch.from_arrays(row, ["block", "ids", "held", "ends", "vocab", "codes", "n", "n_train"])

    size = 0
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy()
        start = 0
        for i, x in enumerate(length.tolist()):
            if size and size + x > BLOCK:
                held_back.append(b.slice(start, i - start))
                yield emit(held_back)
                held_back, start, size = [], i, 0
            size += x + 1
        held_back.append(b.slice(start))
    if size:
        yield emit(held_back)


class _Tokens:
    """The tokens of a block and what is known of them so far."""

    def __init__(self, row: dict, min_count: int):
        self.row, self.min_count = row, min_count
        self.ends = unpack(row["ends"], "<i8")
        self.vocab = unpack(row["vocab"])
        self.codes = unpack(row["codes"]).astype(np.int64)
        lengths = np.diff(self.ends, prepend=0)
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(lengths)).astype(bool)
        self.train = np.repeat(~self.held, lengths)
        self.depth_at = np.arange(len(self.codes)) - np.repeat(self.ends - lengths, lengths)
        self.grams = [self.vocab[self.codes]]
        self.counts: list[np.ndarray] = []
        self.asked: list[np.ndarray] = [np.ones(len(self.codes), bool)]

    def single(self):
        """Distinct words and their number in the training texts."""
        order = np.argsort(self.vocab)
        n = np.bincount(self.codes[self.train], minlength=len(self.vocab))
        return self.vocab[order], n[order]

    def know_single(self, told) -> None:
        order = np.argsort(self.vocab)
        c = np.empty(len(order), np.int64)
        c[order] = sums_of(told)
        self.counts.append(c[self.codes])

    def next_level(self) -> None:
        """n-grams one word longer, where their context is frequent enough."""
        level = len(self.grams)
        ctx, g = self.grams[-1], np.zeros(len(self.codes), np.uint64)
        g[1:] = mixed(ctx[:-1] * ODD + self.grams[0][1:] + np.uint64(level))
        ok = self.depth_at >= level
        ok[1:] &= self.counts[-1][:-1] >= self.min_count
        self.grams.append(g)
        self.asked.append(ok)

    def by_gram(self):
        keys, which = np.unique(self.grams[-1][self.asked[-1]], return_inverse=True)
        return keys, which

    def wanted(self):
        keys, which = self.by_gram()
        return keys, np.bincount(which[self.train[self.asked[-1]]], minlength=len(keys))

    def know(self, told) -> None:
        n = np.zeros(len(self.codes), np.int64)
        n[self.asked[-1]] = sums_of(told)[self.by_gram()[1]]
        self.counts.append(n)

    def context(self, level: int):
        """Of the asked tokens: distinct contexts and which one each has."""
        at = np.flatnonzero(self.asked[level])
        keys, which = np.unique(self.grams[level - 1][at - 1], return_inverse=True)
        return at, keys, which

    def probabilities(self, n_words: int, n_distinct: int, strength: float):
        """Of each level; where a level's context is not counted, those of the
        shorter one."""
        p = [(self.counts[0] + ADD) / (n_words + ADD * (n_distinct + 1))]
        for level in range(1, len(self.counts)):
            q, at = p[-1].copy(), np.flatnonzero(self.asked[level])
            q[at] = (self.counts[level][at] + strength * q[at]) / (self.counts[level - 1][at - 1] + strength)
            p.append(q)
        return p

    def gains(self, level: int, shorter: np.ndarray, strength: float):
        """Contexts of a level and this block's part of their divergence."""
        at, keys, which = self.context(level)
        some = self.train[at]
        i = at[some]
        own = (self.counts[level][i] - 1 + strength * shorter[i]) / (self.counts[level - 1][i - 1] - 1 + strength)
        gain = np.zeros(len(keys), np.int64)
        np.add.at(gain, which[some], np.rint(np.log(own / shorter[i]) * UNIT).astype(np.int64))
        return keys, gain


def score_texts(docs: DataFrame, held: Column, text_col: str = "text", id_col: str = "doc_id", depth: int = 2,
                min_count: int = 8, min_gain: float = 4.0, strength: float = 50.0) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    per row.  The tree learns from the rows where ``held`` is false.

    Tokens are the lower-cased (A-Z) words between white space and one end for
    each text.  ``score`` is the log10 probability of all tokens by the tree,
    ``base_score`` by single words (``ADD`` added to each count, one place for
    all unknown words); ``n_known`` counts the tokens that training has.  Null
    and empty texts are one end.  Rows that share an id, or have none, are
    texts of their own and repeated rows count each; a null ``held`` counts as
    held out.  Without any training text all words are unknown.  Only the id,
    the text and ``held`` are read, so other columns cannot clash.  An empty
    table stays empty.  Words are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held, F.lit(True)).alias("held"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = rows.mapInArrow(
        _cut_blocks, f"block long, ids array<{kind}>, held binary, ends binary, vocab binary, codes binary, n long, n_train long")
    folder = work_path(spark, "scores")
    schema = (f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double")
    with kept_by_block(blocks, parts_for(docs, text_col, BLOCK)) as kept:
        _scored(kept, id_col, depth, min_count, min_gain, strength, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _scored(blocks: DataFrame, id_col: str, depth: int, min_count: int, min_gain: float, strength: float, schema: str) -> DataFrame:
    total, n_words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    n_buckets = total // KEYS + 1
    bar = round(min_gain * UNIT)

    def tokens(row: dict, levels: int) -> _Tokens:
        t = _Tokens(row, min_count)
        t.know_single(row["c0"])
        for level in range(1, levels + 1):
            t.next_level()
            t.know(row[f"c{level}"])
        return t

    sums = ask(blocks, lambda row: _Tokens(row, min_count).single(), n_buckets)
    n_distinct = sums.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    known = answered(blocks, sums, "c0")
    gains = []
    for level in range(1, depth + 1):
        def wanted(row, level=level):
            t = tokens(row, level - 1)
            t.next_level()
            return t.wanted()

        def diverged(row, level=level):
            t = tokens(row, level)
            return t.gains(level, t.probabilities(n_words, n_distinct, strength)[level - 1], strength)

        known = answered(known, ask(known, wanted, n_buckets), f"c{level}")
        gains.append(ask(known, diverged, n_buckets))
    for level, g in enumerate(gains, 1):
        known = answered(known, g, f"g{level}")

    def score(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                t = tokens(row, depth)
                p = t.probabilities(n_words, n_distinct, strength)
                best, kept = p[0], np.ones(len(t.codes), bool)
                for level in range(1, depth + 1):
                    at, _, which = t.context(level)
                    node = np.zeros(len(t.codes), bool)
                    if len(at):
                        node[at] = sums_of(row[f"g{level}"])[which] >= bar
                    kept &= node
                    best = np.where(kept, p[level], best)
                first = np.concatenate([[0], t.ends[:-1]])
                n = t.ends - first
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, pa.array(t.held), pa.array(n),
                     pa.array(np.add.reduceat((t.counts[0] > 0).astype(np.int64), first)),
                     pa.array(np.full(len(n), n_words, np.int64)), pa.array(np.add.reduceat(np.log10(p[0]), first)),
                     pa.array(np.add.reduceat(np.log10(best), first))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(score, schema)
