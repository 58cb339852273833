"""Best-fit packing with exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens.  How pieces combine
depends on their lengths only, so the plan is made on the histogram of
lengths (at most ``capacity`` entries, whatever the number of documents):
sums of one, two and three lengths are indexed, combinations that exactly
fill a gap are consumed with the multiplicity that the counts allow, and the
rest is packed by best fit.  The plan is a short list of (lengths, times)
patterns; Spark numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import bpe
from strata.llm.common import cut, prepare

STEP_ROWS = 512       # documents whose ids a worker holds at once


class _Stock:
    """Pieces left of each length, with an index from sums to the pairs and
    triples of lengths that make them.

    ``pairs``: for each sum the larger members of its pairs, largest first.
    ``triples``: for each sum its largest members, largest first; the other
    two are a pair of the rest, none larger.  A combination of which a length
    has run out never comes back, so each list keeps a mark of how far its
    front is used up.  The index holds at most ``capacity ** 2`` small
    numbers, whatever the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        import numpy as np
        self.np, self.n = np, np.zeros(capacity + 1, np.int64)
        for length, c in counts.items():
            self.n[length] += c
        held = np.flatnonzero(self.n[:capacity] > 0)
        pairs, triples = [], []
        smallest = np.full(capacity + 1, capacity + 1)  # of a sum's pairs, the least larger member
        for x in held.tolist():
            small = held[(held <= x) & (held + x <= capacity)]
            pairs.append((x + small, np.full(len(small), x)))
            smallest[x + small] = np.minimum(smallest[x + small], x)
        for x in held.tolist():
            two = np.flatnonzero(smallest[:capacity - x + 1] <= x)
            triples.append((x + two, np.full(len(two), x)))
        self.pairs, self.triples = self._by_sum(pairs, capacity), self._by_sum(triples, capacity)

    def _by_sum(self, found, capacity):
        """Members by sum, largest first: (members, first of a sum, end of a sum)."""
        np = self.np
        sums = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.int64)
        large = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((-large, sums))
        ends = np.searchsorted(sums[order], np.arange(capacity + 1), "right")
        return large[order], np.concatenate([[0], ends[:-1]]), ends

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The pair of sum ``total`` with the largest member."""
        large, first, end = self.pairs
        while first[total] < end[total]:
            x = int(large[first[total]])
            if self._enough((x, total - x)):
                return x, total - x
            first[total] += 1
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        """The triple of sum ``total`` with the largest member, of several
        the one with the next largest."""
        np = self.np
        large, first, end = self.triples
        in_pairs, start, stop = self.pairs
        while first[total] < end[total]:
            x = int(large[first[total]])
            rest = total - x
            if self.n[x] > 0:
                self.n[x] -= 1
                y = in_pairs[start[rest]:stop[rest]]
                y = y[y <= x]
                hit = np.flatnonzero((self.n[y] >= np.where(2 * y == rest, 2, 1)) & (self.n[rest - y] > 0))
                self.n[x] += 1
                if len(hit):
                    return x, int(y[hit[0]]), int(rest - y[hit[0]])
            first[total] += 1
        return None

    def _enough(self, lengths) -> bool:
        return all(self.n[x] >= lengths.count(x) for x in set(lengths))

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to ``gap``."""
        return (gap,) if self.n[gap] > 0 else self.pair(gap) or self.triple(gap)

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume the combination as often as its lengths last."""
        times = min(int(self.n[x]) // lengths.count(x) for x in set(lengths))
        for x in lengths:
            self.n[x] -= times
        return times


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, times)`` that use every piece of ``counts``
    (length -> pieces) exactly once, none longer than ``capacity``."""
    stock = _Stock(counts, capacity)
    out = [((capacity,), int(stock.n[capacity]))] if stock.n[capacity] else []
    stock.n[capacity] = 0
    lonely = []
    for length in range(capacity - 1, 0, -1):
        while stock.n[length] > 0:
            stock.n[length] -= 1
            rest = stock.complement(capacity - length)
            stock.n[length] += 1
            if rest is None:
                lonely.append((length, int(stock.n[length])))
                stock.n[length] = 0
                break
            whole = (length, *rest)
            out.append((whole, stock.take(whole)))
    # residuals, longest first: into the fullest open sequences that fit
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, left in lonely:
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                open_.setdefault(capacity - length, []).append(((length,), left))
                # pieces of the same length may share these sequences
                fit = capacity // length
                if fit > 1:
                    open_[capacity - length].pop()
                    if not open_[capacity - length]:
                        del open_[capacity - length]
                    full, more = divmod(left, fit)
                    for k, times in ((fit, full), (more, 1 if more else 0)):
                        if times:
                            open_.setdefault(capacity - k * length, []).append(((length,) * k, times))
                left = 0
            else:
                pattern, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                used = min(times, left)
                left -= used
                if times > used:
                    open_.setdefault(gap, []).append((pattern, times - used))
                open_.setdefault(gap - length, []).append(((*pattern, length), used))
    return out + [p for some in open_.values() for p in some]


def pieces(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int = 2048,
           end_id: int = 0, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the ids of each document,
    then ``end_id``; longer ones are cut into pieces of ``capacity``, the
    first may be shorter.  ``encode()`` runs once a task and returns the
    function that turns texts into little-endian 32-bit ids."""
    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = int(end_id).to_bytes(4, "little")

    def split(batches):
        from zlib import crc32

        import pyarrow as pa
        run = encode()
        for b in (whole.slice(i, STEP_ROWS) for whole in batches for i in range(0, whole.num_rows, STEP_ROWS)):
            cols = [[], [], [], [], []]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), run(texts)):
                ids += end
                n = len(ids) // 4
                start = 0
                for k in range((n + capacity - 1) // capacity):
                    stop = n - ((n - 1) // capacity - k) * capacity
                    for col, x in zip(cols, (doc, k, start, stop - start, crc32(memoryview(ids)[4 * start:4 * stop]))):
                        col.append(x)
                    start = stop
            arrow = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow)],
                                             [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(split, schema)


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a checkpointed table with a
    column ``length`` (1 to ``capacity``); each row is placed once, repeated
    rows too, and an empty table stays empty.

    Pieces of a length are numbered by partition of the checkpoint, so that
    a length shared by a third of all rows is numbered in many tasks.
    """
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, first, seq, offset = [], 0, [], []
    next_rank: dict[int, int] = dict.fromkeys(histogram, 0)
    for lengths, times in plan(histogram, capacity):
        at = 0
        for x in lengths:
            keys.append((x << 44) + next_rank[x])
            seq.append(first - next_rank[x])
            offset.append(at)
            next_rank[x] += times
            at += x
        first += times

    rows = cut_pieces.withColumn("_llm_part", F.spark_partition_id())
    held = rows.groupBy("length", "_llm_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    held = cut(held.select(F.col("length").alias("_llm_l"), F.col("_llm_part").alias("_llm_p"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_llm_before")))
    inside = Window.partitionBy("length", "_llm_part").orderBy("_llm_row")
    rows = (rows.withColumn("_llm_row", F.monotonically_increasing_id())
            .withColumn("_llm_n", F.row_number().over(inside) - 1)
            .join(held, (F.col("length") == F.col("_llm_l")) & (F.col("_llm_part") == F.col("_llm_p")))
            .withColumn("_llm_rank", F.col("_llm_before") + F.col("_llm_n")))

    # the places: one entry per pattern and position, a few thousand whatever
    # the number of pieces
    def place(length, rank):
        import numpy as np
        import pandas as pd
        bpe.forget()
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        k = np.array(keys, np.int64)[order]
        i = order[np.searchsorted(k, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1]
        return pd.DataFrame({"sequence_id": np.array(seq, np.int64)[i] + rank.to_numpy(),
                             "offset": np.array(offset, np.int64)[i]})

    place = F.pandas_udf(place, "sequence_id long, offset long")
    rows = rows.withColumn("_llm_to", place("length", "_llm_rank"))
    return rows.select(*[F.col(f"`{c}`") for c in cut_pieces.columns], "_llm_to.sequence_id", "_llm_to.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place.  Null and empty texts are
    one piece of length 1 (the end id); rows with a null or repeated id are
    documents of their own."""
    prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    return pack(cut(pieces(docs, lambda: bpe.encoder(spec).encode, capacity, 0, text_col, id_col)), capacity)
