"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at
most ``max_bits`` bits differ in at most ``max_bits`` bytes, so they share at
least ``8 - max_bits`` = m of them.  A posting list of one positional byte
would hold 1/256 of all fingerprints, so a list is kept by four of them, which
by chance holds one in 2^32: the positions are taken as the points of a cube,
and a list stands for each of the 14 sets of four whose numbers cancel out
(XOR 0).  Any three positions lie in one set, so these are spread evenly, and m
shared bytes hold a fixed least number of sets (6 bytes: 3).  The sets that a
pair shares are tallied; the pairs that reach this number are retained and
verified by their bit distance.  Where m is less than five, all sets of up to
four positions are used.

A list that holds many fingerprints (of one kind of text) is split by further
bytes, up to m: a pair that shares m bytes still meets in a part of it and
counts it as one match, the others of the list never meet.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, keep_columns, prepare
from strata.llm.graph import components

BLOCK = 1 << 15  # shingles whose bits are counted at once
LONG_LIST = 64   # a list of more fingerprints is split by further bytes


def _fingerprint(text: str | None, size: int) -> int:
    import numpy as np
    from xxhash import xxh64_intdigest
    # bytes.lower() and bytes.split() know ASCII letters and white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[k:k + BLOCK], stops[k:k + BLOCK])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", name: str = "_llm_fp") -> DataFrame:
    """The rows of ``docs`` with their 64-bit fingerprint as a long."""
    fp = F.pandas_udf(lambda s: s.map(lambda t: _fingerprint(t, shingle)).astype("int64"), "long")
    return docs.select("*", fp(F.col(f"`{text_col}`").cast("string")).alias(name))


def _mask(positions) -> int:
    m = sum(0xFF << (8 * i) for i in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _sets(least: int, width: int | None) -> list[tuple[int, ...]]:
    """The sets of positions that have posting lists."""
    if width is None and least > 4:
        return [c for c in combinations(range(8), 4) if reduce(xor, c) == 0]
    return list(combinations(range(8), min(width or 4, least)))


def pairs(nodes: DataFrame, max_bits: int = 2, width: int | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """``(nodea, fpa, nodeb, fpb)``: every pair of rows of ``nodes(node, fp)``,
    whose fingerprints are distinct, that differs in at most ``max_bits`` bits,
    once.  ``width``: lists for all sets of so many positions instead."""
    least = max(0, 8 - max_bits)      # bytes that a pair is sure to share
    sets, wide = _sets(least, width), list(combinations(range(8), least))
    sure = min(sum(set(s) <= set(w) for s in sets) for w in wide)      # sets within any such bytes
    masks, wide_masks = (F.array(*[F.lit(_mask(c)) for c in some]) for some in (sets, wide))
    # for each set of positions, the sets of ``least`` positions around it
    around = F.array(*[F.array(*[F.lit(k) for k, c in enumerate(wide) if set(c) >= set(s)]) for s in sets])
    posts = nodes.select("node", "fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("place", "held"))
    long = (posts.groupBy("place", "held").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > long_list)
            .select(F.col("place").alias("_llm_p"), F.col("held").alias("_llm_h")))
    posts = posts.join(long, (F.col("place") == F.col("_llm_p")) & (F.col("held") == F.col("_llm_h")), "left")
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.col("held").alias("held")))
    split = F.transform(around[F.col("place")], lambda k: F.struct(
        k.alias("part"), F.col("fp").bitwiseAND(wide_masks[k]).alias("held")))
    lists = posts.select("node", "fp", "place", F.explode(F.when(F.col("_llm_p").isNull(), whole).otherwise(split)).alias("l"))
    lists = lists.select("node", "fp", "place", "l.part", "l.held")
    a, b = (lists.select(*[F.col(c).alias(f"{c}{k}") for c in lists.columns]) for k in "ab")
    met = a.join(b, (F.col("placea") == F.col("placeb")) & (F.col("parta") == F.col("partb"))
                 & (F.col("helda") == F.col("heldb")) & (F.col("fpa") < F.col("fpb")))
    # lists in common: a bit a set of positions (70 at most, so in two words),
    # since the parts of a split list count once
    bits = [F.expr(f"bit_count(bit_or(if(placea div 35 = {k}, shiftleft(1L, placea % 35), 0L)))") for k in (0, 1)]
    tally = met.groupBy("nodea", "fpa", "nodeb", "fpb").agg((bits[0] + bits[1]).alias("matches"))
    return tally.filter((F.col("matches") >= sure)
                        & (F.bit_count(F.col("fpa").bitwiseXOR(F.col("fpb"))) <= max_bits)).drop("matches")


def classes(marked: DataFrame, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """``(_llm_fp, component_id)`` for every distinct fingerprint of a table
    with columns ``_llm_fp`` and ``id_col``."""
    nodes = cut(marked.groupBy("_llm_fp").agg(F.min(f"`{id_col}`").alias("node")))
    found = pairs(nodes.filter("node is not null").select("node", F.col("_llm_fp").alias("fp")), max_bits)
    roots = components(found.select(F.col("nodea").alias("v"), F.col("nodeb").alias("u")))
    return cut(nodes.join(roots.withColumnRenamed("node", "_llm_node"), F.col("node") == F.col("_llm_node"), "left")
               .select(F.col("_llm_fp").alias("_llm_f"), F.coalesce("root", "node").alias("component_id")))


def simhash_components(marked: DataFrame, max_bits: int = 2, id_col: str = "doc_id") -> DataFrame:
    """Add ``component_id`` (the smallest id reachable over links of at most
    ``max_bits`` bits, the row's own included) to a table of
    ``with_fingerprints``; it is read more than once, so cut it before.

    Equal fingerprints meet once, whatever their number.  A null text counts
    as empty; a text without words has fingerprint zero and links like any
    other.  Rows without an id get the component of the rows that share their
    fingerprint, null if none of these has an id.  Repeated rows stay; an
    input column ``component_id`` is replaced; an empty table stays empty.
    """
    prepare(marked.sparkSession)
    kept = marked.select(*keep_columns(marked, ["component_id"]))
    return kept.join(classes(kept, max_bits, id_col), F.col("_llm_fp") == F.col("_llm_f"), "left").drop("_llm_f")


def hex_of(fp: str = "_llm_fp"):
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, text_col: str = "text",
                         id_col: str = "doc_id") -> DataFrame:
    """One row of each component: that of its smallest id (of several rows
    with that id, the one with the smallest fingerprint and text hash).  Of
    rows without an id whose component is null, one per fingerprint stays."""
    prepare(docs.sparkSession)
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    narrow = cut(with_fingerprints(docs, shingle, text_col).select(
        F.col(f"`{id_col}`").alias("_llm_id"), "_llm_fp", key.alias("_llm_key")))
    found = simhash_components(narrow, max_bits, "_llm_id")
    first = F.struct("_llm_fp", "_llm_key")
    kept = (found.filter("_llm_id = component_id").groupBy("_llm_id").agg(F.min(first).alias("f"))
            .select("_llm_id", F.col("f._llm_key").alias("_llm_key")))
    bare = (found.filter("component_id is null").groupBy("_llm_fp").agg(F.min("_llm_key").alias("_llm_key"))
            .select(F.lit(None).cast(narrow.schema["_llm_id"].dataType).alias("_llm_id"), "_llm_key"))
    kept = cut(kept.union(bare)).withColumnsRenamed({"_llm_id": "_llm_i", "_llm_key": "_llm_k"})
    rows = docs.select("*", key.alias("_llm_key"))
    rows = rows.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col("_llm_i")) & (F.col("_llm_key") == F.col("_llm_k")),
                     "left_semi")
    # repeated rows: the first of them
    again = Window.partitionBy(f"`{id_col}`", "_llm_key").orderBy("_llm_key")
    return rows.withColumn("_llm_n", F.row_number().over(again)).filter("_llm_n = 1").select(
        *[F.col(f"`{c}`") for c in docs.columns])
