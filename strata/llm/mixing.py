"""Mixing sources to target weights with a splitting tree of block quotas.

A source's documents, in an order given by a hash, form one stream of words,
read as often as its target asks (a last pass is cut at the exact word).  The
stream is counted in blocks; a binary tree over the output shards splits the
exact block quotas of all sources, each split a draw without replacement
(multivariate hypergeometric: source after source, conditional on the rest),
down to one quota per shard and source.  A shard then takes its own range of
each source's permuted blocks and shuffles what it holds.  DataFrame
functions only; every draw is a function of the seed and the keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, keep_columns, prepare, text_of

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BUCKET = 20_000
_NEW = ["size", "source_size", "target", "taken", "pieces"]


def sized(docs: DataFrame, seed: int = 7, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Add ``size`` (words) and ``_llm_order`` (the place in the permutation)."""
    return docs.select(*keep_columns(docs, _NEW), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64(F.col(f"`{id_col}`"), text_of(text_col), F.lit(seed)).alias("_llm_order"))


def targets(totals: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``totals(_llm_source, source_size)`` with ``rn`` (sources by code
    point, null last), ``weight`` and ``target``: shares of all words by
    weight, none above ``cap`` times its source, the excess reshared.

    Sources are capped in the order of ``cap * size / weight``; with the
    first ones capped, the rest share what is left by weight, and the first
    source whose share stays below its cap fixes the level of all others.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("_llm_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     F.pmod(F.col("rn") - 1, F.lit(len(weights))).cast("int") + 1)
    t = totals.withColumn("rn", F.row_number().over(by_name)).withColumn("weight", w)
    t = t.withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    everything = Window.orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / open_)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    # of the levels that hold, the first in cap order is the one
    first = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    return t.withColumn("target", F.least(F.col("weight") * F.coalesce(first, level, F.lit(0.0)), "top")).select(
        "_llm_source", "source_size", "rn", "target")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _tail(mode: Column, stop: Column, step, state, add) -> Column:
    """Run ``add(state, x, weight)`` over the outcomes beside the mode, from
    the nearest to ``stop``; ``step(x)`` is the weight of x over that of its
    neighbour nearer to the mode (whose own weight is 1)."""
    start = F.when(stop >= mode, mode + 1).otherwise(mode - 1)
    xs = F.when(stop == mode, F.array().cast("array<bigint>")).otherwise(F.sequence(start, stop))
    return F.aggregate(xs, F.struct(F.lit(1.0).alias("w"), state.alias("s")), lambda acc, x: _let(
        acc["w"] * step(x), lambda w: F.struct(w.alias("w"), add(acc["s"], x, w).alias("s"))), lambda acc: acc["s"])


def hypergeometric(rest: Column, held: Column, need: Column, unit: Column) -> Column:
    """The number of ``held`` blocks among ``need`` drawn without replacement
    from ``rest``, for a uniform ``unit`` in [0, 1): the inverse of the exact
    law, its weights found by recurrence from the mode.  Outcomes over nine
    deviations and 60 away weigh less than the last bit of ``unit``."""
    def draw(p):
        n, k, m = p["rest"].cast("double"), p["held"].cast("double"), p["need"].cast("double")
        up = lambda x: (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))  # noqa: E731  weight of x over that of x - 1
        down = lambda x: 1 / up(x + 1)
        plus = lambda s, x, w: s + w

        def search(law):
            # the mode, then the outcomes above it, then those below
            found = lambda s, x, w: F.struct((s["left"] - w).alias("left"), F.when(
                s["at"].isNull() & (s["left"] < w), x).otherwise(s["at"]).alias("at"))
            begin = F.struct((unit * law["all"] - 1).alias("left"), F.when(unit * law["all"] < 1, p["mode"]).alias("at"))
            above = _tail(p["mode"], p["high"], up, begin, found)
            return F.coalesce(_let(above, lambda s: _tail(p["mode"], p["low"], down, s, found))["at"], p["mode"])

        total = 1 + _tail(p["mode"], p["high"], up, F.lit(0.0), plus) + _tail(p["mode"], p["low"], down, F.lit(0.0), plus)
        return _let(F.struct(total.alias("all")), search)

    share = held / F.greatest(rest, F.lit(1).cast("long"))
    spread = F.sqrt(F.greatest(need * share * (1 - share) * (rest - need) / F.greatest(rest - 1, F.lit(1).cast("long")),
                               F.lit(0.0)))
    least, most = F.greatest(F.lit(0).cast("long"), need - (rest - held)), F.least(held, need)
    reach = (F.ceil(9 * spread) + 60).cast("long")
    mode = F.least(F.greatest(F.floor((need + 1.0) * (held + 1.0) / (rest + 2.0)).cast("long"), least), most)
    return _let(F.struct(rest.alias("rest"), held.alias("held"), need.alias("need"), mode.alias("mode"),
                         F.greatest(least, mode - reach).alias("low"), F.least(most, mode + reach).alias("high")), draw)


def _split(quotas: Column, part: Column, low: Column, seed: int) -> Column:
    """Quotas of the left child: ``part`` of the blocks, drawn without
    replacement: source after source by the hypergeometric law, conditional
    on the rest, so the parts always sum to what the child takes."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    state = F.struct(total.alias("rest"), F.floor(total * part).cast("long").alias("need"),
                     F.array().cast("array<bigint>").alias("out"))

    def draw(acc, q):
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), low, part, F.size(acc["out"])), 11) / float(1 << 53)
        return _let(hypergeometric(acc["rest"], q, acc["need"], unit), lambda x: F.struct(
            (acc["rest"] - q).alias("rest"), (acc["need"] - x).alias("need"),
            F.concat(acc["out"], F.array(x)).alias("out")))

    return F.aggregate(quotas, state, draw, lambda acc: acc["out"])


def permuted(block: Column, blocks: Column, *key: Column, rounds: int = 24) -> Column:
    """The place of a block among ``blocks``, by a keyed bijection: each round
    pairs the places that sum to a drawn number and swaps the pairs that a
    hash picks."""
    def swap(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*key, r), blocks) - x, blocks)
        return _let(other, lambda y: F.when(F.xxhash64(*key, r, F.greatest(x, y)) % 2 == 0, y).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), block, swap)


def shard_quotas(plan: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``(shard, quotas)``: one array over the sources (by ``rn``) for each
    shard, from ``plan(rn, blocks)``; per source they sum to its blocks."""
    node = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "blocks"))), lambda s: s["blocks"]).alias("q"))
    node = node.select(F.lit(0).alias("low"), F.lit(n_shards).alias("high"), "q")
    for _ in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        half = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
        part = (F.col("half") - F.col("low")) / (F.col("high") - F.col("low"))
        node = node.withColumn("half", half).withColumn("left", F.when(
            F.col("half") > F.col("low"), _split(F.col("q"), part, F.col("low"), seed)))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        one = F.array(F.struct("low", "high", "q"))
        two = F.array(F.struct("low", F.col("half").alias("high"), F.col("left").alias("q")),
                      F.struct(F.col("half").alias("low"), "high", right.alias("q")))
        node = cut(node.select(F.explode(F.when(F.col("left").isNull(), one).otherwise(two)).alias("n")).select("n.*"))
    return node.select(F.col("low").alias("shard"), F.col("q").alias("quotas"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, n_shards: int = 32,
                block_words: int = 4096, seed: int = 7, source_col: str = "source") -> DataFrame:
    """Add ``source_size``, ``target``, ``taken`` (words) and ``pieces`` to a
    table of ``sized``; it is read several times, so cut it before where it
    is narrow.

    ``pieces``: array of (pass, words, shard, place): the document's first
    ``words`` words go to that shard; only the last document of a source's
    last pass is cut.  The words taken of a source sum to its target, rounded.
    ``place`` orders a shard.  Sources: null is a source of its own, the last.
    Empty texts have size 0 and no pieces; repeated rows are documents of
    their own; an empty table gives an empty table.  ``n_shards`` bounds the
    quotas held per source, not the documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.withColumn("_llm_source", F.col(f"`{source_col}`"))
    totals = cut(rows.groupBy("_llm_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    n_rows = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, n_rows / ROWS_PER_BUCKET)) + 1))
    plan = targets(totals.drop("n"), weights, cap).withColumn("words", F.round("target").cast("long"))
    plan = cut(plan.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long")))

    # per source, where each shard's range of blocks ends
    ends = (shard_quotas(plan, n_shards, seed).select("shard", F.posexplode("quotas").alias("k", "quota"))
            .groupBy("k").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("by"))
            .select((F.col("k") + 1).alias("rn"), F.aggregate("by", F.array().cast("array<bigint>"), lambda a, s: F.concat(
                a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + s["quota"]))).alias("ends")))
    plan = cut(plan.join(ends, "rn").select(F.col("_llm_source").alias("_llm_s"), "source_size", "target", "words", "ends",
                                            "rn", "blocks"))

    # exclusive running words in permuted order, in two steps: buckets of the
    # order hash (no larger than ROWS_PER_BUCKET or so, however large the
    # source), then inside a bucket
    rows = rows.withColumn("_llm_bucket", F.shiftrightunsigned("_llm_order", 64 - bits))
    sums = rows.groupBy("_llm_source", "_llm_bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("_llm_source").orderBy("_llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select(F.col("_llm_source").alias("_llm_s"), F.col("_llm_bucket").alias("_llm_b"),
                              F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")).alias("offset")))
    offsets = cut(offsets.join(plan.withColumnRenamed("_llm_s", "_llm_p"), F.col("_llm_s").eqNullSafe(F.col("_llm_p"))))
    inside = Window.partitionBy("_llm_source", "_llm_bucket").orderBy("_llm_order", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("_llm_in", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    rows = rows.join(offsets, F.col("_llm_source").eqNullSafe(F.col("_llm_s")) & (F.col("_llm_bucket") == F.col("_llm_b")))
    rows = rows.withColumn("_llm_at", F.col("offset") + F.col("_llm_in"))

    passes = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)), lambda p: F.struct(
        p.alias("pass"), (p * F.col("source_size") + F.col("_llm_at")).alias("at")))
    taken = F.transform(passes, lambda p: F.struct(
        p["pass"].alias("pass"), p["at"].alias("at"),
        F.least(F.col("size"), F.greatest(F.col("words") - p["at"], F.lit(0).cast("long"))).alias("words")))
    pieces = F.transform(F.filter(taken, lambda p: p["words"] > 0), lambda p: F.struct(
        p["pass"], p["words"],
        _let(permuted(F.floor(p["at"] / block_words).cast("long"), F.col("blocks"), F.lit(seed), F.col("rn")),
             lambda place: F.size(F.filter("ends", lambda e: e <= place))).alias("shard"),
        F.xxhash64(F.col("_llm_order"), p["pass"], F.lit(seed + 1)).alias("place")))
    rows = rows.withColumn("pieces", pieces)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "_llm_order"], "source_size", "target", F.aggregate(
        "pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"), "pieces")


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """The mixture as rows: one per piece, with the columns of ``docs``, the
    text cut to the piece's words where it is not whole; ``shard`` and
    ``place`` say where it goes and in which order."""
    mixed = mix_sources(sized(docs, text_col=text_col, id_col=id_col), **params)
    mixed = mixed.withColumn("_llm_piece", F.explode("pieces"))
    first = F.array_join(F.slice(F.regexp_extract_all(text_of(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)),
                                 F.lit(1), F.col("_llm_piece.words").cast("int")), "")
    text = F.when(F.col("_llm_piece.words") < F.col("size"), first).otherwise(F.col(f"`{text_col}`"))
    return mixed.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c in mixed.columns],
                        F.col("_llm_piece.shard").alias("shard"), F.col("_llm_piece.place").alias("place"))
