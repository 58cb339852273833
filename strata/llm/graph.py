"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import written

_EDGE = "v long, u long"


def _forest(batches):
    """Union-find over one partition's edges: each node's edge to the
    smallest node it reaches there (memory: the partition's nodes)."""
    import pandas as pd
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for b in batches:
        for v, u in zip(b["v"].tolist(), b["u"].tolist()):
            a, c = root(v), root(u)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in list(parent) if root(x) != x]
    for k in range(0, len(nodes), 100_000):
        some = nodes[k:k + 100_000]
        yield pd.DataFrame({"v": some, "u": [root(x) for x in some]}, dtype="int64")


def _least(links: DataFrame) -> DataFrame:
    """x -> smallest of its neighbours and itself; written, so that a join with
    it has two plain inputs and a node with very many edges can be split."""
    return written(links.groupBy("x").agg(F.min("y").alias("y")).select(
        F.col("x").alias("n"), F.least("x", "y").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(v, u)`` that is not the
    smallest of its component; ``root`` is that smallest node.

    Partitions first reduce their edges to a forest, then alternating star
    steps hang every neighbourhood on its smallest node until nothing
    changes.  Nulls and self edges are ignored; an empty table gives an
    empty result.
    """
    links = edges.filter("v is not null and u is not null and v <> u").select(
        F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    links = written(links.mapInPandas(_forest, _EDGE).distinct(), "links")
    state = None
    while True:
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).union(
            links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        # large star: larger neighbours hang on the smallest neighbour
        large = both.filter("y > x").join(_least(both), F.col("x") == F.col("n")).select(
            F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest
        down = large.select(F.col("v").alias("x"), F.col("u").alias("y"))
        hung = down.join(_least(down), F.col("x") == F.col("n"))
        links = written(hung.select(F.col("y").alias("v"), F.col("m").alias("u")).union(
            hung.select(F.col("x").alias("v"), F.col("m").alias("u"))).filter("v <> u").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now
