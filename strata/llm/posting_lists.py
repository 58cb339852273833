"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample, halved again and again at the median,
so every list gets the same share of the sample.  A graph over the centroids
is searched in memory; a vector goes to its nearest list and to every list
whose centroid is nearly as close (boundary vectors are replicated).  A query
reads the lists whose centroid distance is within a ratio of the nearest one;
where these hold too few vectors it reads on, list by list in the order of
their centroids.  Lists are scanned in blocks, so a long list is many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import cut, prepare
from strata.llm.vectors import matrix, usable

SAMPLE = 20_000       # distinct vectors that the centroids are fitted on
LIST = 256            # vectors of a list, while the sample allows as many centroids
MOST_LISTS = 1024     # centroids kept in memory; more vectors make longer lists
DEGREE = 24           # neighbours of a centroid in the graph
BEAM = 96             # centroids that a query's search keeps
INDEX_BEAM = 24       # the same for an indexed vector, which needs its nearest lists only
CLOSURE = 1.03        # a vector joins lists up to this ratio of its nearest distance
PRUNE = 1.16          # a query reads lists up to this ratio
BLOCK = 4096          # vectors of a list scanned together
QUERIES = 512         # queries scanned together
MORE = 8              # lists a query reads when those in its ratio hold too few vectors; then 4 times as many, up to all


def balanced_centroids(x, lists: int, seed: int = 3):
    """Means of the parts of ``x`` after halving each part at the median of
    its distances to two centres, until there are ``lists`` (a power of two)."""
    import numpy as np
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists and min(map(len, parts)) >= 2:
        halves = []
        for p in parts:
            a, b = x[rng.choice(p, 2, replace=False)]
            for _ in range(6):
                side = ((x[p] - a) ** 2).sum(axis=1) - ((x[p] - b) ** 2).sum(axis=1)
                order = np.argsort(side, kind="stable")
                low, high = p[order[:len(p) // 2]], p[order[len(p) // 2:]]
                a, b = x[low].mean(axis=0), x[high].mean(axis=0)
            halves += [low, high]
        parts = halves
    return np.stack([x[p].mean(axis=0) for p in parts])


class CentroidGraph:
    """Nearest-neighbour graph with a best-first beam search, run for a batch
    of vectors at once."""

    def __init__(self, centroids):
        import numpy as np
        self.c = centroids
        n = len(centroids)
        self.square = (centroids ** 2).sum(axis=1)
        k = min(DEGREE, n - 1)
        d = self.square[:, None] + self.square[None, :] - 2 * centroids @ centroids.T
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        # links both ways; a short row repeats its own number
        to = [set(row.tolist()) for row in near]
        for i, row in enumerate(near):
            for j in row.tolist():
                if len(to[j]) < 2 * DEGREE:
                    to[j].add(i)
        width = max([1, *map(len, to)])
        self.links = np.array([sorted(t) + [i] * (width - len(t)) for i, t in enumerate(to)])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x, beam: int = BEAM):
        """Distances to the centroids that the search reached, infinite for
        the others (vectors x centroids)."""
        import numpy as np
        n, k = len(x), len(self.c)
        found = np.full((n, k), np.inf)
        left = np.zeros((n, k), bool)     # reached, not expanded
        rows = np.arange(n)
        norm = (x ** 2).sum(axis=1)
        first = self.entries
        found[:, first] = norm[:, None] + self.square[first] - 2 * x @ self.c[first].T
        left[:, first] = True
        beam = min(beam, k)
        alive = rows
        while len(alive):
            bound = np.partition(found[alive], beam - 1, axis=1)[:, beam - 1]
            best = np.where(left[alive], found[alive], np.inf)
            at = best.argmin(axis=1)
            value = best[np.arange(len(alive)), at]
            go = np.isfinite(value) & (value <= bound)
            alive, at = alive[go], at[go]
            if not len(alive):
                break
            left[alive, at] = False
            to = self.links[at]
            d = norm[alive, None] + self.square[to] - 2 * np.einsum("ij,ikj->ik", x[alive], self.c[to])
            r = np.repeat(alive, to.shape[1])
            t, d = to.ravel(), d.ravel()
            new = ~np.isfinite(found[r, t])
            found[r[new], t[new]] = d[new]
            left[r[new], t[new]] = True
        return np.sqrt(np.maximum(found, 0))


def _assign(centroids, ratio: float, beam: int):
    """Batches of ``(key, v, ...)`` -> the same rows, one per chosen list."""
    def run(batches):
        import numpy as np
        graph = CentroidGraph(centroids)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k:k + 512]
                d = graph.search(matrix(part["v"]), beam)
                row, to = np.nonzero(d <= ratio * d.min(axis=1, keepdims=True))
                yield part.iloc[row].assign(list=to.astype(np.int32))
    return run


def _assign_first(centroids, m: int):
    """As ``_assign``, to the ``m`` nearest lists."""
    def run(batches):
        import numpy as np
        square = (centroids ** 2).sum(axis=1)
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k:k + 512]
                # without the vector's own square, the same for all lists
                to = np.argsort(square - 2 * matrix(part["v"]) @ centroids.T, axis=1, kind="stable")[:, :m]
                yield part.iloc[np.repeat(np.arange(len(part)), to.shape[1])].assign(list=to.ravel().astype(np.int32))
    return run


def _scan(k: int):
    def run(left, right):
        import numpy as np
        import pandas as pd
        out = []
        if len(left) and len(right):
            v = matrix(left["v"])
            square = (v ** 2).sum(axis=1)
            first = np.array([ids[0] for ids in left["ids"]])
            for q, x in zip(right["query_id"].tolist(), matrix(right["v"])):
                near = square - 2 * (v @ x) + (x @ x)
                # a margin for the short form's rounding; the exact distance decides
                m = min(k + 1, len(near))
                limit = np.partition(near, m - 1)[m - 1]
                some = np.flatnonzero(near <= limit + 1e-9 * (square + x @ x + 1))
                d = np.sqrt(((v[some] - x) ** 2).sum(axis=1))
                hits = []
                for i in np.lexsort((first[some], d)):
                    if len(hits) >= k and d[i] > hits[k - 1][0]:
                        break
                    hits = sorted(hits + [(d[i], j) for j in left["ids"].iloc[some[i]] if j != q])[:k]
                out += [(q, j, s) for s, j in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, vector_col: str = "embedding", id_col: str = "vec_id",
            closure: float = CLOSURE, prune: float = PRUNE, seed: int = 3) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the
    ``k`` nearest rows found by Euclidean distance, ties to the smaller id.

    Every usable vector is indexed; a query's own id is no candidate.
    Vectors that are null, zero or hold null or non-finite components, and
    rows without an id, take no part, nor do vectors of another length than
    most.  Rows with an equal vector are indexed once with their ``k + 1``
    smallest ids (a larger id cannot be among the nearest ``k``).  A query
    whose lists hold fewer than ``k`` candidates reads further ones, in the
    end all; only where the whole table has fewer, fewer are returned.
    """
    spark = rows.sparkSession
    prepare(spark)

    def clean(df, name):
        i, v = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
        return df.filter(usable(v) & i.isNotNull()).select(i.cast("long").alias(name), v.alias("v"))

    dim = clean(rows, "id").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return spark.createDataFrame([], schema)
    has_dim = F.size("v") == dim["d"]
    by_vector = Window.partitionBy("v").orderBy("id")
    index = clean(rows, "id").filter(has_dim).withColumn("r", F.dense_rank().over(by_vector)).filter(F.col("r") <= k + 1)
    index = cut(index.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    n = index.count()
    sample = index.orderBy(F.xxhash64("v"), F.col("ids")[0]).limit(SAMPLE).select("v").toPandas()
    lists = min(MOST_LISTS, 1 << max(0, round(math.log2(max(1, n / LIST)))))
    centroids = balanced_centroids(matrix(sample["v"]), lists, seed)

    posts = cut(index.mapInPandas(_assign(centroids, closure, INDEX_BEAM), "v array<float>, ids array<long>, list int")
                .withColumn("h", F.xxhash64("ids")))
    sizes = cut(posts.groupBy("list").agg(F.count(F.lit(1)).alias("n")))

    def scanned(asked):
        size = sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("vb"))
        asks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qb"))
        # one row per list, at most MOST_LISTS
        blocks = cut(size.join(asks, "list"))
        of_list = posts.join(F.broadcast(blocks), "list").select(
            "v", "ids", "list", F.pmod("h", F.col("vb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("c"))
        asked = asked.join(F.broadcast(blocks), "list").select(
            "v", "query_id", "list", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("b"),
            F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("c"))
        return of_list.groupBy("list", "b", "c").cogroup(asked.groupBy("list", "b", "c")).applyInPandas(
            _scan(k), "query_id long, vec_id long, score double").distinct()

    def ranked(found):
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    asking, to = cut(clean(queries, "query_id").filter(has_dim)), "query_id long, v array<float>, list int"
    best = cut(ranked(scanned(cut(asking.mapInPandas(_assign(centroids, prune, BEAM), to)))))
    read, every = 1, len(centroids)
    while read < every:
        enough = best.groupBy("query_id").count().filter(F.col("count") >= k)
        asking = cut(asking.join(enough, "query_id", "left_anti"))
        if asking.isEmpty():
            break
        read = min(max(MORE, 4 * read), every)
        more = scanned(cut(asking.mapInPandas(_assign_first(centroids, read), to)))
        best = cut(ranked(best.select("query_id", "vec_id", "score").union(more).distinct()))
    return best
