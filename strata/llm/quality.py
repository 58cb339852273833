"""Quality classifier: a byte-level convolutional network in numpy.

The whole text, as UTF-8 bytes, is read in overlapping chunks.  Learned
filters of ``WIDTH`` bytes run over every position; each chunk keeps every
filter's largest response, and the document's largest and mean chunk
responses are combined into one probability.  Training runs on a bounded
sample of labelled documents; scoring runs in the tasks, document by document
and chunk block by chunk block, so its memory does not depend on the length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, keep_columns, prepare

WIDTH = 4          # bytes under a filter, read as two byte pairs
FILTERS = 16
CHUNK = 512        # bytes of a chunk
STRIDE = 448       # bytes from chunk to chunk; they overlap by the rest
BLOCK = 128        # chunks whose responses are held at once
SAMPLE_ROWS = 1200       # labelled documents of each class that the fit may read
SAMPLE_BYTES = 16_384    # of a longer document the fit reads chunks that sum to this; scoring reads all


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


class ByteNet:
    """Weights: ``conv[j, byte, filter]``, ``bias[filter]`` and the linear
    layer ``out`` over the filters' largest and mean chunk responses."""

    def __init__(self, conv, bias, out, shift):
        self.conv, self.bias, self.out, self.shift = conv, bias, out, shift
        self._pairs = None

    def _pair_tables(self):
        import numpy as np
        if self._pairs is None:
            c = self.conv
            self._pairs = [(c[j][:, None, :] + c[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32)
                           for j in range(0, WIDTH, 2)]
        return self._pairs

    def chunks(self, data: bytes):
        """Start and byte values of consecutive blocks of chunks."""
        import numpy as np
        x = np.frombuffer(data, np.uint8)
        n = max(1, -(-(len(x) - (CHUNK - STRIDE)) // STRIDE))
        for k in range(0, n, BLOCK):
            m = min(BLOCK, n - k)
            part = x[k * STRIDE:(k + m - 1) * STRIDE + CHUNK]
            yield m, np.concatenate([part, np.zeros((m - 1) * STRIDE + CHUNK + WIDTH - 1 - len(part), np.uint8)])

    def responses(self, data: bytes):
        """Largest response of each filter in each chunk (chunks x filters);
        bytes behind the text's end are zero bytes."""
        import numpy as np
        a, b = self._pair_tables()
        found = []
        for m, part in self.chunks(data):
            pair = part[:-1].astype(np.int32) * 256 + part[1:]
            r = a.take(pair[:-2], axis=0)
            r += b.take(pair[2:], axis=0)
            # chunks overlap: the maximum of their common parts is taken once
            head = np.maximum.reduceat(r, _cuts(m), axis=0)
            top = np.maximum(head[0::2], head[1::2])
            top[:-1] = np.maximum(top[:-1], head[2::2][:m - 1])
            found.append(top)
        r = np.concatenate(found) + self.bias
        return np.maximum(r, 0, out=r)

    def score(self, text: str | None) -> float:
        import numpy as np
        r = self.responses((text or "").encode("utf-8", "surrogatepass"))
        z = float(np.concatenate([r.max(axis=0), r.mean(axis=0)]).astype(np.float64) @ self.out + self.shift)
        return 1.0 / (1.0 + np.exp(-z)) if z > -700 else 0.0


def _cuts(m: int):
    """Bounds of chunk heads (shared with the chunk before) and bodies."""
    import numpy as np
    starts = np.arange(m) * STRIDE
    return np.stack([starts, starts + (CHUNK - STRIDE)], axis=1).ravel()


def train(texts: list[str], labels: list[int], epochs: int = 8, rate: float = 0.01, seed: int = 11,
          batch: int = 32) -> ByteNet:
    """Fit by Adam on the logistic loss.  A gradient reaches only the bytes
    at each chunk's largest response.  With labels of one class only (or
    none) the network is constant at their smoothed mean."""
    import numpy as np
    rng = np.random.default_rng(seed)
    prior = (sum(labels) + 0.5) / (len(labels) + 1)
    conv = rng.normal(0, 0.1, (WIDTH, 256, FILTERS))
    net = ByteNet(conv, np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), float(np.log(prior / (1 - prior))))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    data = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    params = {"conv": net.conv, "bias": net.bias, "out": net.out, "shift": np.array([net.shift])}
    mean = {k: np.zeros_like(v) for k, v in params.items()}
    square = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), batch):
            grad = {n: np.zeros_like(v) for n, v in params.items()}
            net.shift, net._pairs = float(params["shift"][0]), None
            some = order[k:k + batch]
            for i in some:
                _backward(net, data[i], labels[i], grad)
            step += 1
            lr = rate * (1 - 0.9 * (epoch * len(order) + k) / (epochs * len(order)))
            for n, v in params.items():
                g = grad[n] / len(some)
                mean[n] = 0.9 * mean[n] + 0.1 * g
                square[n] = 0.999 * square[n] + 0.001 * g * g
                v -= lr * (mean[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.999 ** step)) + 1e-8)
    net.shift, net._pairs = float(params["shift"][0]), None
    return net


def _backward(net: ByteNet, data: bytes, label: int, grad: dict) -> None:
    import numpy as np
    tops, at = [], []
    for m, part in net.chunks(data):
        windows = np.lib.stride_tricks.sliding_window_view(part, CHUNK + WIDTH - 1)[::STRIDE][:m]
        r = sum(net.conv[j][windows[:, j:j + CHUNK]] for j in range(WIDTH))
        where = r.argmax(axis=1)
        tops.append(np.take_along_axis(r, where[:, None, :], axis=1)[:, 0, :])
        at.append(np.stack([np.take_along_axis(windows, where + j, axis=1) for j in range(WIDTH)]))
    r, bytes_at = np.concatenate(tops) + net.bias, np.concatenate(at, axis=1)
    active = np.maximum(r, 0)
    best, filters = active.argmax(axis=0), np.arange(FILTERS)
    features = np.concatenate([active.max(axis=0), active.mean(axis=0)])
    z = features @ net.out + net.shift
    delta = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
    grad["out"] += delta * features
    grad["shift"] += delta
    g = np.tile(delta * net.out[FILTERS:] / len(r), (len(r), 1))
    g[best, filters] += delta * net.out[:FILTERS]
    g *= r > 0
    grad["bias"] += g.sum(axis=0)
    for j in range(WIDTH):
        np.add.at(grad["conv"][j], (bytes_at[j], filters[None, :]), g)


def _excerpt(text, key, longest: int):
    """The UTF-8 bytes of a text; of one over ``longest`` bytes as many whole
    chunks as fit, one at a hashed place of each of as many equal stretches of
    the whole text."""
    data, n = F.encode(text, "UTF-8"), max(1, longest // CHUNK)
    wide = F.floor(F.octet_length(text) / n)
    chunk = lambda k: F.substring(data, (k * wide + F.pmod(F.xxhash64(key, k), F.greatest(
        wide - CHUNK, F.lit(0)) + 1) + 1).cast("int"), F.lit(CHUNK))
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), chunk)
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x))
    return F.when(F.octet_length(text) <= longest, data).otherwise(joined)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text",
        id_col: str = "doc_id", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES, **params) -> ByteNet:
    """Learn from labelled documents that are not held out: at most ``rows``
    of each class, in the order of a hash of the id.  A text of more than
    ``longest`` bytes teaches by chunks from hashed places of the whole of it.
    Rows without id or label teach nothing; an id labelled more than once
    counts with its smallest label.  The sample holds the classes in equal
    parts; the fitted odds are then moved to those of all labels.  Where the
    documents lack a class, the network is constant (see ``train``)."""
    i, y = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    known = labels.filter(i.isNotNull() & y.isin(0, 1) & ~held_out(id_col)).groupBy(i.alias("_llm_id")).agg(
        F.min(y).alias("y"))
    known = cut(known)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = (F.xxhash64("_llm_id"), F.col("_llm_id"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    fit_for = cut(known.join(docs.select(i.alias("_llm_i")), F.col("_llm_id") == F.col("_llm_i"), "left_semi"))
    chosen = cut(fit_for.filter("y = 0").orderBy(*order).limit(rows).union(
        fit_for.filter("y = 1").orderBy(*order).limit(rows)))
    # at most 2 x rows ids; rows that repeat an id teach by their smallest excerpt
    sample = (docs.select(i.alias("_llm_i"), text.alias("t"))
              .join(F.broadcast(chosen), F.col("_llm_i") == F.col("_llm_id"))
              .select("_llm_id", "y", _excerpt(F.col("t"), F.col("_llm_id"), longest).alias("t"))
              .groupBy("_llm_id").agg(F.min(F.struct("t", "y")).alias("s")).orderBy(*order)
              .select("s.t", "s.y").collect())
    ys = [int(r["y"]) for r in sample]
    net = train([bytes(r["t"]) for r in sample], ys, **params)
    if len(set(ys)) == 2:
        net.shift += math.log(counts[1] / counts[0]) - math.log(sum(ys) / (len(ys) - sum(ys)))
    return net


def score(docs: DataFrame, net: ByteNet, text_col: str = "text") -> DataFrame:
    """Add ``score`` (the probability of label 1) and ``predicted`` (1 from
    0.5 on).  Null and empty texts are scored as a text without bytes; every
    row stays; input columns named like an output are replaced."""
    prepare(docs.sparkSession)
    weights = (net.conv, net.bias, net.out, net.shift)

    def run(batches):
        here = ByteNet(*weights)
        for texts in batches:
            yield texts.map(here.score).astype("float64")

    docs = docs.select(*keep_columns(docs, ["score", "predicted"]))
    scored = docs.withColumn("score", _series_udf(run)(F.col(f"`{text_col}`").cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _series_udf(run):
    from collections.abc import Iterator

    import pandas as pd

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(batches)

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")
