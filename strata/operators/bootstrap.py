"""E-11: bootstrap confidence intervals of AUROC / average precision.

Poisson bootstrap: in replicate r every row gets an independent Poisson(1)
weight drawn by inverse CDF from a uniform that is a pure function of
(seed, id, r): one md5 of ``'seed:id'`` per row gives a 32-bit row seed,
and a 32-bit integer mixer turns (row seed, r) into the replicate's draw.  This is the
standard distributed form of resampling with replacement (same limiting
distribution, no global index, no driver loop), and it is deterministic:
the weights depend only on (seed, replicate, id), so a lost executor
recomputes exactly the same replicate.

Plan shape: numpy draws the weights inside each task.  Few distinct scores are
summed to one row per ``(replicate, score, label)`` before the shuffle, and
rank sums run over those; with many, rows are dealt by score ranges once and
only ranges x replicates are added up between them.  Replicates with
one class only are skipped, as in the reference, and the report is the
mean of the replicate values with the 2.5 / 97.5 percentiles (exact,
linear interpolation).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from strata.functions import hashing as H
from strata.functions.hashing import md5_seed32, poisson1_weight, with_mix32_uniform
from strata.operators import metrics as M
from strata.session import cut_lineage, spread

REPLICATE_CHUNK = 64  # replicates drawn per numpy pass (rows x chunk matrix)


def replicate_weights(df: DataFrame, id_col: str, B: int, seed: int) -> DataFrame:
    """Rows x replicates with their Poisson(1) weights ``_w``.

    Zero weights are kept (they add nothing to the sums): a filter on the
    weight would be pushed below the projection and re-evaluate the draw.
    """
    r = df.withColumn("_s", md5_seed32(seed, id_col))
    r = r.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(B - 1))))
    r = with_mix32_uniform(r, F.col("_s"), F.col("replicate"), "_u")
    return r.withColumn("_w", poisson1_weight(F.col("_u"))).drop("_u", "_s")


def numpy_weights(seed32: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """The same Poisson(1) draws as :func:`replicate_weights`, as a
    (rows x replicates) matrix: identical integer mixer, identical
    inverse-CDF table (smallest k with u <= F(k))."""
    mask = np.uint64(H._MASK32)
    h = seed32.astype(np.uint64)[:, None] ^ ((replicates.astype(np.uint64) * np.uint64(H._STRIDE)) & mask)[None, :]
    h = (((h >> np.uint64(16)) ^ h) * np.uint64(H._MIX)) & mask
    h = (((h >> np.uint64(16)) ^ h) * np.uint64(H._MIX)) & mask
    h = (h >> np.uint64(16)) ^ h
    u = (h.astype(np.float64) + 0.5) / H._TWO32
    return np.searchsorted(np.array(H.poisson1_cdf()), u, side="left").astype(np.int64)


def replicate_score_groups(df: DataFrame, y: str, p: str, id_col: str, B: int, seed: int,
                           keys: Sequence[str] = ()) -> DataFrame:
    """(keys, replicate, p, _tp, _fp): replicate-weighted class counts per
    distinct score.

    Spark hashes each row's id once (md5) and partitions the rows; inside
    each task numpy draws the rows x replicates weights chunk by chunk and
    sums them per (keys, score, label) group of the Arrow batch, so what
    leaves the task is groups x replicates, not rows x replicates.  The
    shuffle then adds the per-batch partial sums (a hot score value is
    split across all tasks that hold it)."""
    keys = list(keys)
    # pandas does not tell NaN from null, so NaN travels as a mark
    x = F.col(p).cast("double")
    base = spread(df.select(*keys, F.when(~F.isnan(x), x).alias("_p"), F.coalesce(F.isnan(x), F.lit(False)).alias("_nan"),
                            F.col(y).cast("int").alias("_y"), md5_seed32(seed, id_col).alias("_s")), "_s")
    gcols = [*keys, "_p", "_nan", "_y"]
    key_fields = [f for f in base.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, T.StructField("replicate", T.IntegerType()),
                           T.StructField("_p", T.DoubleType()), T.StructField("_nan", T.BooleanType()),
                           T.StructField("_y", T.IntegerType()),
                           T.StructField("_w", T.LongType())])

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            codes, _ = pd.MultiIndex.from_frame(pdf[gcols]).factorize()
            order = np.argsort(codes, kind="stable")
            sc = codes[order]
            starts = np.flatnonzero(np.r_[True, sc[1:] != sc[:-1]])
            groups = pdf[gcols].iloc[order[starts]].reset_index(drop=True)
            seeds = pdf["_s"].to_numpy()[order]
            n_g = len(starts)
            for r0 in range(0, B, REPLICATE_CHUNK):
                reps = np.arange(r0, min(B, r0 + REPLICATE_CHUNK))
                w = np.add.reduceat(numpy_weights(seeds, reps), starts, axis=0)  # groups x chunk
                out = {c: np.repeat(groups[c].to_numpy(), len(reps)) for c in gcols}
                out["replicate"] = np.tile(reps.astype(np.int32), n_g)
                out["_w"] = w.reshape(-1)
                yield pd.DataFrame(out)[[*keys, "replicate", "_p", "_nan", "_y", "_w"]]

    parts = base.mapInPandas(run, schema)
    score = F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_p"))
    return parts.groupBy(*keys, "replicate", score.alias(p)).agg(
        F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)).cast("long").alias("_tp"),
        F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0)).cast("long").alias("_fp"))


#: rows of a score range; replicates whose sums travel as one row; and the
#: numbers (distinct scores x replicates) up to which scores are grouped first
RANGE_ROWS, TOGETHER, GROUPED = 250_000, 100, 5_000_000


def _key_runs(table: pa.Table, keys: Sequence[str]) -> list[tuple[tuple, slice]]:
    """The stretches of equal keys in sorted rows."""
    if not table.num_rows:
        return []
    if not keys:
        return [((), slice(0, table.num_rows))]
    codes = np.stack([pc.fill_null(table[k].combine_chunks().dictionary_encode(null_encoding="mask").indices, -1).to_numpy(
        zero_copy_only=False) for k in keys])
    start = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])
    return [(tuple(table[k][int(i)].as_py() for k in keys), slice(int(i), int(j)))
            for i, j in zip(start, np.r_[start[1:], table.num_rows])]


def _score_starts(p: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Where a new score begins in sorted rows (equal nulls, equal NaN)."""
    same = (p[1:] == p[:-1]) | (np.isnan(p[1:]) & np.isnan(p[:-1]))
    return np.flatnonzero(np.r_[True, ~(same & (null[1:] == null[:-1]))])


def _group_sums(run: pa.Table, starts: np.ndarray, replicates: np.ndarray):
    """Weights of both classes by (score, replicate)."""
    y, s = run["_y"].to_numpy(), run["_s"].to_numpy()
    out = np.zeros((2, len(starts), len(replicates)), np.int64)
    for k in range(0, len(replicates), 16):
        w = numpy_weights(s, replicates[k:k + 16])
        for c in (1, 0):
            out[1 - c, :, k:k + 16] = np.add.reduceat(np.where((y == c)[:, None], w, 0), starts, axis=0)
    return out


def _terms(pos: np.ndarray, neg: np.ndarray, pos_to: np.ndarray, neg_to: np.ndarray):
    """Parts of the AUROC and AP numerators of scores whose weights are
    ``pos``, ``neg``; ``..._to`` are the sums from the highest score on."""
    n = pos_to + neg_to
    return neg * (pos_to - pos / 2.0), np.divide(pos * pos_to, n, out=np.zeros(n.shape), where=n > 0)


def _ranged_replicates(df: DataFrame, y: str, p: str, id_col: str, B: int, seed: int, keys: Sequence[str], n_rows: int) -> DataFrame:
    """(keys, replicate, _auc_num, _ap_num, n_pos, n_neg) for many distinct
    scores.  Rows are dealt by score ranges once; each range sends its sums per
    replicate (those of its first and its last score apart, since the next range
    may hold more of them), a running sum over the ranges of a key gives what
    lies above each range, and the ranges finish with that.  What is shuffled is
    the rows and ranges x replicates, not scores x replicates."""
    keys = list(keys)
    base = df.select(*[F.col(k) for k in keys], F.col(p).cast("double").alias("_p"), F.col(y).cast("int").alias("_y"),
                     md5_seed32(seed, id_col).alias("_s"))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // RANGE_ROWS + 1)
    # the row's seed splits a score that very many rows share
    order = [*[F.col(k) for k in keys], F.col("_p").desc(), F.col("_s")]
    rows = cut_lineage(base.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    key_fields = [f for f in base.schema.fields if f.name in keys]
    key_types = [(f.name, to_arrow_type(f.dataType)) for f in key_fields]
    chunks = [np.arange(a, min(a + TOGETHER, B)) for a in range(0, B, TOGETHER)]

    def table_of(t: pa.Table) -> pa.Table:
        return t.sort_by([(k, "ascending") for k in keys] + [("_p", "descending")]) if t.num_rows else t

    def runs_of(t: pa.Table):
        """NaN first, then falling scores, nulls last."""
        for key, at in _key_runs(table_of(t), keys):
            run = table_of(t).slice(at.start, at.stop - at.start)
            null = run["_p"].is_null().to_numpy()
            score = run["_p"].fill_null(0.0).to_numpy()
            first = np.argsort(np.where(null, 2, np.where(np.isnan(score), 0, 1)), kind="stable")
            run, null, score = run.take(pa.array(first)), null[first], score[first]
            yield key, run, null, score, _score_starts(score, null)

    part_names = [*keys, "_range", "_chunk", "first", "last", "single", "sums"]

    def totals(t: pa.Table) -> pa.Table:
        out = []
        for key, run, null, score, starts in runs_of(t):
            label = lambda i: "null" if null[i] else repr(float(score[i]) + 0.0)  # noqa: E731, B023
            for c, replicates in enumerate(chunks):
                g = _group_sums(run, starts, replicates)
                some = np.stack([g[:, 0], g[:, 1:-1].sum(axis=1), g[:, -1]])
                out.append((*key, run["_range"][0].as_py(), c, label(0), label(starts[-1]), len(starts) == 1, some.tobytes()))
        return _table(out, part_names, [*key_types, ("_range", pa.int64()), ("_chunk", pa.int64()), ("first", pa.string()),
                                        ("last", pa.string()), ("single", pa.bool_()), ("sums", pa.binary())])

    above_types = [*key_types, ("_range", pa.int64()), ("_chunk", pa.int64()), ("above", pa.binary()), ("terms", pa.binary()),
                   ("total", pa.binary())]

    def running(t: pa.Table) -> pa.Table:
        parts = t.sort_by("_range").to_pylist()
        c = parts[0]["_chunk"]
        key = tuple(parts[0][k] for k in keys)
        seen, terms = np.zeros((2, len(chunks[c])), np.int64), np.zeros((2, len(chunks[c])))
        label, held, out = None, None, []

        def settle():
            nonlocal seen
            if held is not None:
                seen = seen + held
                terms[0], terms[1] = terms + np.stack(_terms(*held, *seen))

        for r in parts:
            first, inner, last = np.frombuffer(r["sums"], np.int64).reshape(3, 2, -1)
            if r["first"] == label:
                held = held + first
            else:
                settle()
                held = first
            label = r["first"]
            if not r["single"]:
                settle()
                out.append((*key, r["_range"], c, seen.tobytes(), None, None))
                seen, held, label = seen + inner, last, r["last"]
        settle()
        out.append((*key, None, c, None, terms.tobytes(), seen.tobytes()))
        return _table(out, [n for n, _ in above_types], above_types)

    def finish(t: pa.Table, above: pa.Table) -> pa.Table:
        known = {(*(r[k] for k in keys), r["_chunk"]): np.frombuffer(r["above"], np.int64).reshape(2, 1, -1) for r in above.to_pylist()}
        out = []
        for key, run, _, _, starts in runs_of(t):
            for c, replicates in enumerate(chunks):
                if len(starts) > 2 and (*key, c) in known:
                    g = _group_sums(run, starts, replicates)[:, 1:-1]
                    upto = known[*key, c] + g.cumsum(axis=1)
                    out.append((*key, None, c, None, np.stack([x.sum(axis=0) for x in _terms(*g, *upto)]).tobytes(), None))
        return _table(out, [n for n, _ in above_types], above_types)

    def added(t: pa.Table) -> pa.Table:
        c = t["_chunk"][0].as_py()
        terms = sum(np.frombuffer(x).reshape(2, -1) for x in sorted(t["terms"].to_pylist()))
        total = next(np.frombuffer(x, np.int64).reshape(2, -1) for x in t["total"].to_pylist() if x is not None)
        out = [(*(t[k][0].as_py() for k in keys), int(r), *map(float, terms[:, i]), *map(int, total[:, i])) for i, r in enumerate(chunks[c])]
        return _table(out, [n for n, _ in last_types], last_types)

    last_types = [*key_types, ("replicate", pa.int32()), ("_auc_num", pa.float64()), ("_ap_num", pa.float64()), ("n_pos", pa.int64()),
                  ("n_neg", pa.int64())]
    ddl = lambda types: T.StructType([*key_fields, *[T.StructField(n, from_arrow_type(k)) for n, k in types[len(keys):]]])
    part_types = [*key_types, ("_range", pa.int64()), ("_chunk", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                  ("single", pa.bool_()), ("sums", pa.binary())]
    by_range = rows.groupBy("_range")
    sums = by_range.applyInArrow(totals, ddl(part_types))
    above = cut_lineage(sums.groupBy(*keys, "_chunk").applyInArrow(running, ddl(above_types)))
    inner = by_range.cogroup(above.where("_range is not null").groupBy("_range")).applyInArrow(finish, ddl(above_types))
    return above.where("_range is null").unionByName(inner).groupBy(*keys, "_chunk").applyInArrow(added, ddl(last_types))


def _table(rows: list[tuple], names: Sequence[str], types) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cols, types)], names=list(names))


def replicate_metrics(df: DataFrame, y: str = "y", p: str = "p", id_col: str = "id", B: int = 1000,
                      seed: int = 42, keys: Sequence[str] = (), score_decimals: int | None = None) -> DataFrame:
    """AUROC and AUPRC of every non-degenerate replicate (keys, replicate).

    Few distinct scores are grouped first (a row per score and replicate);
    where these are many, rows are dealt by score ranges instead
    (:func:`_ranged_replicates`).  Draws and results are the same.
    ``score_decimals`` (off by default) rounds the scores first."""
    keys = list(keys)
    if score_decimals is not None:
        df = df.withColumn(p, F.round(F.col(p).cast("double"), int(score_decimals)))
    probe = df.select(*keys, p).distinct()
    if probe.count() * B > GROUPED:
        r = _ranged_replicates(df, y, p, id_col, B, seed, keys, df.count())
        pairs = F.col("n_pos") * F.col("n_neg")
        rm = r.select(*keys, "replicate", F.try_divide("_auc_num", pairs).alias("AUROC"),
                      F.try_divide("_ap_num", "n_pos").alias("AUPRC"), "n_pos", "n_neg")
    else:
        g = replicate_score_groups(df, y, p, id_col, B, seed, keys)
        curve = M.rank_curve(None, y, p, keys=[*keys, "replicate"], grouped=g, probe=probe)
        rm = M.rank_metrics_from_curve(curve, [*keys, "replicate"])
    return rm.where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))


def bootstrap_ci(df: DataFrame, y: str = "y", p: str = "p", id_col: str = "id", metric: str = "AUROC",
                 B: int = 1000, seed: int = 42, keys: Sequence[str] = (),
                 score_decimals: int | None = None) -> DataFrame:
    """Mean, 2.5 % and 97.5 % of ``metric`` (AUROC or AUPRC) over replicates."""
    if metric not in ("AUROC", "AUPRC"):
        raise ValueError("metric must be AUROC or AUPRC")
    rm = replicate_metrics(df, y, p, id_col, B, seed, keys, score_decimals)
    q = F.percentile(F.col(metric), F.array(F.lit(0.025), F.lit(0.975)))
    return (rm.groupBy(*keys)
            .agg(F.avg(metric).alias("mean"), q.alias("_q"), F.count(F.lit(1)).alias("n_replicates"))
            .select(*keys, "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"),
                    "n_replicates"))
