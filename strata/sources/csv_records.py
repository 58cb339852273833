"""CSV files whose quoted cells hold line breaks, read in many tasks (S-1).

Spark reads such a file whole in one task.  Here its lines are read like any
text file, by splits, and put together to records:

* A line is a function of whether it begins inside a quoted cell: it ends
  inside or not.  Two results a line say all, so lines compose without knowing
  what stands before them.
* Every split keeps, for both cases, the state and the record start of each of
  its lines.  The functions of whole splits are composed by a window over the
  splits of a file, which tells the state that each really begins with.
* A line that begins and ends outside is a record as it stands.  Only the lines
  of records with breaks are shuffled, by the place where the record begins.

A quote opens a cell only where the cell begins; a quote inside a cell is
doubled; other quotes are text.  Lines end in a line feed, with or without a
carriage return.  The first line of a file begins its header; empty lines are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.session import cut_lineage

#: splits that are sent to all tasks; more are joined by shuffle
FEW_SPLITS = 100_000

#: as read_cohort reads cells
CELLS = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
         "nullValue": "\u0000", "emptyValue": ""}


def ends_inside(line: Column) -> Column:
    """(from outside, from inside): whether the line ends in a quoted cell."""
    def quote(state: Column, before: Column) -> Column:
        # 0: outside, 1: inside, 2: a quote inside has just closed or is half of a doubled one
        return F.when(state == 1, 2).when((state == 2) & (before == ""), 1).when(before.endswith(","), 1).otherwise(0)

    parts = F.split(F.concat(F.lit(","), line), '"')
    ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")),
                       lambda s, before: F.struct(quote(s["a"], before).alias("a"), quote(s["b"], before).alias("b")))
    plain = F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))
    return F.when(line.contains('"'), ends).otherwise(plain)


def _after(out: np.ndarray, within: np.ndarray, start: int) -> np.ndarray:
    """The state after each line, from the state before the first."""
    flips = np.cumsum(out & ~within)
    at = np.maximum.accumulate(np.where(out == within, np.arange(len(out)), -1))
    since = np.where(at >= 0, flips - flips[at], flips)
    return np.where(at >= 0, out[at], bool(start)) ^ (since % 2 == 1)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the lines of each split; for both states that the split may
    begin with: the state before and after the line, and the number of the line
    that begins its record (-1: in an earlier split)."""
    last, n, state, begin = None, 0, [0, 1], [-1, -1]
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column("file"), b.column("block")
        new = np.ones(b.num_rows, dtype=bool)
        new[0] = last != (file[0], block[0])
        new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        last = file[-1], block[-1]
        cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), b.num_rows]
        out, within = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "within"))
        numbers, found = np.empty(b.num_rows, dtype=np.int64), [[], []]
        for low, high in zip(cuts, cuts[1:]):
            if new[low]:
                n, state, begin = 0, [0, 1], [-1, -1]
            numbers[low:high] = np.arange(n, n + high - low)
            for h in (0, 1):
                after = _after(out[low:high], within[low:high], state[h])
                before = np.r_[bool(state[h]), after[:-1]]
                starts = np.maximum.accumulate(np.r_[begin[h], np.where(before, -1, numbers[low:high])])[1:]
                state[h], begin[h] = int(after[-1]), int(starts[-1])
                found[h].append((before, after, starts))
            n += high - low
        cols = [pa.array(np.concatenate(x)) for f in found for x in zip(*f)]
        keep = [i for i, name in enumerate(b.schema.names) if name not in ("out", "within")]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(numbers), *cols], [
            *[b.schema.names[i] for i in keep], "line", "before0", "after0", "begin0", "before1", "after1", "begin1"])


_PLACED = "line long, before0 boolean, after0 boolean, begin0 long, before1 boolean, after1 boolean, begin1 long"


def _splits(places: DataFrame) -> DataFrame:
    """A row a split: whether it begins inside a cell, and where the record
    begins that is open there."""
    ends = places.groupBy("file", "block").agg(F.max_by("after0", "line").alias("a"), F.max_by("after1", "line").alias("b"),
                                               F.max("begin0").alias("begin0"), F.max("begin1").alias("begin1"))
    flip = F.sum((F.col("a") & ~F.col("b")).cast("int"))
    w = Window.partitionBy("file").orderBy("block")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    # the state after the last split that leaves no choice, turned by the flips since
    kept = ends.withColumn("set", F.when(F.col("a") == F.col("b"), F.col("a").cast("int") + flip.over(upto)))
    start = (F.coalesce(F.last("set", True).over(earlier), F.lit(0)) + F.coalesce(flip.over(earlier), F.lit(0))) % 2 == 1
    own = F.when(F.col("inside"), F.col("begin1")).otherwise(F.col("begin0"))
    return kept.withColumn("inside", start).withColumn("own", F.when(own >= 0, F.struct("block", own.alias("line")))) \
        .select("file", "block", "inside", F.last("own", True).over(earlier).alias("open"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under ``path`` as they stand (file, block, line
    of their first line, record)."""
    text = spark.read.option("lineSep", "\n").text(path)
    ends = ends_inside(F.col("value"))
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        ends.alias("ends")).select("value", "file", "block", (F.col("ends.a") == 1).alias("out"),
                                                   (F.col("ends.b") == 1).alias("within"))
    key = "file string, block long, "
    splits = cut_lineage(_splits(lines.drop("value").mapInArrow(_places, key + _PLACED)))
    placed = lines.mapInArrow(_places, "value string, " + key + _PLACED)
    joined = placed.join(F.broadcast(splits) if splits.count() <= FEW_SPLITS else splits, ["file", "block"])
    real = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    here = F.when(real("begin") >= 0, F.struct("block", real("begin").alias("line"))).otherwise(F.col("open"))
    judged = joined.select("file", "block", "line", "value", real("before").alias("before"), real("after").alias("after"),
                           here.alias("first"))
    whole = judged.where(~F.col("before") & ~F.col("after")).select("file", "block", "line", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    broken = judged.where(F.col("before") | F.col("after")).groupBy("file", "first").agg(parts.alias("parts")).select(
        "file", "first.block", "first.line", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(broken).withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text, under the given column names."""
    found = records(spark, path).where(~((F.col("block") == 0) & (F.col("line") == 0)) & (F.col("record") != ""))
    ddl = ", ".join(f"c{i} string" for i in range(len(columns)))
    return found.select(F.from_csv("record", ddl, CELLS).alias("r")).select(
        *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
