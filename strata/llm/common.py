"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import ensure_checkpoint_dir, freed_shuffles, ship_package  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder known and this package importable on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    return F.translate(c, UPPER, UPPER.lower())


def keep_columns(df: DataFrame, new: Sequence[str]) -> list[Column]:
    """Input columns that an operator passes on: an operator's own output
    column replaces an input column of the same name."""
    own = {c.lower() for c in new}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in own]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for loops that join their own
    result again and again.  A checkpoint keeps the planner's size estimate,
    which for a join is the product of its inputs: in such a loop it squares
    with each round and becomes a number of hundreds of megabytes on the
    driver.  What is read from files has the size of the files."""
    folder = work_path(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that nothing reads any more, so
    that a loop keeps the last table only."""
    spark = df.sparkSession
    try:
        sc = spark.sparkContext
    except Exception:  # no local SparkContext: the files go with the shared folder
        return
    root = ensure_checkpoint_dir(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder:  # below the shared folder, never an input
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
