"""Sums of integers by 64-bit keys that many blocks of documents hold, told
back to every block that asked.

A block sends each of its distinct keys once, packed with its number for it;
keys are spread evenly over buckets by their value, a bucket adds the numbers
of all blocks up and answers each block for its own keys in its own order.  So
neither a frequent key nor a large group lands in one task: a key comes at
most once from a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import work_path

SUMS = "block long, bucket long, sums binary, new long"
TOGETHER = 16         # blocks, and buckets of their keys, that one task may hold
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pack(a: np.ndarray) -> bytes:
    """Integers of 64 bits, byte by byte of their weight, compressed."""
    planes = np.ascontiguousarray(a.astype("<i8" if a.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(z: bytes, dtype="<u8") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their distances."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(z: bytes) -> np.ndarray:
    return np.cumsum(unpack(z), dtype=np.uint64)


def pack_signed(a: np.ndarray) -> bytes:
    a = a.astype(np.int64)
    return pack(((a << 1) ^ (a >> 63)).view(np.uint64))


def unpack_signed(z: bytes) -> np.ndarray:
    a = unpack(z)
    return ((a >> np.uint64(1)) ^ (~(a & np.uint64(1)) + np.uint64(1))).view(np.int64)


def _add_up(batches):
    """The sums of a bucket, for each block in the order of its keys.  ``new``
    counts the keys of the bucket with a sum above zero, once."""
    for b in batches:
        for bucket, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keys = [unpack_keys(a["keys"]) for a in asks]
            all_, which = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(all_), np.int64)
            np.add.at(sums, which, np.concatenate([unpack_signed(a["nums"]) for a in asks]))
            told = np.split(sums[which], np.cumsum([len(k) for k in keys])[:-1])
            new = [int((sums > 0).sum())] + [0] * (len(asks) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a["block"] for a in asks], pa.int64()), pa.array([bucket] * len(asks), pa.int64()),
                 pa.array([pack_signed(t) for t in told], pa.binary()), pa.array(new, pa.int64())],
                ["block", "bucket", "sums", "new"])


def ask(blocks: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], n_buckets: int) -> DataFrame:
    """``(block, bucket, sums, new)``, written below the checkpoint folder.
    ``keys_of`` gives, for a row of ``blocks`` (with a column ``block``), its
    distinct keys in ascending order and a number for each."""
    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                keys, nums = keys_of(row)
                if not len(keys):
                    continue
                bucket = (((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at]), pa.array(np.full(len(at), row["block"], np.int64)),
                     pa.array([pack_keys(k) for k in np.split(keys, at[1:])], pa.binary()),
                     pa.array([pack_signed(n) for n in np.split(nums, at[1:])], pa.binary())],
                    ["bucket", "block", "keys", "nums"])

    spark = blocks.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_buckets // TOGETHER + 1)
    folder = work_path(spark, "sums")
    blocks.mapInArrow(send, "bucket long, block long, keys binary, nums binary") \
        .repartition(n_parts, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("block", "keys", "nums"))) \
        .mapInArrow(_add_up, SUMS).write.parquet(folder)
    return spark.read.schema(SUMS).parquet(folder)


def parts_for(docs: DataFrame, text_col: str, block: int) -> int:
    """Partitions such that one holds about ``TOGETHER`` blocks."""
    conf = docs.sparkSession.conf
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("long"))).first()[0] or 0
    return max(int(conf.get("spark.sql.shuffle.partitions")),
               min(size // (TOGETHER * block) + 1, int(conf.get("spark.sql.sources.bucketing.maxBuckets"))))


@contextmanager
def kept_by_block(blocks: DataFrame, n_parts: int):
    """``blocks`` written once below the checkpoint folder, bucketed by block,
    so that joins on the block move only their other side.  The table goes
    from the catalog in the end."""
    spark = blocks.sparkSession
    name = f"strata_blocks_{uuid.uuid4().hex}"
    blocks.repartition(n_parts, "block").write.bucketBy(n_parts, "block").option("path", work_path(spark, "blocks")) \
        .option("compression", "none").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def answered(blocks: DataFrame, sums: DataFrame, name: str) -> DataFrame:
    """``blocks`` with the answers as a column of (bucket, sums)."""
    told = sums.select(F.col("block").alias("block_"), "bucket", "sums").groupBy("block_").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "sums"))).alias(name))
    return blocks.join(told.hint("shuffle_hash"), F.col("block") == F.col("block_"), "left").drop("block_")


def sums_of(told: list[dict] | None) -> np.ndarray:
    """The answers of a block in the order of its keys."""
    return np.concatenate([unpack_signed(t["sums"]) for t in told]) if told else np.zeros(0, np.int64)
