"""The cascade's narrow operators on a stream (C-1, C-5, P-10).

Scoring and combining are per-row projections, so the batch code runs
unchanged on a streaming DataFrame: ``readStream`` over a folder of files
-> derive the stage scores -> ``cascade.predictions`` -> ``writeStream``
to a Parquet sink.  The query checkpoints its progress (offsets + commits)
under the session's checkpoint folder, so a restarted job resumes where it
stopped and a lost executor only replays its micro-batch; the file sink is
exactly-once.  No state store is involved (no aggregation), so there is no
watermark to manage.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.operators import cascade as C
from strata.session import ensure_checkpoint_dir


def stream_cascade(spark: SparkSession, source_dir: str, schema: str, derive: Callable[[DataFrame], DataFrame],
                   out_dir: str | None = None, threshold: float = 0.5, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> str:
    """Run the cascade over every file currently in ``source_dir`` (an
    ``availableNow`` trigger: all available data, in micro-batches, then
    stop) and return the sink folder.  ``derive`` maps the raw stream to
    (id, y, p1, p2)."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", f"cascade-{uuid.uuid4().hex[:8]}")
    out_dir = out_dir or os.path.join(base, "out")
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(source_dir)
    pred = C.predictions(derive(raw), "id", "y", "p1", "p2", threshold)
    q = (pred.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", os.path.join(base, "checkpoint"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return out_dir
