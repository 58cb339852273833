"""Spark session helpers.

On a cluster the session is built by the platform; we only read its
settings.  ``spark.checkpoint.dir`` must name a shared folder there; we set
our own (under a fresh scratch folder) only when it is unset, as in tests.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "strata") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only
    when none is named and the session runs on this machine alone."""
    current = spark.conf.get(_CHECKPOINT_KEY, None)
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local SparkContext (remote client)
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current and sc is not None and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not current:
        current = tempfile.mkdtemp(prefix="strata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(_CHECKPOINT_KEY, current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, the shuffle files of each job go when it ends, since the next
    one reads its written result; afterwards the session's own setting holds."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def spread(df, *cols):
    """Hash-repartition ``df`` across the cluster's cores when its scan has
    fewer partitions than that (a large, unsplittable file), before a
    CPU-heavy per-row stage.  An explicit partition count is used, so AQE
    keeps it; with enough input partitions this is a no-op."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except Exception:  # no local SparkContext: leave partitioning to the server
        return df
    return df.repartition(target, *cols) if cols else df.repartition(target)


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make ``strata`` importable in the Python workers (the Arrow-batched
    stages reference its functions): zip the package into the session's
    checkpoint folder, whatever its file system, once per application and
    ``addPyFile`` it, so that executors that start later fetch it too."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: the package must be installed server-side
        return
    if sc.applicationId in _SHIPPED:
        return
    import io
    import uuid
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    name = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/strata-{uuid.uuid4().hex[:8]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(name)
    _SHIPPED[sc.applicationId] = name
