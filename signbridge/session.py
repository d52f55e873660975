"""Session helpers: building a session, the checkpoint folder, checked broadcasts."""

from __future__ import annotations

import os
import sysconfig
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast budget for sides whose size we check at run time (rows x row bytes).
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "signbridge") -> SparkSession:
    """Return the active session, or build one with AQE and Arrow enabled."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode runs every task inside the driver JVM: give it a real heap
        builder = builder.config("spark.driver.memory", os.environ.get("SIGNBRIDGE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure `DataFrame.checkpoint()` has a folder.

    The cluster names its shared folder in ``spark.checkpoint.dir``; we use it as is.
    Only a local-mode session without that setting (tests) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="signbridge-ckpt-")
    sc.setCheckpointDir(local_dir)
    return local_dir


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once per application.

    Where the folder that holds the package is on PYTHONPATH, or the package is installed, workers
    find it; else Spark hands them a zip of it, as ``--py-files`` would."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), sysconfig.get_paths()["purelib"]]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, filter(None, known)):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="signbridge-"), "signbridge.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder (survives executor loss).

    The frame is persisted while it is checkpointed, so it is computed once (the
    checkpoint write otherwise recomputes it after the materialising job)."""
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def checked_broadcast(df: DataFrame, max_bytes: int, row_bytes: Column) -> DataFrame:
    """Hint a broadcast only when the side, measured in full, holds at most ``max_bytes``.

    Beyond the bound the frame is returned unchanged, and the join is planned as a
    shuffle join (AQE may still switch it at run time from measured shuffle sizes)."""
    size = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if int(size) <= max_bytes else df


def default_parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))

