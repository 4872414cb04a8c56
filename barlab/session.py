"""Session factory with the settings every barlab job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "barlab", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC time zone and adaptive execution.

    On a cluster leave ``master`` unset: partition counts are then left to AQE, which splits skewed
    partitions and coalesces small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; set a local one only when none is named."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (spark.sparkContext.master + "[").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder holds data files; errors of the store are raised, not taken for an empty table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return False
    found = fs.listFiles(root, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return True
    return False


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there: later steps that read it several times
    neither replan nor recompute it, and losing executors does not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
