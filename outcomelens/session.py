"""Session construction and the shared folders a job may write to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "outcomelens", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators expect.

    AQE coalesces small shuffle partitions and splits skewed join partitions; cluster sizing
    (executors, memory, shuffle partitions) is left to spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="outcomelens-"))
    return spark.sparkContext.getCheckpointDir()


_made: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; what is there is removed when the process ends, or by ``drop_scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(drop_scratch)
    _made.append((spark, path))
    return path


def drop_scratch() -> None:
    """Remove what this process wrote to scratch paths; frames that read it are of no use afterwards."""
    while _made:
        spark, path = _made.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the cluster is gone already: the folder's owner cleans it
            continue


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` out once (reliable checkpoint) so later branches read it instead of rerunning it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def sized(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared folder and read again: the planner then knows its size, also where that follows from an aggregate."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
