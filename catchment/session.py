"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_stages: dict[str, list[str]] = {}


def build_session(app: str = "catchment", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = (builder.master(master).config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose driver is its one executor may go without: it gets a temporary
    folder. On a cluster every node would write to its own disk, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="catchment-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether driver and executor are one process."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used twice; see ``drop_stages``."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> list[str]:
    """Delete the stages this application has written, once their results are stored.

    Tables that were not yet written elsewhere can no longer be read afterwards.
    """
    paths = _stages.pop(spark.sparkContext.applicationId, [])
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return paths


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread narrow rows over all cores before a step that multiplies their work.

    Adaptive execution would merge such small partitions into one task; an explicit
    partition count is kept.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    return df.repartition(count, *keys)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and survives lost executors, and lets several consumers
    share one computation without keeping it in executor memory.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
