"""Session helpers. On a cluster the session comes from the cluster's own configuration."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "blockloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-node runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="blockloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or what setCheckpointDir() was given.

    A session of one machine (local[...]) may do without and gets a temporary folder; any other
    needs one, as executors would else write to disks that nobody else reads.
    """
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        checkpoints = context._jsc.sc().getCheckpointDir()
        given = checkpoints.get() if checkpoints.isDefined() else None
    if given:
        return given
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/blockloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; frames that read it can not be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder.

    Lost executors can not change or lose it, later passes read only the columns
    they need, and its size is known when Spark picks a join. compression: another codec
    than the session's, as for wide texts.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal out rows that are costly to process where the reader can not split the input.

    A file of one row group is one task, whatever the split size. Input of as many pieces as a shuffle
    has (spark.sql.shuffle.partitions), which any large table is, stays as it is; small input is not
    dealt out further than there are cores to work on it.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(wanted, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
