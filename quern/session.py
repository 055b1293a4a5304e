"""Session settings, table access and checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Streams merge a busy key's sessions before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Sizing stays with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.ui.retainedExecutions", "1")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own; a temporary one only where one process does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        folder = named
    elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write a result that several branches read to the checkpoint folder, and read it back.

    A written table cuts lineage, keeps columnar pruning and survives the loss
    of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *columns: str, most: int = 1 << 19) -> DataFrame:
    """Hash-partition so that no task holds many more than ``most`` of the ``rows``.

    A file split is bounded in compressed bytes only, and columns that compress
    well put tens of millions of rows into one. Small tables stay as they are.
    """
    tasks = -(-rows // most)
    return df.repartition(tasks, *columns) if tasks > 1 else df


class Tables:
    """Parquet tables of one directory as attributes: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = configure(spark)
        self.directory = directory.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.directory}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
