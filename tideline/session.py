"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# what one task takes of a shuffle, compressed: its sorts and hash tables hold some twenty times as much
TASK_BYTES = "16m"
# what one task reads of a file: rows of few distinct values take some fifty times as much once they are counted
SCAN_BYTES = "8m"
# partitions a shuffle is dealt over before AQE merges the small ones, so that a task's part does not grow with the tables
LEAST_PARTITIONS = 400

# rows that travel to Python at a time; one may hold a prompt of ten whole reviews
PYTHON_ROWS = 200


def settle(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on: UTC days, adaptive re-planning and tasks of bounded size."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTITIONS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(least))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PYTHON_ROWS))
    return spark


def local_session(app: str = "tideline", cores: str = "8", memory: str = "12g", shared: str = "/tmp/tideline-shared") -> SparkSession:
    """Single-machine session for tests and the benchmark, with a shared folder of its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return settle(spark)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows evenly over many tasks, ahead of work that is heavy by the row and not by the byte.

    Small rows of a table come as few tasks, however long each row takes; an explicit number is not merged again by AQE.
    """
    spark = df.sparkSession
    cores = int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``, else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a table in the shared folder; survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
