"""Session settings that hold for every job of this library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", name: str = "kinelake") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KINELAKE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; choose one only where none is set, on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="kinelake-checkpoint-"))


def _shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: compute once and write a table to the shared checkpoint folder.

    Columnar and compressed, so that later readers take only the columns they use.
    """
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.settled_path = path
    return made


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more: their successors are written."""
    for df in settled:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.settled_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
