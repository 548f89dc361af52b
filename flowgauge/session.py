"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "flowgauge", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.parallelPartitionDiscovery.parallelism", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own, since there the driver's disk is every task's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowgauge-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a loop's plan does not grow
    with its rounds, a lost executor does not replay the earlier rounds, and later reads take
    only the columns and rows they need."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: About so many rows make a task of ``dealt``.
ROWS_PER_TASK = 400_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows dealt out by ``keys`` to as many tasks as its size asks for, so that the memory of a
    task does not grow with the table. As it is while the session's own number of partitions does."""
    tasks = -(-rows // ROWS_PER_TASK)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(tasks, *keys)
