"""Telemetry and sample tables, as a batch or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.rollup import weighted_mean
from flowgauge.schemas import EXECUTOR_STATS, SAMPLES, STREAM_STATS


SYSTEM_PREFIX = "__"


def executor_stats(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Executor statistics; components of the runtime itself are left out."""
    reader = (spark.readStream if stream else spark.read).schema(EXECUTOR_STATS)
    return reader.parquet(path).filter(~F.col("component_id").startswith(SYSTEM_PREFIX))


def of_streams(streams: DataFrame, system: bool = False) -> DataFrame:
    """Executor statistics from statistics per stream. The runtime's own streams (acknowledgements,
    metrics) do not count unless ``system``; an executor that has only such streams falls out.

    Counters are sums. A latency is weighted by the tuples it was measured on. Capacity belongs to the
    executor and stands on each of its streams alike.
    """
    if not system:
        streams = streams.filter(~F.col("stream_id").startswith(SYSTEM_PREFIX))
    counters = ["emitted", "transferred", "acked", "failed", "executed"]
    facts = ["num_executors", "num_tasks", "uptime_secs", "capacity"]
    weights = {"complete_latency_ms": "acked", "process_latency_ms": "acked", "execute_latency_ms": "executed"}
    return streams.groupBy("topology_id", "tick", "component_id", "component_type", "executor_id").agg(
        *[F.sum(c).alias(c) for c in counters], *[F.max(c).alias(c) for c in facts],
        *[weighted_mean(F.col(c), F.col(w)).alias(c) for c, w in weights.items()],
    ).select(*EXECUTOR_STATS.fieldNames())


def stream_stats(spark: SparkSession, path: str, system: bool = False) -> DataFrame:
    """Executor statistics from a table of statistics per stream; see ``of_streams``."""
    streams = spark.read.schema(STREAM_STATS).parquet(path)
    return of_streams(streams.filter(~F.col("component_id").startswith(SYSTEM_PREFIX)), system)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples by metric and day, the columns every selector prunes on."""
    samples.withColumn("day", F.to_date("ts")).write.partitionBy("metric", "day").parquet(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SAMPLES.fieldNames())
