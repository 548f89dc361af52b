"""Run a streaming query over what its source holds now, into files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowgauge.session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(stream: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to a file sink. The checkpoint makes a restart go on where it stopped."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings a query takes over when it starts, put back afterwards."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def state_partitions(spark: SparkSession) -> str:
    """A micro-batch pays for every state partition, so there are no more than cores."""
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return str(min(configured, spark.sparkContext.defaultParallelism))


def drain(stream: DataFrame, name: str, rocksdb: bool = False) -> DataFrame:
    """All rows the stream appends for the data at hand, as a table."""
    spark: SparkSession = stream.sparkSession
    sink, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    values = {"spark__sql__shuffle__partitions": state_partitions(spark)}
    if rocksdb:
        values[STATE_STORE.replace(".", "__")] = ROCKSDB
    with settings(spark, **values):
        start(stream, sink, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
