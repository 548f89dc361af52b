"""Tables that a stream carries from batch to batch, one version for each batch.

A batch reads the version of the batch before it and writes its own. A batch that is run again
after a failure or a restart finds the same earlier version and overwrites its own tables with the
same rows, so nothing is counted twice. Versions are Parquet in the folder of the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class Versions:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def before(self, spark: SparkSession, name: str, batch: int, schema: str) -> DataFrame:
        """The table as the batch before left it; empty before the first."""
        if batch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/version={batch - 1}")

    def put(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/version={batch}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def all(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """The rows of every batch, for tables to which each batch adds."""
        return spark.read.schema(schema).parquet(f"{self.folder}/{name}/version=*")

    def run(self, stream: DataFrame, step: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
        """``step`` for each batch of ``stream``; a restart goes on after the last finished one."""
        return (
            stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )
