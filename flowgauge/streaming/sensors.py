"""Slices and replay on streams of sensor readings."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from flowgauge.operators.replay import as_messages, moved_line, moved_value
from flowgauge.operators.sensors import LOAD, PLUG, SLICE_MINUTES
from flowgauge.session import cut_lineage
from flowgauge.streaming.versions import Versions

LATENESS = 3600
_KEYS = ", ".join(f"{c} int" for c in PLUG)
OPEN_SLICES = f"{_KEYS}, slice_min bigint, slice bigint, total double, n bigint"
CLOSED_SLICES = f"{_KEYS}, slice_min bigint, slice bigint, load double"
CLOCK = "latest bigint"


class SliceStream:
    """Mean load per plug and slice, for all slice lengths, passed on when a slice is complete.

    Readings are summed by plug and minute once, and the sums go to the slices of every length. A
    slice is complete when the latest reading is ``lateness`` seconds past its end; readings that come
    later than that are left out of it. Sums of open slices and the time of the latest reading are
    carried from batch to batch. All lengths must be whole minutes.
    """

    def __init__(self, folder: str, minutes: tuple[int, ...] = SLICE_MINUTES, lateness: int = LATENESS):
        self.tables, self.minutes, self.lateness = Versions(folder), minutes, lateness

    def step(self, readings: DataFrame, batch: int) -> None:
        spark, tables = readings.sparkSession, self.tables
        loads = readings.filter(F.col("property") == LOAD).withColumn("minute", F.floor(F.col("ts_s") / 60) * 60)
        by_minute = cut_lineage(loads.groupBy(*PLUG, "minute").agg(
            F.sum("value").alias("total"), F.count("value").alias("n"), F.max("ts_s").alias("latest")))
        clock = tables.before(spark, "clock", batch, CLOCK)
        past = clock.agg(F.max("latest")).first()[0]
        now = by_minute.agg(F.max("latest")).first()[0]
        latest = max((t for t in (past, now) if t is not None), default=None)
        lengths = F.explode(F.array(*[F.lit(m).cast("bigint") for m in self.minutes]))
        sliced = by_minute.select(*PLUG, "minute", "total", "n", lengths.alias("slice_min")).select(
            *PLUG, "slice_min", (F.floor(F.col("minute") / (F.col("slice_min") * 60)) * F.col("slice_min") * 60).alias("slice"), "total", "n")
        end = F.col("slice") + F.col("slice_min") * 60
        if past is not None:
            sliced = sliced.filter(end > past - self.lateness)
        sums = tables.before(spark, "open", batch, OPEN_SLICES).unionByName(sliced).groupBy(*PLUG, "slice_min", "slice").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n"))
        sums = cut_lineage(sums)
        done = end <= F.lit(None if latest is None else latest - self.lateness).cast("bigint")
        complete = F.coalesce(done, F.lit(False))
        tables.put("closed", batch, sums.filter(complete).select(
            *PLUG, "slice_min", "slice", F.try_divide("total", "n").alias("load")))
        tables.put("open", batch, sums.filter(~complete))
        tables.put("clock", batch, spark.range(1).select(F.lit(latest).cast("bigint").alias("latest")))

    def start(self, readings: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return self.tables.run(readings, self.step, trigger)

    def slices(self, spark: SparkSession) -> DataFrame:
        """All complete slices so far, one row each."""
        return self.tables.all(spark, "closed", CLOSED_SLICES)


def house_sums(slices: DataFrame) -> DataFrame:
    """Sum of the plug means per house. The plugs of a slice are complete in the same batch."""
    return slices.groupBy("house_id", "slice_min", "slice").agg(F.sum("load").alias("load"))


def publish(readings: DataFrame, mode: str = "realtime", gaps: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Messages of a replay stream of raw lines (``sources.readings``): unchanged, moved by the days in
    ``gaps`` (house_id, gap_s), one row per publisher, or stamped with the time they are sent.
    Only the time and value fields of a line are replaced. A publisher without a gap is not moved."""
    if mode == "original":
        line = F.col("line")
    elif mode == "date":
        readings = readings.join(F.broadcast(gaps.select("house_id", "gap_s")), "house_id", "left")
        line = moved_line(F.col("ts_s") + F.coalesce("gap_s", F.lit(0)), moved_value(seed))
    elif mode == "realtime":
        line = moved_line(F.unix_seconds(F.current_timestamp()), moved_value(seed))
    else:
        raise ValueError(f"no such mode: {mode}")
    return as_messages(readings.withColumn("line", line))


def paced(reader, per_batch: int = 1):
    """A stream reader that admits so many files to each batch; with a timed trigger (``every``)
    that is the pace. Files are cut to what a second holds by ``sources.readings.write_ticks``."""
    return reader.option("maxFilesPerTrigger", per_batch)


def every(seconds: float) -> dict:
    return {"processingTime": f"{int(seconds * 1000)} milliseconds"}


def run_paced(query: StreamingQuery) -> None:
    """Wait until a query with a timed trigger has taken all there is, and stop it."""
    query.processAllAvailable()
    query.stop()


def to_broker(messages: DataFrame, servers: str, checkpoint: str):
    """Writer to a message broker through Spark's Kafka sink, if its package is present.
    Delivery is at least once; the topic is a column of each message."""
    return (
        messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
    )


class ProgressLog(StreamingQueryListener):
    """Writes one row for every batch of the queries of a name: batch, rows, rows per second.

    Rows go to ``path`` as soon as a batch is reported, so none is lost when Spark forgets old
    progress. Use as a context: on leaving, it waits for the last report of the queries it saw end.
    """

    SCHEMA = "name string, batch bigint, rows bigint, rows_per_second double, sent_at string"

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.ids: set[str] = set()
        self.changed = threading.Condition()
        self.ended: set[str] = set()

    def __enter__(self) -> "ProgressLog":
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.wait()
        self.spark.streams.removeListener(self)

    def wait(self, seconds: float = 60) -> None:
        """Until every query of the name that began has been reported as ended."""
        until = time.monotonic() + seconds
        with self.changed:
            while (not self.ids or self.ids - self.ended) and time.monotonic() < until:
                self.changed.wait(0.2)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            with self.changed:
                self.ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            row = (p.name, int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond), p.timestamp)
            self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)
