"""Queries that run as streams over the tables and must give the batch result.

A stream passes a window on once the watermark, an hour behind the latest event, has
passed its end, so the counterparts leave out the windows still open.
"""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowgauge.operators import replay
from flowgauge.plans import adapters as ad
from flowgauge.plans import sensing
from flowgauge.plans import sql_views as v
from flowgauge.plans.registry import query, rounded, with_ctes
from flowgauge.plans.telemetry import WORKERS, _metrics, _reach
from flowgauge.schemas import EVENTS
from flowgauge.session import cut_lineage, scratch_path
from flowgauge.sources import readings as reading_files
from flowgauge.streaming import run, sensors, telemetry

DELAY = "1 hour"
CLOSED = "closed as (select max(epoch_ms(ts)) - 3600000 as mark from events)"


def _table(sf):
    """A file source takes a folder or a pattern; the pattern also fits a single file."""
    return f"{sf}/event?.parquet"


def _events(spark, path):
    return (
        spark.readStream.schema(EVENTS).parquet(path)
        .withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", DELAY)
    )


def _stats(spark, path):
    windows = F.window("event_time", f"{ad.TICK_SECS} seconds").alias("window")
    grouped = ad.executor_stats_of(_events(spark, path), windows)
    stats = ad.finish_stats(grouped.withColumn("tick", F.unix_seconds("window.start")), "window")
    return stats


@query("executor_stats_stream", with_ctes(v.STATS, CLOSED, body="""
select topology_id, tick, component_id, executor_id, emitted, transferred, acked, failed
from stats, closed where (tick + 21600) * 1000 <= mark"""))
def executor_stats_stream(spark, sf):
    return run.drain(_stats(spark, _table(sf)).drop("window"), "stats").select(
        "topology_id", "tick", "component_id", "executor_id", "emitted", "transferred", "acked", "failed")


@query("metric_poll_stream", with_ctes(v.STATS, v.METRICS, CLOSED, body="""
select topology_id, tick, component_id, executors, acked, round(acked_rate + 3.7e-10, 6) as acked_rate,
       round(capacity + 3.7e-10, 6) as capacity
from cm, closed where (tick + 21600) * 1000 <= mark"""))
def metric_poll_stream(spark, sf):
    metrics = telemetry.component_metrics_stream(_stats(spark, _table(sf)))
    kept = metrics.select("topology_id", "tick", "component_id", "executors", "acked", "acked_rate", "capacity")
    return rounded(run.drain(kept, "metrics"), "acked_rate", "capacity")


@query("flow_check_stream", with_ctes(*WORKERS, CLOSED, recursive=True, body="""
select p.topology_id, p.tick, w.moves, p.component_id, p.executors_before, p.executors_after,
       w.workers_before, w.workers_after
from plan p join workers w on w.topology_id = p.topology_id and w.tick = p.tick, closed
where (p.tick + 21600) * 1000 <= mark"""))
def flow_check_stream(spark, sf):
    """Stopped half way and started again from its checkpoint: the first run sees the first half of the
    events, the second run only the rest, with the state that the first left."""
    known = _metrics(spark, sf)
    source, folder = scratch_path(spark, "events"), scratch_path(spark, "flow")
    events = ad.events(spark, sf)
    flow = telemetry.FlowStream(folder, cut_lineage(ad.targets(known)), cut_lineage(_reach(known)))
    middle = F.lit(events.select(F.timestamp_seconds(F.avg(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))).first()[0])
    for half in (F.col("ts").cast("timestamp") < middle, F.col("ts").cast("timestamp") >= middle):
        events.filter(half).write.mode("append").parquet(source)
        stats = _stats(spark, source)
        with run.settings(spark, spark__sql__shuffle__partitions=run.state_partitions(spark)):
            flow.start(telemetry.component_metrics_stream(stats)).awaitTermination()
    return flow.plans(spark)


SLICES = """
sliced as (
  select r.*, n as slice_min, ts_s // (n * 60) * (n * 60) as slice
  from readings r, (select unnest([1, 5, 10, 15, 20, 30, 60, 120]::bigint[]) as n)),
loads as (
  select house_id, household_id, plug_id, slice_min, slice, sum(value) / count(*) as load from sliced group by all),
closed as (select max(ts_s) - 3600 as mark from readings)
"""


def _readings(spark, sf):
    path = scratch_path(spark, "readings")
    reading_files.write_readings(ad.readings(spark, sf), path)
    return reading_files.read_readings(spark, path, stream=True)


def _slices(spark, sf):
    stream = sensors.SliceStream(scratch_path(spark, "slices"))
    stream.start(_readings(spark, sf)).awaitTermination()
    return stream.slices(spark)


@query("slice_avg_stream", with_ctes(v.READINGS, SLICES, body="""
select cast(house_id as integer) as house_id, cast(household_id as integer) as household_id,
       cast(plug_id as integer) as plug_id, slice_min, cast(slice as bigint) as slice,
       round(load + 3.7e-10, 6) as load
from loads, closed where slice + slice_min * 60 <= mark"""))
def slice_avg_stream(spark, sf):
    return rounded(_slices(spark, sf), "load")


@query("slice_sum_stream", with_ctes(v.READINGS, SLICES, body="""
select cast(house_id as integer) as house_id, slice_min, cast(slice as bigint) as slice,
       round(sum(load) + 3.7e-10, 6) as load
from loads, closed where slice + slice_min * 60 <= mark group by house_id, slice_min, slice"""))
def slice_sum_stream(spark, sf):
    return rounded(sensors.house_sums(_slices(spark, sf)), "load")


def _halves(spark, sf):
    """The raw lines in two parts, and the folder that they are written to one after the other."""
    lines = cut_lineage(sensing.reading_lines(spark, sf))
    middle = lines.agg(F.expr("div(max(id), 2)")).first()[0]
    return scratch_path(spark, "source"), [lines.filter(F.col("id") <= middle), lines.filter(F.col("id") > middle)]


def _published(spark, sf, mode, gaps=None):
    """Messages of a replay that is stopped half way: the first run sees the first half of the files,
    the second run starts from the checkpoint and sends only the rest."""
    (source, halves), sink, state = _halves(spark, sf), scratch_path(spark, "topic"), scratch_path(spark, "topic-state")
    for number, half in enumerate(halves):
        reading_files.write_lines(half, f"{source}/{number}")
        lines = reading_files.readings_of(reading_files.read_reading_lines(spark, source, stream=True))
        run.start(sensors.publish(lines, mode, gaps, sensing.SEED), sink, state).awaitTermination()
    return spark.read.schema("topic string, key string, value string").parquet(sink)


@query("publish_topic", with_ctes(v.READINGS, sensing.RAW, body="""
select 'iot-data' as topic, cast(house_id as varchar) as key, line as value from good"""))
def publish_topic(spark, sf):
    return _published(spark, sf, "original")


# Publishers begin on days of their own, so that each has a gap of its own.
LATER = f"""
later as (select * replace (ts_s + house_id * 86400 as ts_s) from good),
gaps as (
  select house_id, cast(86400 * floor(({sensing.NOW} - arg_min(ts_s, id)) / 86400.0 + 0.5) as bigint) as gap_s
  from good group by house_id),
own as (select house_id, gap_s - house_id * 86400 as gap_s from gaps)
"""


@query("publish_date_shift", with_ctes(v.READINGS, sensing.RAW, LATER, body=f"""
select 'iot-data' as topic, cast(r.house_id as varchar) as key,
       id || ',' || (ts_s + gap_s) || ',' || {sensing.JITTER} || ',' || rest || {sensing.MORE} as value
from good r join own using (house_id)"""))
def publish_date_shift(spark, sf):
    """Every publisher's lines moved by its own days."""
    first = reading_files.readings_of(sensing._files(spark, sf))
    gaps = replay.day_gap(first, sensing.NOW).withColumn("gap_s", F.col("gap_s") - F.col("house_id") * replay.DAY)
    return _published(spark, sf, "date", cut_lineage(gaps.select("house_id", "gap_s")))


@query("publish_realtime", with_ctes(v.READINGS, sensing.RAW, body=f"""
select 'iot-data' as topic, cast(house_id as varchar) as key, cast(id as varchar) as id, true as sent_now,
       {sensing.JITTER} || ',' || rest || {sensing.MORE} as rest
from good"""))
def publish_realtime(spark, sf):
    """Lines stamped with the second they are sent in: within the time that the replay ran."""
    begin = int(time.time())
    sent = cut_lineage(_published(spark, sf, "realtime"))
    at = F.split("value", ",")[1].cast("bigint")
    return sent.select("topic", "key", F.split("value", ",")[0].alias("id"), at.between(begin, int(time.time())).alias("sent_now"),
                       F.regexp_extract("value", "^[^,]*,[^,]*,(.*)$", 1).alias("rest"))


PACED = """
sizes as (select house_id, greatest(1, (count(*) + 3) // 4) as speed from good group by house_id),
ticks as (
  select g.house_id, (row_number() over (partition by g.house_id order by id) - 1) // speed as tick
  from good g join sizes using (house_id)),
sent as (select cast(tick as bigint) as batch, count(*) as rows from ticks group by tick)
"""


@query("replay_progress_stream", with_ctes(v.READINGS, sensing.RAW, PACED, body="""
select batch, cast(rows as bigint) as rows, cast(sum(rows) over (order by batch) as bigint) as total from sent"""))
def replay_progress_stream(spark, sf):
    """A replay in four seconds of a quarter of every file each, one second per batch, and what its
    progress log says was sent. The source folder gets one second's files after the other."""
    readings = sensing._readings(spark, sf)
    sizes = readings.groupBy("house_id").agg(F.greatest(F.lit(1), F.expr("div(count(*) + 3, 4)")).alias("speed"))
    ticks = cut_lineage(replay.paced_schedule(readings, speeds=sizes))
    source, log = scratch_path(spark, "paced"), scratch_path(spark, "progress")
    reading_files.write_ticks(ticks.limit(0), source)
    with sensors.ProgressLog(spark, log, f"paced-{log[-32:]}") as progress:
        reader = sensors.paced(spark.readStream.option("recursiveFileLookup", "true"), 1_000_000)
        query = (reader.text(source).writeStream.queryName(progress.name).format("noop")
                 .option("checkpointLocation", scratch_path(spark, "paced-state")).trigger(**sensors.every(1)).start())
        for (tick,) in sorted(ticks.select("tick").distinct().collect()):  # one row per second of the replay
            reading_files.write_ticks(ticks.filter(F.col("tick") == tick), source)
            query.processAllAvailable()
        query.stop()
    sent = progress.rows().filter("rows > 0")
    return sent.select("batch", "rows", F.sum("rows").over(Window.orderBy("batch")).alias("total"))
