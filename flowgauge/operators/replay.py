"""Sensor readings prepared for replay as a paced message stream.

A publisher replays one file in order. Rows are numbered per publisher with ordered scans
(``operators.ordered``), cut on the reading id, so one large publisher is numbered by many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import half_up, jittered, unit_value
from flowgauge.operators.joins import attach
from flowgauge.operators.ordered import (
    AUTO, MAX_GROUP_ROWS, chunk_width, ordered_scan, previous, running_count, running_sum,
)

# Fixed values of the replayer.
TOPIC = "iot-data"
DEFAULT_SPEED = 1700
SPEED_RUNS = 19
DAY = 86400
ID_GRAIN = 1_000_000


def numbered(readings: DataFrame, publisher: str = "house_id", order: str = "id",
             width: int | str | None = AUTO) -> DataFrame:
    """Position of each reading in its publisher's file, from 1."""
    return ordered_scan(readings, [publisher], [order], {"row_no": running_count()},
                        width=width, grain=ID_GRAIN)


def skip_rows(readings: DataFrame, rows: int, publisher: str = "house_id", **scan) -> DataFrame:
    """Leave out the first rows of every file."""
    return numbered(readings, publisher, **scan).filter(F.col("row_no") > rows)


def resume_after(readings: DataFrame, positions: DataFrame, publisher: str = "house_id", **scan) -> DataFrame:
    """Rows after each publisher's saved position; a publisher without one starts anew."""
    saved = positions.select(publisher, F.col("sent").alias("_sent"))
    return (
        attach(numbered(readings, publisher, **scan), saved, [publisher], F.col("row_no"), "left")
        .filter(F.col("row_no") > F.coalesce("_sent", F.lit(0))).drop("_sent")
    )


def run_lengths(readings: DataFrame, publisher: str = "house_id", order: str = "id",
                time: str = "ts_s", width: int | str | None = AUTO,
                max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Rows per run of equal consecutive timestamps: (publisher, run_no, time, rows)."""
    if width == AUTO:
        width = chunk_width(readings, [publisher], order, ID_GRAIN, max_rows)
    rows = readings.select(publisher, order, time)
    paired = ordered_scan(rows, [publisher], [order], {"_before": previous(F.col(time))}, width=width)
    starts = F.when(F.col("_before").eqNullSafe(F.col(time)), 0).otherwise(1).cast("bigint")
    runs = ordered_scan(
        paired.withColumn("_starts", starts), [publisher], [order],
        {"run_no": running_sum(F.col("_starts"))}, width=width,
    )
    return runs.groupBy(publisher, "run_no").agg(
        F.min(time).alias(time), F.count(F.lit(1)).alias("rows")
    )


def source_speed(runs: DataFrame, publisher: str = "house_id") -> DataFrame:
    """Rows per second a file holds by itself: the floor of the mean over its first 19
    complete runs. The last run of a file is not complete; a file with one run gives null."""
    total = runs.groupBy(publisher).agg(F.max("run_no").alias("_runs"))
    early = runs.filter(F.col("run_no") <= SPEED_RUNS)
    used = F.when(F.col("run_no") < F.col("_runs"), F.col("rows"))
    return (
        early.join(total, publisher).groupBy(publisher)
        .agg(F.floor(F.sum(used) / F.count(used)).alias("speed"))
    )


def day_gap(readings: DataFrame, now: int, publisher: str = "house_id", order: str = "id",
            time: str = "ts_s") -> DataFrame:
    """Whole days, in seconds, between each file's first reading and ``now``."""
    first = readings.groupBy(publisher).agg(F.min_by(time, order).alias("first_ts"))
    days = half_up((F.lit(now) - F.col("first_ts")) / F.lit(float(DAY)))
    return first.withColumn("gap_s", (days * DAY).cast("bigint"))


def moved_line(time: Column, value: Column) -> Column:
    """The untouched ``line`` of a reading with other text in its second and third field."""
    first = F.regexp_extract("line", "^([^,]*)", 1)
    rest = F.regexp_extract("line", "^[^,]*,[^,]*,[^,]*(.*)$", 1)
    return F.concat(first, F.lit(","), time.cast("string"), F.lit(","), value.cast("string"), rest)


def replay_original(readings: DataFrame) -> DataFrame:
    """The lines as they stand in the files."""
    return readings.select("house_id", "id", "line")


def moved_value(seed: int) -> Column:
    return jittered(F.col("value"), unit_value(F.col("id"), seed))


def replay_date_shift(readings: DataFrame, now: int, seed: int = 0) -> DataFrame:
    """Readings moved to today by whole days, values varied by up to 10 %."""
    gaps = day_gap(readings, now).select("house_id", "gap_s")
    shifted = F.col("ts_s") + F.col("gap_s")
    return attach(readings, gaps, ["house_id"], F.col("id")).select(
        "house_id", "id", moved_line(shifted, moved_value(seed)).alias("line")
    )


def paced_schedule(readings: DataFrame, speed: int | None = None, speeds: DataFrame | None = None,
                   width: int | str | None = AUTO) -> DataFrame:
    """The one-second tick in which each reading is sent.

    ``speed`` rows go out per tick; without it, each publisher's own speed from ``speeds``.
    Speed 0 means no limit. A publisher whose own speed is unknown uses the default.
    """
    rows = numbered(readings, width=width)
    if speed is None:
        own = speeds.select("house_id", F.coalesce("speed", F.lit(DEFAULT_SPEED)).cast("bigint").alias("_speed"))
        rows = attach(rows, own, ["house_id"], F.col("id"))
    else:
        rows = rows.withColumn("_speed", F.lit(speed).cast("bigint"))
    tick = F.when(F.col("_speed") == 0, F.lit(0).cast("bigint")).otherwise(
        F.floor((F.col("row_no") - 1) / F.col("_speed"))
    )
    return rows.withColumn("tick", tick).drop("_speed")


def replay_realtime(scheduled: DataFrame, start: int, seed: int = 0) -> DataFrame:
    """Readings stamped with the second they are sent in, values varied by up to 10 %."""
    sent = F.lit(start) + F.col("tick")
    return scheduled.select(
        "house_id", "id", "tick", moved_line(sent, moved_value(seed)).alias("line")
    )


def replay_progress(scheduled: DataFrame, width: int | str | None = AUTO) -> DataFrame:
    """Rows sent per tick and in total, per publisher."""
    per_tick = scheduled.groupBy("house_id", "tick").agg(F.count(F.lit(1)).alias("speed"))
    return ordered_scan(per_tick, ["house_id"], ["tick"], {"total": running_sum(F.col("speed"))},
                        width=width, grain=100_000)


def as_messages(lines: DataFrame, topic: str = TOPIC) -> DataFrame:
    """Key and value columns of a message sink, one topic for all publishers."""
    return lines.select(
        F.lit(topic).alias("topic"), F.col("house_id").cast("string").alias("key"),
        F.col("line").alias("value"),
    )
