"""Load per plug, household and house in slices of several lengths at once.

All slice lengths are whole minutes. Readings are first reduced to one row per plug and
minute (map-side partial sums), and only these rows are multiplied by the slice lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Slice lengths in minutes, and the property code of a load reading.
SLICE_MINUTES = (1, 5, 10, 15, 20, 30, 60, 120)
LOAD = 1
DAY_MINUTES = 1440
PLUG = ["house_id", "household_id", "plug_id"]


def _each_slice(rows: DataFrame, seconds: str, minutes: tuple[int, ...]) -> DataFrame:
    """Rows once per slice length, with the slice's start in epoch seconds."""
    length = F.col("slice_min") * 60
    return rows.withColumn(
        "slice_min", F.explode(F.array(*[F.lit(m).cast("bigint") for m in minutes]))
    ).withColumn("slice", F.floor(F.col(seconds) / length) * length)


def slice_split(readings: DataFrame, minutes: tuple[int, ...] = SLICE_MINUTES) -> DataFrame:
    """Every load reading in every slice it belongs to."""
    return _each_slice(readings.filter(F.col("property") == LOAD), "ts_s", minutes)


def slice_avg(readings: DataFrame, minutes: tuple[int, ...] = SLICE_MINUTES) -> DataFrame:
    """Mean load per plug and slice."""
    by_minute = (
        readings.filter(F.col("property") == LOAD)
        .groupBy(*PLUG, (F.floor(F.col("ts_s") / 60) * 60).alias("_minute"))
        .agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    )
    return (
        _each_slice(by_minute, "_minute", minutes)
        .groupBy(*PLUG, "slice_min", "slice")
        .agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("load"))
    )


def slice_sum(averages: DataFrame) -> DataFrame:
    """Sum of the plug means per household and per house, one level above the other."""
    household = averages.groupBy("house_id", "household_id", "slice_min", "slice").agg(
        F.sum("load").alias("load")
    )
    house = household.groupBy("house_id", "slice_min", "slice").agg(F.sum("load").alias("load"))
    return household.select(
        F.lit("household").alias("level"), "house_id", "household_id", "slice_min", "slice", "load"
    ).unionByName(house.select(
        F.lit("house").alias("level"), "house_id", F.lit(None).cast("bigint").alias("household_id"),
        "slice_min", "slice", "load",
    ))


def slice_forecast(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast two slices ahead: the mean of the current load and of the median load seen
    in the target's slice of the day on earlier days; the current load without history.

    Each slice asks for its target; asks and loads meet in one window per (key, slice of
    the day), ordered by day. No pairs of days are formed, and a group holds one load and
    one ask per day.
    """
    length = F.col("slice_min") * 60
    seen = loads.select(*keys, "slice_min", F.col("slice").alias("_at"), F.col("load").alias("_seen"),
                        F.lit(None).cast("bigint").alias("slice"), F.lit(None).cast("double").alias("load"))
    asked = loads.select(*keys, "slice_min", (F.col("slice") + 2 * length).alias("_at"),
                         F.lit(None).cast("double").alias("_seen"), "slice", "load")
    lined = seen.unionByName(asked).withColumn("_day", F.floor(F.col("_at") / (DAY_MINUTES * 60))) \
        .withColumn("_place", F.col("_at") % (DAY_MINUTES * 60))
    earlier = (
        Window.partitionBy(*keys, "slice_min", "_place").orderBy("_day")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    history = F.percentile("_seen", F.lit(0.5)).over(earlier)
    return (
        lined.withColumn("history", history).filter("slice is not null")
        .select(
            *keys, "slice_min", "slice", F.col("_at").alias("target_slice"), "load",
            F.when(F.col("history").isNull(), F.col("load"))
            .otherwise((F.col("load") + F.col("history")) / 2).alias("forecast"),
        )
    )
