"""Sensor readings: headerless CSV files, one per publisher.

A line is kept as it stands in the file, and its fields are read beside it. Lines that are no reading
are not readings with nulls: ``reading_rejects`` lists them with what is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.schemas import READINGS

BROKEN = "reject_reason"


def _parsed(lines: DataFrame) -> DataFrame:
    """Typed fields of ``line``, and why it is no reading. Fields after the known ones belong to the
    line and to nothing else."""
    fields = F.split("line", ",", -1)
    typed = {f.name: F.get(fields, F.lit(i)).try_cast(f.dataType) for i, f in enumerate(READINGS.fields)}
    reason: Column = F.when(F.size(fields) < len(typed), "missing fields")
    for name, value in typed.items():
        reason = reason.when(value.isNull(), f"no {name}")
    return lines.select("*", *[v.alias(n) for n, v in typed.items()], reason.alias(BROKEN))


def read_reading_lines(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    """Every line as it is (``line``), its typed fields, its file, and ``reject_reason``, which is null
    for a reading. A line is all between two line breaks; nothing is quoted, trimmed or rounded."""
    if stream:
        lines = spark.readStream.option("recursiveFileLookup", "true").text(paths)
    else:
        lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    return _parsed(lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("publisher_file")))


def readings_of(lines: DataFrame) -> DataFrame:
    """The readings among ``read_reading_lines``, each with its untouched line."""
    return lines.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def reading_rejects(lines: DataFrame) -> DataFrame:
    """(publisher_file, line, reject_reason) of the lines that are no reading."""
    return lines.filter(F.col(BROKEN).isNotNull()).select("publisher_file", "line", BROKEN)


def read_readings(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    """Readings with the path of the file they come from; several files are one union."""
    return readings_of(read_reading_lines(spark, paths, stream)).select(*READINGS.fieldNames(), "publisher_file")


def write_lines(lines: DataFrame, path: str) -> None:
    """``lines`` (house_id, line) as text, one folder per house, in the order of the rows within a task."""
    lines.select("line", F.col("house_id").alias("house")).write.partitionBy("house").text(path)


def write_ticks(lines: DataFrame, path: str) -> None:
    """``lines`` (house_id, tick, line) as text, a folder per publisher and tick, so that a reader that
    admits a tick's files at a time sends what belongs into that second. Folders begin with the tick:
    a file source takes files by age, and ``append`` of one tick after the other gives them that order."""
    lines.select("line", "tick", F.col("house_id").alias("house")).write.mode("append").partitionBy("tick", "house").text(path)


def write_readings(readings: DataFrame, path: str) -> None:
    """One folder per house, columns in the order of the format.

    The house is also a column of the lines, so the folder name is a copy of it."""
    (
        readings.select(*READINGS.fieldNames(), F.col("house_id").alias("house"))
        .write.partitionBy("house").csv(path)
    )
