"""Text files as numbered lines, without reading a file whole.

Lines of one split come in file order and get consecutive ids, so line numbers follow from one
row per (file, start of the split). No line is shuffled, and a large file is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.operators.joins import BROADCAST_ROWS
from flowgauge.session import cut_lineage, dealt


def write_files(lines: DataFrame, path: str, order: tuple[str, ...] = ("line_no",), rows: int | None = None) -> None:
    """``lines`` (file, line and the columns of ``order``) as text, a folder per ``file`` with one file in it whose
    lines follow ``order``, nulls first. A file is written by one task; many tasks share the files, more of them
    the more ``rows`` there are (counted if not given). Tasks move their files into place themselves: the driver
    would move one after the other."""
    spread = dealt(lines, lines.count() if rows is None else rows, "file")
    if spread is lines:
        spread = lines.repartition("file")
    ordered = spread.sortWithinPartitions("file", *order)
    ordered.select("line", "file").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(
        "file").text(path)


def by_folder(lines: DataFrame) -> DataFrame:
    """``read_lines`` of what ``write_files`` wrote, with the names that the files had there."""
    return lines.withColumn("file", F.regexp_extract("file", "/file=([^/]+)/[^/]*$", 1))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no from 1, line) of text files."""
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    # Ids of a split are consecutive in file order, so its first id and the lines before it number its lines.
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")).select(
        "file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    ))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return raw.join(offsets, ["file", "_start"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_offset") + 1).alias("line_no"), "line")
