"""Topology, edge and target definitions from text lines ``(file, line_no, line)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.operators.joins import attach


def _parts(line: Column) -> Column:
    """Split at single spaces; trailing empty parts do not count, leading and inner ones do."""
    return F.split(F.rtrim(line), " ")


def _has_space(line: Column) -> Column:
    return F.contains(line, F.lit(" "))


def edge_reason(line: Column) -> Column:
    """Why a line is no edge; null for an edge. A line of spaces only has no parts."""
    parts = F.when(F.rtrim(line) == "", F.lit(0)).otherwise(F.size(_parts(line)))
    return F.when(~_has_space(line), "no space").when(parts != 2, "not two parts")


def topology_names(lines: DataFrame) -> DataFrame:
    """The first line of a file names its topology."""
    return lines.filter("line_no = 1").select("file", F.col("line").alias("topology_id"))


def _edge_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("line_no > 1").withColumn("reason", edge_reason(F.col("line")))


def edges(lines: DataFrame) -> DataFrame:
    """(topology_id, edge_no, src, dst); edge numbers follow the lines of the file."""
    good = _edge_lines(lines).filter("reason is null")
    return attach(good, topology_names(lines), ["file"], F.col("line_no")).select(
        "topology_id", (F.col("line_no") - 1).alias("edge_no"),
        _parts(F.col("line"))[0].alias("src"), _parts(F.col("line"))[1].alias("dst"),
    )


def edge_rejects(lines: DataFrame) -> DataFrame:
    """Lines that are no edges, with the reason."""
    return _edge_lines(lines).filter("reason is not null").select("file", "line_no", "line", "reason")


def empty_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Listed files without a first line; such a file defines no topology."""
    return files.join(lines.select("file").distinct(), "file", "left_anti")


def targets(lines: DataFrame) -> DataFrame:
    """(file, component_id, target_rate). A later line for a component overwrites an earlier
    one; parts after the second are ignored; a line without a number is a reject."""
    parts = F.split("line", " ")
    rows = lines.filter(_has_space(F.col("line"))).select(
        "file", "line_no", parts[0].alias("component_id"),
        F.get(parts, F.lit(1)).try_cast("double").alias("target_rate"),
    ).filter("target_rate is not null")
    return rows.groupBy("file", "component_id").agg(F.max_by("target_rate", "line_no").alias("target_rate"))


def target_rejects(lines: DataFrame) -> DataFrame:
    rate = F.get(F.split("line", " "), F.lit(1)).try_cast("double")
    return lines.filter(~_has_space(F.col("line")) | rate.isNull())


def lookup(wanted: DataFrame, topologies: DataFrame) -> DataFrame:
    """Topology name to id; the last listed topology of a name wins."""
    latest = topologies.groupBy("name").agg(F.max_by("topology_id", "seq").alias("topology_id"))
    return wanted.join(latest, "name")


def lookup_missing(wanted: DataFrame, topologies: DataFrame) -> DataFrame:
    return wanted.join(topologies, "name", "left_anti")
