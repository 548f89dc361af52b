"""Executor statistics rolled up to one row per (topology, tick, component).

Every roll-up is one hash aggregation with a map-side partial step, so a component that
holds a large share of the raw rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import stable, weighted_mean
from flowgauge.operators.joins import attach
from flowgauge.operators.ordered import AUTO, ordered_scan, previous

SPOUT, BOLT = "spout", "bolt"
WINDOW_SECS = 600
COMPONENT = ["topology_id", "tick", "component_id"]


def _rate(counter: str, window_secs: int) -> Column:
    return F.sum(counter).cast("double") / F.lit(float(window_secs))


def common_aggregates(window_secs: int = WINDOW_SECS) -> list[Column]:
    """Counters and rates that sources and operators share."""
    return [
        F.coalesce(F.max("num_executors").cast("bigint"), F.count(F.lit(1))).alias("executors"),
        F.max("num_tasks").cast("bigint").alias("tasks"),
        F.max("uptime_secs").cast("bigint").alias("uptime_secs"),
        F.sum("acked").alias("acked"),
        F.sum("failed").alias("failed"),
        F.sum("emitted").alias("emitted"),
        F.sum("transferred").alias("transferred"),
        _rate("acked", window_secs).alias("acked_rate"),
        _rate("emitted", window_secs).alias("emit_rate"),
        _rate("transferred", window_secs).alias("transfer_rate"),
    ]


def spout_aggregates(window_secs: int = WINDOW_SECS) -> list[Column]:
    return [
        *common_aggregates(window_secs),
        weighted_mean(F.col("complete_latency_ms"), F.col("acked")).alias("complete_latency"),
    ]


def bolt_aggregates(window_secs: int = WINDOW_SECS) -> list[Column]:
    """The execute rate keeps the whole-number division of the original definition; the
    exact rate stands beside it. Capacity is divided by the reported executor count, which
    may differ from the number of statistics rows."""
    executors = F.coalesce(F.max("num_executors").cast("bigint"), F.count(F.lit(1)))
    return [
        *common_aggregates(window_secs),
        F.sum("executed").alias("executed"),
        F.floor(F.sum("executed") / F.lit(window_secs)).cast("double").alias("execute_rate"),
        _rate("executed", window_secs).alias("execute_rate_exact"),
        weighted_mean(F.col("process_latency_ms"), F.col("acked")).alias("process_latency"),
        weighted_mean(F.col("execute_latency_ms"), F.col("executed")).alias("execute_latency"),
        stable(F.try_divide(F.sum("capacity"), executors)).alias("capacity"),
        F.greatest(F.max("capacity"), F.lit(0.0)).alias("max_capacity"),
    ]


def spout_rollup(stats: DataFrame, window_secs: int = WINDOW_SECS) -> DataFrame:
    return (
        stats.filter(F.col("component_type") == SPOUT)
        .groupBy(*COMPONENT)
        .agg(*spout_aggregates(window_secs))
    )


def bolt_rollup(stats: DataFrame, window_secs: int = WINDOW_SECS) -> DataFrame:
    return (
        stats.filter(F.col("component_type") == BOLT)
        .groupBy(*COMPONENT)
        .agg(*bolt_aggregates(window_secs))
    )


def component_metrics(stats: DataFrame, window_secs: int = WINDOW_SECS) -> DataFrame:
    """Both kinds in one table and one aggregation; columns of the other kind are null.

    Components of other types have no roll-up; ``unknown_types`` lists them.
    """
    known = stats.filter(F.col("component_type").isin(SPOUT, BOLT))
    return by_kind(known.groupBy(*COMPONENT, "component_type").agg(
        *bolt_aggregates(window_secs),
        weighted_mean(F.col("complete_latency_ms"), F.col("acked")).alias("complete_latency"),
    ))


def by_kind(both: DataFrame) -> DataFrame:
    """Rolled-up rows with the columns of the other kind set to null."""
    spout = F.col("component_type") == SPOUT
    bolt_only = ["executed", "execute_rate", "execute_rate_exact", "process_latency",
                 "execute_latency", "capacity", "max_capacity"]
    return both.select(
        *[
            F.when(~spout, F.col(c)).alias(c) if c in bolt_only
            else F.when(spout, F.col(c)).alias(c) if c == "complete_latency"
            else F.col(c)
            for c in both.columns
        ]
    )


def unknown_types(stats: DataFrame) -> DataFrame:
    """Components that are neither a source nor an operator; they have no roll-up."""
    return (
        stats.filter(~F.col("component_type").isin(SPOUT, BOLT) | F.col("component_type").isNull())
        .select("topology_id", "component_id", "component_type")
        .distinct()
    )


def thread_count(metrics: DataFrame) -> DataFrame:
    """One thread per executor, over all components of a topology."""
    return metrics.groupBy("topology_id", "tick").agg(F.sum("executors").alias("threads"))


def carry_forward(
    metrics: DataFrame, every: int, columns: list[str], width: int | str | None = AUTO,
    last: DataFrame | None = None,
) -> DataFrame:
    """Fill missed polls with the last good row.

    Each row is repeated until the tick before the component's next row; the last row
    until the topology's last tick, which ``last`` (topology_id, _end) gives if ``metrics`` are
    a choice of components. No tick grid is built or joined.
    """
    if last is None:
        last = last_ticks(metrics)
    reverse = metrics.withColumn("_back", -F.col("tick"))
    ahead = ordered_scan(
        reverse, ["topology_id", "component_id"], ["_back"],
        {"_next": previous(F.col("tick"))}, width=width,
    )
    until = F.coalesce(F.col("_next") - every, F.col("_end"))
    return (
        attach(ahead, last, ["topology_id"], F.col("tick"))
        .withColumn("poll", F.explode(F.sequence("tick", F.greatest(until, F.col("tick")), F.lit(every).cast("bigint"))))
        .select(
            "topology_id", "component_id", F.col("poll").alias("tick"),
            (F.col("poll") != F.col("tick")).alias("stale"), *columns,
        )
    )


def last_ticks(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("topology_id").agg(F.max("tick").alias("_end"))


def poll_series(
    metrics: DataFrame, component_id: str, every: int, columns: list[str], polls: int = 1000
) -> DataFrame:
    """Roll-up of one component polled at a fixed pace, for a fixed number of polls.

    Polls go on to the topology's last tick, also after the component's own last row."""
    one = metrics.filter(F.col("component_id") == component_id)
    filled = carry_forward(one, every, columns, last=last_ticks(metrics))
    first = one.groupBy("topology_id").agg(F.min("tick").alias("_first"))
    numbered = attach(filled, first, ["topology_id"], F.col("tick")).withColumn(
        "poll_no", ((F.col("tick") - F.col("_first")) / every).cast("bigint")
    )
    return numbered.filter(F.col("poll_no") < polls).drop("_first")


RULE = "-" * 25


def metric_report(metrics: DataFrame) -> DataFrame:
    """Fixed text block per component and tick."""

    def line(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NaN"))
                          for p in parts])

    c = F.col
    spout = c("component_type") == SPOUT
    middle_bolt = F.concat_ws(
        "\n",
        line("executed: ", c("executed"), " => capacity: ", c("capacity")),
        line("process latency: ", c("process_latency"), " / execute latency: ", c("execute_latency")),
        line("acked/sec :", c("acked_rate")),
        line("executed/sec :", c("execute_rate")),
    )
    middle_spout = F.concat_ws(
        "\n",
        line("latency: ", c("complete_latency")),
        line("acked/sec :", c("acked_rate")),
    )
    report = F.concat_ws(
        "\n",
        F.lit(RULE),
        c("component_id"),
        line("uptime :", F.coalesce(c("uptime_secs"), F.lit(0))),
        line("executors: ", c("executors"), " / tasks: ", F.coalesce(c("tasks"), F.lit(0)), "\n"),
        line("emitted: ", c("emitted"), " / transferred: ", c("transferred")),
        line("acked: ", c("acked"), " / failed: ", c("failed")),
        F.when(spout, middle_spout).otherwise(middle_bolt),
        line("emitted/sec :", c("emit_rate")),
        line("transferred/sec :", c("transfer_rate")),
        F.lit(RULE),
    )
    return metrics.select("topology_id", "tick", "component_id", report.alias("report"))
