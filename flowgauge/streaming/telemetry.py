"""Telemetry roll-ups and the flow check on streams.

Roll-ups are event-time windows with a watermark, so a tick is passed on once, when it is
complete, with all rows of its topology in one batch. The flow check runs the batch operator over the
complete ticks of each batch. What it carries on is small and lies in versioned tables: the last values
and the severity of each source, and per topology whether the next tick is a baseline, the worker
count and the number of plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowgauge.operators import flowcheck as fc
from flowgauge.operators.rollup import BOLT, SPOUT, bolt_aggregates, by_kind, weighted_mean
from flowgauge.session import cut_lineage
from flowgauge.streaming.versions import Versions


def component_metrics_stream(stats: DataFrame, window_col: str = "window") -> DataFrame:
    """Component roll-up of a stream of windowed executor statistics."""
    known = stats.filter(F.col("component_type").isin(SPOUT, BOLT))
    return by_kind(
        known.groupBy(window_col, "topology_id", "component_id", "component_type")
        .agg(*bolt_aggregates(),
             weighted_mean(F.col("complete_latency_ms"), F.col("acked")).alias("complete_latency"))
        .withColumn("tick", F.unix_seconds(F.col(f"{window_col}.start")))
    )  # as in the batch roll-up


FLOW_COLUMNS = ["topology_id", "tick", "component_id", "component_type", "executors", "capacity",
                "acked_rate", "complete_latency"]
PLAN_SCHEMA = ("topology_id string, tick bigint, moves bigint, component_id string, executors_before bigint, "
               "executors_after bigint, workers_before bigint, workers_after bigint")


class FlowStream:
    """The flow check over a stream of component metrics, with its plans and state below ``folder``.

    ``targets`` and ``reach`` are tables. Ticks must come whole and in ascending order from batch
    to batch, as windows behind a watermark do; several ticks may share a batch.
    """

    def __init__(self, folder: str, targets: DataFrame, reach: DataFrame):
        self.tables, self.targets, self.reach = Versions(folder), targets, reach

    def step(self, metrics: DataFrame, batch: int) -> None:
        spark, tables = metrics.sparkSession, self.tables
        state = fc.FlowState(tables.before(spark, "sources", batch, fc.SOURCE_STATE),
                             tables.before(spark, "topologies", batch, fc.TOPOLOGY_STATE))
        metrics = cut_lineage(metrics.select(*FLOW_COLUMNS))
        if metrics.isEmpty():
            tables.put("plans", batch, spark.createDataFrame([], PLAN_SCHEMA))
        else:
            flow = fc.flow_check(metrics, self.targets, self.reach, state=state)
            workers = cut_lineage(flow.worker_plan())
            plans = flow.executor_plan().join(
                workers.select("topology_id", "tick", "moves", "workers_before", "workers_after"), ["topology_id", "tick"])
            columns = [c.split()[0] for c in PLAN_SCHEMA.split(", ")]
            tables.put("plans", batch, plans.select(*[F.col(c).cast("bigint") if c not in ("topology_id", "component_id")
                                                      else F.col(c) for c in columns]))
            state = flow.state_after(workers)
        tables.put("sources", batch, state.sources)
        tables.put("topologies", batch, state.topologies)

    def start(self, metrics: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return self.tables.run(metrics, self.step, trigger)

    def plans(self, spark: SparkSession) -> DataFrame:
        """All plans made so far."""
        return self.tables.all(spark, "plans", PLAN_SCHEMA)
