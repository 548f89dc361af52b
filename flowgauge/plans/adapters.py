"""Views that shape the given tables into the library's schemas.

Money-like values have two decimals; sums are taken in whole cents, so they do not depend
on the order in which tasks add them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.rollup import component_metrics
from flowgauge.schemas import STREAM_STATS
from flowgauge.session import dealt

HOUR, DAY = 3600, 86400
TICK_SECS = 6 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def micros(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def cents(column: str = "value"):
    return F.round(F.col(column) * 100).cast("bigint")


def component_name():
    place = F.col("user_id") % 10
    number = (F.col("user_id") % 3 + 1).cast("string")
    return (
        F.when(place == 9, F.lit("spout-main"))
        .when(place < 3, F.concat(F.lit("split-"), number))
        .when(place < 6, F.concat(F.lit("avg-"), number))
        .otherwise(F.concat(F.lit("sum-"), number))
    )


def component_of_two():
    """The same with a second source in each topology."""
    return F.when(F.col("user_id") % 10 == 8, F.lit("spout-side")).otherwise(component_name())


def executor_stats_of(events_df: DataFrame, tick, *extra, component=None) -> DataFrame:
    """Statistics per (topology, tick, component, executor) and ``extra`` keys; works on a stream as well."""
    executor = F.floor(F.col("user_id") / 10)
    kind = F.col("event_type")
    grouped = events_df.groupBy(
        F.concat(F.lit("t"), (executor % 3).cast("string")).alias("topology_id"),
        tick, (component_name() if component is None else component).alias("component_id"),
        executor.alias("executor_id"), *extra,
    ).agg(
        F.count(F.lit(1)).alias("emitted"),
        F.count_if(kind != "view").alias("transferred"),
        F.count_if(kind != "error").alias("acked"),
        F.count_if(kind == "error").alias("failed"),
        F.count(F.lit(1)).alias("executed"),
        F.sum(cents()).alias("_cents"),
    )
    return grouped


def finish_stats(grouped: DataFrame, *extra: str) -> DataFrame:
    spout = F.col("component_id").startswith("spout-")
    latency = F.col("_cents").cast("double") / F.col("emitted") / F.lit(100.0)
    return grouped.select(
        "topology_id", "tick", "component_id",
        F.when(spout, "spout").otherwise("bolt").alias("component_type"),
        "executor_id",
        F.lit(None).cast("int").alias("num_executors"),
        F.lit(None).cast("int").alias("num_tasks"),
        F.lit(None).cast("int").alias("uptime_secs"),
        "emitted", "transferred", "acked", "failed",
        F.when(~spout, F.col("executed")).alias("executed"),
        F.when(spout, latency).alias("complete_latency_ms"),
        F.when(~spout, latency).alias("process_latency_ms"),
        F.when(~spout, latency).alias("execute_latency_ms"),
        F.when(~spout, F.col("_cents") / F.lit(10000.0)).alias("capacity"), *extra,
    )


def tick_column():
    return (F.floor(micros() / (TICK_SECS * 1_000_000)) * TICK_SECS).alias("tick")


def executor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finish_stats(executor_stats_of(events(spark, sf_dir), tick_column()))


def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics per stream, as a runtime records them: streams and components of its own among the
    rest, and a component whose type it does not know."""
    kind, user = F.col("event_type"), F.col("user_id")
    stream = (F.when(kind == "signup", "__metrics").when(kind == "error", "errors")
              .when(kind == "purchase", "orders").otherwise("default"))
    component = (F.when(user % 70 == 7, "__acker").when(user % 70 == 17, F.concat(F.lit("sink-"), (user % 2).cast("string")))
                 .otherwise(component_name()))
    grouped = executor_stats_of(events(spark, sf_dir), tick_column(), stream.alias("stream_id"), component=component)
    typed = F.when(F.col("component_id").startswith("sink-"), F.when(F.col("component_id") == "sink-1", "sink")).otherwise(
        F.col("component_type"))
    stats = finish_stats(grouped, "stream_id").withColumn("component_type", typed)
    return stats.select(*STREAM_STATS.fieldNames())


def two_source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = executor_stats_of(events(spark, sf_dir), tick_column(), component=component_of_two())
    return component_metrics(finish_stats(stats))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_metrics(executor_stats(spark, sf_dir))


PIPELINE_EDGES = [
    *[("spout-main", f"split-{k}") for k in (1, 2, 3)],
    *[(f"split-{k}", f"avg-{k}") for k in (1, 2, 3)],
    *[(f"avg-{k}", f"sum-{k}") for k in (1, 2, 3)],
    ("split-1", "avg-2"),
]


SIDE_EDGES = [("spout-side", "split-2"), ("spout-side", "split-3")]


def pipeline_edges(metrics_df: DataFrame, edges: list[tuple[str, str]] = PIPELINE_EDGES) -> DataFrame:
    """The dataflow graph of the topologies met in the data."""
    listed = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("edge_no"), F.lit(a).alias("src"), F.lit(b).alias("dst"))
        for n, (a, b) in enumerate(edges, 1)
    ])
    topologies = metrics_df.select("topology_id").distinct()
    return topologies.select("topology_id", F.inline(listed))


def component_types(metrics_df: DataFrame) -> DataFrame:
    return metrics_df.select("topology_id", "component_id", "component_type").distinct()


def targets(metrics_df: DataFrame) -> DataFrame:
    """10 % above each source's mean rate, and one target that matches no source."""
    rate = (F.sum("acked").cast("double") / 600.0) / F.count(F.lit(1))
    known = (
        metrics_df.filter("component_type = 'spout'")
        .groupBy("topology_id", "component_id")
        .agg(F.round(rate * 1.1, 6).alias("target_rate"))
    )
    unmatched = metrics_df.select("topology_id").distinct().select(
        "topology_id", F.lit("spout-trigger").alias("component_id"), F.lit(4000.0).alias("target_rate")
    )
    return known.unionByName(unmatched)


def two_source_targets(metrics_df: DataFrame) -> DataFrame:
    """The same for two sources; one topology has no target for its second source."""
    return targets(metrics_df).filter("not (topology_id = 't2' and component_id = 'spout-side')")


# Which event type stands for which series, and the label that names the series.
METRIC_OF = {
    "view": ("bolts_capacity", "BoltId"),
    "click": ("spouts_complete_latency", "SpoutId"),
    "error": ("worker_cluster_used", "ClusterHost"),
    "signup": ("pod_memory_working_set_bytes", "pod"),
    "purchase": ("pod_cpu_usage_seconds_total", "pod"),
}
TOTAL_WORKERS = 28.0
NAMESPACE = "pipeline"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples have a power-of-two resolution, which keeps floating sums exact."""
    ev = events(spark, sf_dir)
    name = F.concat(
        F.when(F.col("user_id") % 3 == 0, "split-").otherwise("x-split-"),
        (F.col("user_id") % 5 + 1).cast("string"),
    )
    hour = F.floor(micros() / (HOUR * 1_000_000)) % 24
    values = {
        "bolts_capacity": F.floor(cents() * 1024 / 10000) / 1024.0,
        "worker_cluster_used": F.floor(F.col("value") / 50.0).cast("double"),
        "worker_cluster_total": F.when(hour == 3, 0.0).otherwise(TOTAL_WORKERS),
    }
    sources = [(kind, *pair) for kind, pair in METRIC_OF.items()]
    sources.append(("error", "worker_cluster_total", "ClusterHost"))
    # One branch per metric, so that a selector on the metric drops the other branches and
    # the event type of the one left is pushed into the scan.
    branches = []
    for kind, metric, label in sources:
        pairs = [F.lit(label), name]
        if label == "pod":
            pairs += [F.lit("namespace"), F.lit(NAMESPACE)]
        branches.append(ev.filter(F.col("event_type") == kind).select(
            F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"),
            F.col("ts").cast("timestamp").alias("ts"),
            values.get(metric, F.floor(cents() * 64 / 100) / 64.0).alias("value"),
        ))
    return reduce(DataFrame.unionByName, branches)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        (F.floor(micros() / (HOUR * 1_000_000)) * HOUR).alias("ts_s"),
        "value", F.lit(1).cast("bigint").alias("property"),
        (user % 4).alias("plug_id"), (F.floor(user / 4) % 3).alias("household_id"),
        (user % 5).alias("house_id"),
    )


def queue_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("queue"), micros().alias("ts_us"), "event_id",
        F.when(kind.isin("view", "click"), 1).when(kind.isin("error", "signup"), -1)
        .otherwise(0).cast("bigint").alias("delta"),
    )


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger acyclic graph: customer -> order -> part -> one supplier of the part."""
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    return (
        orders.select(F.col("o_orderkey").alias("edge_no"), name("c", "o_custkey").alias("src"),
                      name("o", "o_orderkey").alias("dst"))
        .unionByName(dealt(items.select("l_orderkey", "l_partkey"), items.count(), "l_orderkey", "l_partkey").distinct().select(
            F.col("l_partkey").alias("edge_no"),
            name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))
        .unionByName(
            items.groupBy("l_partkey").agg(F.min("l_suppkey").alias("s"))
            .select(F.col("l_partkey").alias("edge_no"), name("p", "l_partkey").alias("src"),
                    name("s", "s").alias("dst")))
        .select(F.lit("orders").alias("topology_id"), "edge_no", "src", "dst")
    )


def customers_as_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of ``order_graph``: those with an order."""
    return table(spark, sf_dir, "orders").select("o_custkey").dropna().distinct().select(
        F.lit("orders").alias("topology_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("component_id"))


def ring_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: every customer points at one customer of its block of 16."""
    key = F.col("o_custkey")
    return (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
        .select(
            F.concat(F.lit("t"), (F.floor(key / 16) % 3).cast("string")).alias("topology_id"),
            key.alias("edge_no"),
            key.cast("string").alias("src"),
            (F.floor(key / 16) * 16 + F.col("k") % 16).cast("string").alias("dst"),
        )
    )
