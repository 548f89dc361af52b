"""Load score and replica recommendations.

The score follows the original definition. The manifests of the scaling side give
parameters only, so the replica formulas (target, stabilization, rate limit, backlog) are
this library's own definitions, stated at each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.functions.scalars import clamp
from flowgauge.operators.chain import follow
from flowgauge.operators.ordered import (
    AUTO, clamped_running_sum, last_known, ordered_scan, running_min, trailing_window,
)
from flowgauge.operators.series import (
    Grid, avg_by, avg_over_time, first_series, instant_vector, select_series,
)
from flowgauge.session import cut_lineage

# Fixed values of the score: weight and threshold per input, and the limits applied to it.
SCORE_TERMS = {
    "worker_used": (0.6, 0.7),
    "bolt_capacity": (0.2, 0.5),
    "spout_latency": (0.2, 100.0),
}
ACTIVE_SCORE = 0.7
TARGET_SCORE = 0.75
MIN_REPLICAS, MAX_REPLICAS = 1, 7
STABILIZATION_SECS = LIMIT_PERIOD_SECS = COOLDOWN_SECS = 300
HOLD_SECS = 30
MESSAGES_PER_REPLICA, MAX_QUEUE_REPLICAS = 5, 10
FOLD_LIMIT = 5_000


def worker_utilization(samples: DataFrame, grid: Grid, host: str | None = None) -> DataFrame:
    """Used and total workers per host at each step where either is known, and their ratio.

    The ratio is 0 if one side is missing; ``failed`` marks a total of zero. One pass over
    the samples; the two vectors meet in an aggregation, not in a join.
    """
    names = ["worker_cluster_used", "worker_cluster_total"]
    chosen = select_series(samples, names, {"ClusterHost": host} if host else None, by=("ClusterHost",))
    vector = instant_vector(chosen, grid, ("metric", "ClusterHost", "series"))
    single = first_series(vector, "metric", "ClusterHost")
    side = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    return (
        single.groupBy(F.col("ClusterHost").alias("host"), "step")
        .agg(side(names[0]).alias("used"), side(names[1]).alias("total"))
        .withColumn("worker_used", F.coalesce(F.try_divide(F.col("used"), F.col("total")), F.lit(0.0)))
        .withColumn("failed", F.coalesce((F.col("total") == 0) & F.col("used").isNotNull(), F.lit(False)))
    )


def grid_steps(spark: SparkSession, grid: Grid) -> DataFrame:
    first = -(-grid.start // grid.step)
    return spark.range(first, grid.end // grid.step + 1).select(
        (F.col("id") * grid.step).alias("step")
    )


def score_inputs(
    samples: DataFrame, grid: Grid, latency_source: str, bolt_pattern: str = "split-.*",
    host: str | None = None,
) -> DataFrame:
    """The three inputs per host on the full step grid.

    A missing input is 0; where the utilization cannot be evaluated, all three are 0.
    """
    # One row per host and step, read twice: written, so that its samples are scanned once.
    utilization = cut_lineage(worker_utilization(samples, grid, host))
    capacity = avg_by(avg_over_time(
        select_series(samples, "bolts_capacity", matches={"BoltId": bolt_pattern}), grid))
    latency = first_series(avg_over_time(
        select_series(samples, "spouts_complete_latency", {"SpoutId": latency_source}), grid))
    # A named host has scores even if it reported nothing.
    named = samples.sparkSession.createDataFrame([(host,)], "host string") if host is not None else None
    hosts = utilization.select("host").distinct() if named is None else named
    steps = (
        grid_steps(samples.sparkSession, grid)
        .join(capacity.withColumnRenamed("value", "bolt_capacity"), "step", "left")
        .join(latency.select("step", F.col("value").alias("spout_latency")), "step", "left")
    )
    # hosts x steps is the result's own size: one row per host and evaluation time.
    every = hosts.withColumn("step", F.explode(F.sequence(
        F.lit(-(-grid.start // grid.step) * grid.step).cast("bigint"),
        F.lit(grid.end).cast("bigint"), F.lit(grid.step).cast("bigint"))))
    joined = every.join(steps, "step").join(utilization, ["host", "step"], "left")
    failed = F.coalesce("failed", F.lit(False))
    zero = F.lit(0.0)
    return joined.select(
        "host", "step", "used",
        *[F.when(failed, zero).otherwise(F.coalesce(name, zero)).alias(name) for name in SCORE_TERMS],
    )


def term(name: str) -> Column:
    weight, threshold = SCORE_TERMS[name]
    return F.lit(weight) * F.col(name) / F.lit(threshold)


def load_score(inputs: DataFrame) -> DataFrame:
    total = sum((term(name) for name in SCORE_TERMS), F.lit(0.0))
    return inputs.withColumn("score", F.round(total, 9))


def score_parts(inputs: DataFrame) -> DataFrame:
    """Long form: what each input adds to the score."""
    parts = inputs.select("host", "step", *[term(n).alias(n) for n in SCORE_TERMS])
    return parts.unpivot(["host", "step"], list(SCORE_TERMS), "item", "part")


def is_active(scored: DataFrame, limit: float = ACTIVE_SCORE) -> DataFrame:
    return scored.withColumn("is_active", F.col("score") > limit)


def score_spec() -> list[dict]:
    return [{"metricName": "custom_metric", "targetValue": ACTIVE_SCORE}]


def score_report(scored: DataFrame) -> DataFrame:
    """``metric_values`` as name and value pairs, the record of inputs beside it."""
    return scored.select(
        "host", "step",
        F.array(F.struct(F.lit("custom_metric").alias("metricName"),
                         F.col("score").alias("metricValue"))).alias("metric_values"),
        F.struct(F.lit("specificMetrics").alias("metricName"),
                 F.struct(*SCORE_TERMS).alias("metricValue")).alias("specific_metrics"),
    )


def score_report_rows(report: DataFrame) -> DataFrame:
    """The report as one row per name and value."""
    specific = [
        F.struct(F.lit(n).alias("metricName"), F.col(f"specific_metrics.metricValue.{n}").alias("metricValue"))
        for n in SCORE_TERMS
    ]
    return report.select(
        "host", "step", F.inline(F.concat("metric_values", F.array(*specific)))
    ).withColumnsRenamed({"metricName": "metric_name", "metricValue": "metric_value"})


def score_snapshots(scored: DataFrame, hold: int = HOLD_SECS) -> DataFrame:
    """The first score of each holding period serves the whole period."""
    period = F.floor(F.col("step") / hold)
    window = Window.partitionBy("host", period).orderBy("step")
    return scored.withColumn("served_score", F.first("score").over(window))


def replica_target(
    scored: DataFrame, current: Column, threshold: float = TARGET_SCORE,
    low: int = MIN_REPLICAS, high: int = MAX_REPLICAS,
) -> DataFrame:
    """``ceil(current * score / threshold)`` within the bounds."""
    wanted = F.ceil(current * F.col("score") / F.lit(threshold))
    return scored.withColumn("current", current).withColumn("desired", clamp(wanted, low, high))


def after_cooldown(rows: DataFrame, cooldown: int = COOLDOWN_SECS) -> DataFrame:
    """Drop the first seconds of each target."""
    first = rows.groupBy("host").agg(F.min("step").alias("_first"))
    return rows.join(first, "host").filter(F.col("step") >= F.col("_first") + cooldown).drop("_first")


def replica_stabilized(recommended: DataFrame, span: int = STABILIZATION_SECS) -> DataFrame:
    """Up only to the lowest, down only to the highest recommendation of the trailing span."""
    return trailing_window(
        recommended, ["host"], "step", span,
        {"scale_up_to": F.min("desired"), "scale_down_to": F.max("desired")},
    )


def replica_rate_limit(
    stabilized: DataFrame, period: int = LIMIT_PERIOD_SECS, down_period: int | None = None, *,
    low: int = MIN_REPLICAS, high: int = MAX_REPLICAS, fold_limit: int = FOLD_LIMIT,
    width: int | str | None = AUTO,
) -> DataFrame:
    """Replicas when at most one is added per ``period`` and one removed per ``down_period``
    (``period`` if not given).

    Recommendations are brought within ``low`` and ``high`` first. The count starts at the first
    ``current``. It moves up by one towards a higher ``scale_up_to`` once ``period`` has passed
    since the last move up, else down by one towards a lower ``scale_down_to`` once
    ``down_period`` has passed since the last move down; neither direction waits for the other.
    Short histories are folded per target. In long ones the state after a change is (replicas,
    earliest move up, earliest move down); the next change is looked up for every such state at
    once, and the chain of states is followed by doubling. There are as many states per step as
    steps in a period.
    """
    period = max(period, 1)
    down_period = period if down_period is None else max(down_period, 1)
    bounded = {c: clamp(F.col(c), low, high).cast("bigint") for c in ("scale_up_to", "scale_down_to")}
    rows = cut_lineage(stabilized.withColumns(bounded))  # both ways below see the bounds
    longest = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    first = rows.groupBy("host").agg(F.min("step").alias("step"), F.min_by("current", "step").alias("replicas"))
    first = first.withColumn("replicas", clamp(F.col("replicas").cast("bigint"), low, high).cast("bigint"))
    if longest <= fold_limit:
        changes = _fold_changes(rows, first, period, down_period)
    else:
        changes = _follow_changes(rows, first, period, down_period, low, high, width)
    marked = rows.join(_last_change(first, changes), ["host", "step"], "left")
    return ordered_scan(
        marked, ["host"], ["step"], {"replicas": last_known(F.col("_set"))},
        width=None if longest <= fold_limit else width,
    ).drop("_set")


def _last_change(first, changes):
    """Replicas set at a step; a change at the very first step wins over the start value."""
    return (
        first.withColumn("_no", F.lit(0)).unionByName(changes.withColumn("_no", F.lit(1)))
        .groupBy("host", "step").agg(F.max_by("replicas", "_no").alias("_set"))
    )


def _fold_changes(rows, first, period, down_period):
    row = "struct<step:bigint,replicas:bigint>"
    null = F.lit(None).cast("bigint")
    start = F.struct(F.col("_start").alias("r"), null.alias("up"), null.alias("down"),
                     F.expr(f"cast(array() as array<{row}>)").alias("changes"))

    def visit(state, x):
        ready = lambda clock: state[clock].isNull() | (x["step"] >= state[clock])
        move = (
            F.when(ready("up") & (x["scale_up_to"] > state["r"]), 1)
            .when(ready("down") & (x["scale_down_to"] < state["r"]), -1)
            .otherwise(0)
        )
        after = (state["r"] + move).cast("bigint")
        change = F.struct(x["step"].alias("step"), after.alias("replicas"))
        return F.when(move == 0, state).otherwise(F.struct(
            after.alias("r"),
            F.when(move > 0, x["step"] + period).otherwise(state["up"]).alias("up"),
            F.when(move < 0, x["step"] + down_period).otherwise(state["down"]).alias("down"),
            F.concat(state["changes"], F.array(change)).alias("changes")))

    return (
        rows.groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("step", "scale_up_to", "scale_down_to"))).alias("_rows"))
        .join(first.select("host", F.col("replicas").alias("_start")), "host")
        .select("host", F.explode(F.aggregate("_rows", start, visit)["changes"]).alias("_c"))
        .select("host", "_c.*")
    )


def _clocks(steps, span):
    """Times at which a pause of ``span`` that still runs at a step may end, and the next second for
    one that does not (``other``). Steps meet by stretches of ``span``, not one task per target."""
    stretch = F.floor(F.col("step") / span)
    earlier = steps.select(
        "host", (F.col("step") + span).alias("other"), F.explode(F.array(stretch, stretch + 1)).alias("_stretch"))
    running = (
        steps.withColumn("_stretch", stretch).join(earlier, ["host", "_stretch"])
        .filter((F.col("other") < F.col("step") + span) & (F.col("other") > F.col("step") + 1))
    )
    return running.select("host", "step", "other").unionByName(
        steps.withColumn("other", F.col("step") + 1))


def _next_move(wide, states, ready, wanted, name, width):
    """The first step from ``ready`` on at which ``wanted`` holds, for every state that has one."""
    null = F.lit(None).cast("bigint")
    options = wide.filter(wanted).select(
        "host", "replicas", (-F.col("step")).alias("_at"), F.lit(0).alias("_kind"),
        F.col("step").alias("_move"), null.alias(ready))
    asked = states.select("host", "replicas", ready).distinct().select(
        "host", "replicas", (-F.col(ready)).alias("_at"), F.lit(1).alias("_kind"), null.alias("_move"), ready)
    return ordered_scan(
        options.unionByName(asked), ["host", "replicas"], ["_at", "_kind"],
        {name: running_min(F.col("_move"))}, width=width,
    ).filter(F.col(ready).isNotNull() & F.col(name).isNotNull()).select("host", "replicas", ready, name)


def _follow_changes(rows, first, period, down_period, low, high, width):
    levels = F.explode(F.sequence(F.lit(low), F.lit(high)).cast("array<bigint>")).alias("replicas")
    wide = rows.select("host", "step", "scale_up_to", "scale_down_to", levels)
    steps = rows.select("host", "step").distinct()
    node = ["replicas", "ready_up", "ready_down"]
    step = F.col("step")
    after_up = _clocks(steps, down_period).select(
        "host", (step + period).alias("ready_up"), F.col("other").alias("ready_down"))
    after_down = _clocks(steps, period).select(
        "host", F.col("other").alias("ready_up"), (step + down_period).alias("ready_down"))
    roots = first.select("host", "replicas", step.alias("ready_up"), step.alias("ready_down"))
    states = cut_lineage(
        after_up.unionByName(after_down).select("host", levels, "ready_up", "ready_down")
        .unionByName(roots).distinct())
    up = _next_move(wide, states, "ready_up", F.col("scale_up_to") > F.col("replicas"), "_up", width)
    down = _next_move(wide, states, "ready_down", F.col("scale_down_to") < F.col("replicas"), "_down", width)
    found = (
        states.join(up, ["host", "replicas", "ready_up"], "left")
        .join(down, ["host", "replicas", "ready_down"], "left")
        .withColumn("step", F.least("_up", "_down")).filter("step is not null")
    )
    rises = F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") <= F.col("_down")))
    links = cut_lineage(found.select(
        "host", *node, "step",
        (F.col("replicas") + F.when(rises, 1).otherwise(-1)).cast("bigint").alias("next_replicas"),
        F.when(rises, step + period).otherwise(F.greatest(F.col("ready_up"), step + 1)).alias("next_up"),
        F.when(rises, F.greatest(F.col("ready_down"), step + 1)).otherwise(step + down_period).alias("next_down"),
    ))
    chain = follow(links, roots, ["host"], node, ["next_replicas", "next_up", "next_down"])
    return chain.join(links, ["host", *node]).select("host", "step", F.col("next_replicas").alias("replicas"))


def backlog_replicas(
    steps: DataFrame, per_replica: int = MESSAGES_PER_REPLICA, low: int = MIN_REPLICAS,
    high: int = MAX_QUEUE_REPLICAS, **scan,
) -> DataFrame:
    """Backlog of each queue after each message (never below 0), and the replicas for it:
    ``ceil(backlog / per_replica)`` within the bounds."""
    scan.setdefault("grain", 3600 * 1_000_000)
    counted = clamped_running_sum(steps, ["queue"], ["ts_us", "event_id"], F.col("delta"), "backlog", **scan)
    return counted.withColumn(
        "replicas", clamp(F.ceil(F.col("backlog") / per_replica), low, high).cast("bigint")
    )
