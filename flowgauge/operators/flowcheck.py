"""Flow check: which operators should get another executor, and when.

A source below its target collects severity from tick to tick. At severity 2 the busiest
operators below it get one executor more; every severity of the topology then falls back
to 0, and the next tick only sets a new baseline. Read as a program this is a loop over
ticks. Here it is split into parts that run in parallel over all ticks:

1. The change of severity at a tick depends on two neighbouring ticks only.
2. With C the running sum of the changes, severity since baseline b is
   ``C[u] - min(C[b..u])``. It is 2 or more exactly when some k in [b, u) has
   ``C[k] <= C[u] - 2``. A change lies in -1..2, so the last such k has
   ``C[k]`` equal to ``C[u] - 2`` or ``C[u] - 3``, and it is found by an equality lookup.
   A tick u can thus decide a plan for every baseline up to its ``since`` = that k.
3. What is left is to pick plans greedily: from baseline b the earliest u with
   ``since >= b``, then baseline u + 1, and so on. Short histories do this in one fold
   per topology; long ones follow the links by doubling (``operators.chain``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.scalars import holds
from flowgauge.operators.chain import follow
from flowgauge.operators.ordered import (
    AUTO, MAX_GROUP_ROWS, chunk_width, clamped_running_sum, last_known, ordered_scan, previous,
    running_count, running_min, running_sum,
)
from flowgauge.operators.rollup import thread_count
from flowgauge.session import cut_lineage

# Fixed values of the rule.
TRIGGER_SEVERITY = 2
RISE, DROP, LATENCY_GROWTH = 0.01, 0.02, 1.0
HOT_CAPACITY, STRICT_CAPACITY = 0.7, 0.9
CORES, START_WORKERS, MAX_WORKERS, THREADS_PER_CORE = 2, 2, 28, 2

SPOUT_KEY = ["topology_id", "component_id"]
FOLD_LIMIT = 5_000
WORKER_BLOCK = 64
#: A baseline before every tick: severity goes on from what is carried.
GOES_ON = -(10**9)
SOURCE_STATE = "topology_id string, component_id string, tick bigint, acked_rate double, complete_latency double, severity bigint"
TOPOLOGY_STATE = "topology_id string, baseline boolean, workers bigint, moves bigint"


class FlowState(NamedTuple):
    """What a flow check needs of the ticks before: ``sources`` with their last values and severity, and
    ``topologies`` with whether the next tick is a baseline, the worker count and the plans so far."""

    sources: DataFrame
    topologies: DataFrame


def spout_targets(spouts: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources with their target; targets without a source fall out."""
    return spouts.join(targets.select(*SPOUT_KEY, "target_rate"), SPOUT_KEY)


def spouts_without_target(spouts: DataFrame, targets: DataFrame) -> DataFrame:
    """Reject list: sources that no target names."""
    return spouts.select(*SPOUT_KEY).distinct().join(targets, SPOUT_KEY, "left_anti")


def below_target(spouts: DataFrame, targets: DataFrame) -> DataFrame:
    return spout_targets(spouts, targets).filter("target_rate > acked_rate")


def hot_components(metrics: DataFrame, limit: float = HOT_CAPACITY) -> DataFrame:
    return metrics.filter(F.col("capacity") > limit)


def with_previous(
    spouts: DataFrame, columns: tuple[str, ...] = ("acked_rate", "complete_latency"),
    width: int | str | None = AUTO,
) -> DataFrame:
    """Each source's row beside the values of its preceding tick; no self-join."""
    return ordered_scan(
        spouts, SPOUT_KEY, ["tick"], {f"prev_{c}": previous(F.col(c)) for c in columns}, width=width
    )


def relative_change(current: Column, before: Column) -> Column:
    return F.try_divide(current - before, before)


def severity_delta(p: Column, c: Column, pl: Column, cl: Column) -> Column:
    """Change of severity from the previous (p, pl) and current (c, cl) rate and latency.

    A zero base means an infinite relative change where the value moved, and none where it
    did not. A missing value makes its comparison false.
    """
    rose = (p == 0) | (F.try_divide(c - p, p) > RISE)
    dropped = (p != 0) & (F.try_divide(p - c, p) > DROP)
    slower = (cl > pl) & ((pl == 0) | (F.try_divide(cl - pl, pl) > LATENCY_GROWTH))
    as_int = lambda cond: F.when(holds(cond), 1).otherwise(0)
    return (
        F.when(holds(c > p), F.when(holds(rose), -1).otherwise(1 - as_int(pl > cl)))
        .otherwise(as_int(dropped) + as_int(slower))
        .cast("bigint")
    )


def spout_checks(
    spouts: DataFrame, targets: DataFrame, width: int | str | None = AUTO
) -> DataFrame:
    """Per source and tick: previous values, whether it is below target, and the change of
    severity, which counts only below target."""
    paired = with_previous(spout_targets(spouts, targets), width=width)
    delta = severity_delta(
        F.col("prev_acked_rate"), F.col("acked_rate"),
        F.col("prev_complete_latency"), F.col("complete_latency"),
    )
    return paired.withColumn("below", holds(F.col("target_rate") > F.col("acked_rate"))).withColumn(
        "delta",
        F.when(F.col("below") & F.col("prev_acked_rate").isNotNull(), delta)
        .otherwise(F.lit(0).cast("bigint")),
    )


def severity_without_reset(checks: DataFrame, width: int | str | None = AUTO) -> DataFrame:
    """Severity if no plan were ever made."""
    return clamped_running_sum(
        checks, SPOUT_KEY, ["tick"], F.col("delta"), "severity_no_reset", width=width
    )


# --- candidates and their order -----------------------------------------------------


def reach_metrics(reach: DataFrame, metrics: DataFrame) -> DataFrame:
    """Reachable operators with their metrics, one row per (topology, tick, root, operator).

    If ``reach`` has a tick column, only those ticks are joined."""
    bolts = metrics.filter("component_type = 'bolt'").select(
        "topology_id", "tick", "component_id", "executors", "capacity"
    )
    keys = ["topology_id", "component_id", *(["tick"] if "tick" in reach.columns else [])]
    return reach.join(bolts, keys)


def rank_bolts(candidates: DataFrame) -> DataFrame:
    """Operators of a root at a tick by falling capacity; ties by name."""
    order = Window.partitionBy("topology_id", "tick", "root").orderBy(
        F.col("capacity").desc_nulls_last(), "component_id"
    )
    return candidates.withColumn("rank", F.row_number().over(order).cast("bigint"))


def pick_bolts(ranked: DataFrame, limit: float = HOT_CAPACITY) -> DataFrame:
    """The busiest operator always, and every other one above the limit."""
    return ranked.filter((F.col("rank") == 1) | holds(F.col("capacity") > limit))


# --- the loop ------------------------------------------------------------------------


def number_ticks(metrics: DataFrame, width: int | None = None) -> DataFrame:
    """Ordinal of each tick within its topology, from 1."""
    ticks = metrics.select("topology_id", "tick").distinct()
    return ordered_scan(ticks, ["topology_id"], ["tick"], {"ordinal": running_count()}, width=width)


def flow_check(
    metrics: DataFrame,
    targets: DataFrame,
    reach: DataFrame,
    *,
    fold_limit: int = FOLD_LIMIT,
    max_group_rows: int = MAX_GROUP_ROWS,
    state: FlowState | None = None,
) -> "FlowCheck":
    """Run the whole check. ``reach`` has (topology_id, root, component_id).

    ``metrics`` is read several times; pass a written table (``session.cut_lineage``).
    Histories of up to ``fold_limit`` ticks, counted first, are folded per topology. With
    ``state`` the check goes on where ``FlowCheck.state_after`` of the ticks before left it.
    """
    distinct_ticks = metrics.select("topology_id", "tick").distinct()
    longest = (
        distinct_ticks.groupBy("topology_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    )
    tick_width = ordinal_width = None
    if longest > max_group_rows:
        tick_width = chunk_width(distinct_ticks, ["topology_id"], "tick", 3600, max_group_rows)
        ordinal_width = max_group_rows
    ticks = number_ticks(metrics, tick_width)
    spouts = metrics.filter("component_type = 'spout'")
    if state is None:
        checks = spout_checks(spouts, targets, width=tick_width).join(ticks, ["topology_id", "tick"])
    else:
        checks = _checks_after(state, spouts, targets, ticks, tick_width)
    summed = cut_lineage(
        ordered_scan(checks, SPOUT_KEY, ["ordinal"], {"level": running_sum(F.col("delta"))},
                     width=ordinal_width)
    )
    # The plans are chosen from these and read them again, so they are written.
    since = cut_lineage(_plan_since(summed, reach, metrics, ordinal_width))
    first = _first_baselines(since, state)
    plans = cut_lineage(_choose_plans(since, first, longest <= fold_limit, ordinal_width))
    return FlowCheck(metrics, reach, ticks, summed, since, plans, ordinal_width, state)


def _checks_after(state: FlowState, spouts, targets, ticks, width) -> DataFrame:
    """Checks of the new ticks, with the last rows before them in place of the history.

    A carried severity s stands as rows before the first tick whose levels rise from 0 to s by 2 at
    most, as levels of ticks do.
    """
    values = [*SPOUT_KEY, "tick", "acked_rate", "complete_latency"]
    rows = spouts.select(*values, F.lit(None).cast("bigint").alias("_severity")).unionByName(
        state.sources.select(*values, F.col("severity").alias("_severity")))
    checks = spout_checks(rows, targets, width=width)
    new = checks.filter("_severity is null").join(ticks, ["topology_id", "tick"]).drop("_severity")
    back = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_severity") / 2))).alias("_back")
    old = checks.filter("_severity is not null").select("*", back)
    level = lambda back: F.greatest(F.col("_severity") - 2 * back, F.lit(0))
    rise = F.when(F.col("_back") == F.ceil(F.col("_severity") / 2), F.lit(0)).otherwise(
        level(F.col("_back")) - level(F.col("_back") + 1))
    old = old.withColumn("below", F.lit(False)).withColumn("delta", rise.cast("bigint")).withColumn(
        "ordinal", -F.col("_back")).drop("_severity", "_back")
    return new.unionByName(old)


def _first_baselines(since, state: FlowState | None) -> DataFrame:
    """(topology_id, baseline) from which plans are looked for: the first tick, or before it where
    severity is carried on."""
    known = since.select("topology_id").distinct()
    if state is None:
        return known.withColumn("baseline", F.lit(1).cast("bigint"))
    carried = state.topologies.select("topology_id", F.when(F.col("baseline"), 1).otherwise(GOES_ON).alias("_b"))
    return known.join(carried, "topology_id", "left").select(
        "topology_id", F.coalesce("_b", F.lit(1)).cast("bigint").alias("baseline"))


def _plan_since(summed, reach, metrics, width) -> DataFrame:
    """(topology, spout, tick, ordinal, since): ticks that can decide a plan for every
    baseline up to ``since``. Ticks where no operator below the source has metrics cannot."""
    flat = summed.select(*SPOUT_KEY, "tick", "ordinal", "below", "level")
    # A level holds until the tick before the source's next row, should ticks be missing.
    held = ordered_scan(
        flat.withColumn("_back", -F.col("ordinal")), SPOUT_KEY, ["_back"],
        {"_next": previous(F.col("ordinal"))}, width=width,
    )
    marks = held.select(*SPOUT_KEY, F.col("level").alias("sought"), "ordinal",
                        (F.col("_next") - 1).alias("seen_at"),
                        F.lit(None).cast("bigint").alias("tick"))
    asks = flat.filter("below").select(
        *SPOUT_KEY,
        F.explode(F.array(F.col("level") - TRIGGER_SEVERITY,
                          F.col("level") - TRIGGER_SEVERITY - 1)).alias("sought"),
        "ordinal", F.lit(None).cast("bigint").alias("seen_at"), "tick",
    )
    looked_up = ordered_scan(
        marks.unionByName(asks), [*SPOUT_KEY, "sought"], ["ordinal"],
        {"last_seen": last_known(F.col("seen_at"))}, width=width, grain=1,
    )
    able = (
        looked_up.filter("tick is not null and last_seen is not null")
        .groupBy(*SPOUT_KEY, "tick", "ordinal")
        .agg(F.max("last_seen").alias("since"))
    )
    below = able.join(
        reach.select("topology_id", F.col("root").alias("component_id"),
                     F.col("component_id").alias("_bolt")),
        SPOUT_KEY,
    )
    bolts = metrics.filter("component_type = 'bolt'").select(
        "topology_id", "tick", F.col("component_id").alias("_bolt")
    )
    return (
        below.join(bolts, ["topology_id", "tick", "_bolt"], "left_semi")
        .groupBy(*SPOUT_KEY, "tick", "ordinal")
        .agg(F.max("since").alias("since"))
    )


def _choose_plans(since, first, short: bool, width) -> DataFrame:
    """(topology_id, baseline, ordinal, tick) of the plans made."""
    options = since.groupBy("topology_id", "ordinal", "tick").agg(F.max("since").alias("since"))
    return _fold_plans(options, first) if short else _follow_plans(options, first, width)


def _fold_plans(options, first) -> DataFrame:
    row = "struct<baseline:bigint,ordinal:bigint,tick:bigint>"
    start = F.struct(F.col("baseline").alias("baseline"),
                     F.expr(f"cast(array() as array<{row}>)").alias("plans"))

    def visit(state, option):
        plan = F.struct(state["baseline"].alias("baseline"), option["ordinal"].alias("ordinal"),
                        option["tick"].alias("tick"))
        return F.when(
            option["since"] >= state["baseline"],
            F.struct((option["ordinal"] + 1).alias("baseline"),
                     F.concat(state["plans"], F.array(plan)).alias("plans")),
        ).otherwise(state)

    return (
        options.groupBy("topology_id")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "since", "tick"))).alias("_options"))
        .join(first, "topology_id")
        .select("topology_id", F.explode(F.aggregate("_options", start, visit)["plans"]).alias("_p"))
        .select("topology_id", "_p.*")
    )


def _follow_plans(options, first, width) -> DataFrame:
    """Earliest deciding tick for each possible baseline, then the chain from the first baseline."""
    options = cut_lineage(options)
    roots = first
    baselines = roots.unionByName(
        options.select("topology_id", (F.col("ordinal") + 1).alias("baseline"))
    )
    # Backwards by position: all options whose `since` is at or after a baseline come
    # before it, so a running minimum gives the earliest of them.
    line = options.select(
        "topology_id", (-F.col("since")).alias("_at"), F.lit(0).alias("_kind"), "ordinal",
        F.lit(None).cast("bigint").alias("baseline"),
    ).unionByName(
        baselines.select("topology_id", (-F.col("baseline")).alias("_at"), F.lit(1).alias("_kind"),
                         F.lit(None).cast("bigint").alias("ordinal"), "baseline")
    )
    earliest = ordered_scan(
        line, ["topology_id"], ["_at", "_kind", "ordinal"], {"plan_at": running_min(F.col("ordinal"))},
        width=width, grain=1,
    )
    links = cut_lineage(
        earliest.filter("baseline is not null and plan_at is not null").select(
            "topology_id", "baseline", (F.col("plan_at") + 1).alias("next_baseline")
        )
    )
    chain = follow(links, roots, ["topology_id"], ["baseline"], ["next_baseline"])
    return (
        chain.join(links, ["topology_id", "baseline"])
        .select("topology_id", "baseline", (F.col("next_baseline") - 1).alias("ordinal"))
        .join(options.select("topology_id", "ordinal", "tick"), ["topology_id", "ordinal"])
        .select("topology_id", "baseline", "ordinal", "tick")
    )


class FlowCheck:
    """Tables of one flow check; each is an ordinary DataFrame."""

    def __init__(self, metrics, reach, ticks, summed, since, plans, width, state=None):
        self.metrics, self.reach, self.ticks, self.summed = metrics, reach, ticks, summed
        self.since, self.plans, self.width, self.state = since, plans, width, state

    def triggers(self) -> DataFrame:
        """Sources that reached the limit at a tick with a plan."""
        baselines = self.plans.select("topology_id", "ordinal", "baseline")
        return (
            self.since.join(baselines, ["topology_id", "ordinal"])
            .filter("since >= baseline")
            .select("topology_id", "tick", F.col("component_id").alias("root"))
        )

    def executor_plan(self, limit: float = HOT_CAPACITY) -> DataFrame:
        """Executors before and after; an operator two sources ask for is raised once."""
        wanted = reach_metrics(
            self.reach.join(self.triggers(), ["topology_id", "root"]), self.metrics
        )
        return (
            pick_bolts(rank_bolts(wanted), limit)
            .dropDuplicates(["topology_id", "tick", "component_id"])
            .select(
                "topology_id", "tick", "component_id",
                F.col("executors").alias("executors_before"),
                (F.col("executors") + 1).alias("executors_after"),
            )
        )

    def plan_counts(self) -> DataFrame:
        """Operators raised per plan, and the number of plans so far."""
        changes = self.executor_plan().groupBy("topology_id", "tick").agg(
            F.count(F.lit(1)).alias("changes")
        )
        return ordered_scan(
            changes, ["topology_id"], ["tick"], {"moves": running_count()},
            width=None if self.width is None else AUTO,
        )

    def worker_plan(
        self, cores: int = CORES, workers: int = START_WORKERS, max_workers: int = MAX_WORKERS
    ) -> DataFrame:
        """Workers before and after each plan; a carried state's counts go on."""
        load = (
            self.plan_counts()
            .join(thread_count(self.metrics), ["topology_id", "tick"])
            .withColumn("demand", F.col("threads") + F.col("changes"))
        )
        if self.state is None:
            return workers_over_plans(load, cores, workers, max_workers)
        carried = self.state.topologies.select("topology_id", "workers", F.col("moves").alias("_made"))
        rows = workers_over_plans(load, cores, workers, max_workers, starts=carried.drop("_made"))
        return rows.join(carried.drop("workers"), "topology_id", "left").withColumn(
            "moves", F.col("moves") + F.coalesce("_made", F.lit(0))).drop("_made")

    def state_after(self, workers: DataFrame, start_workers: int = START_WORKERS) -> FlowState:
        """What the check of the ticks after these needs; ``workers`` is ``worker_plan()``."""
        plans = self.plans.groupBy("topology_id").agg(F.max("ordinal").alias("_plan"))
        first = _first_baselines(self.ticks, self.state)
        # Severity counts from the tick after the last plan; the level there may be an earlier row's.
        reset = F.coalesce(F.col("_plan") + 1, F.col("baseline"))
        rows = self.summed.join(plans, "topology_id", "left").join(first, "topology_id", "left").withColumn(
            "_reset", F.coalesce(reset, F.lit(GOES_ON)))
        after = F.col("ordinal") >= F.col("_reset")
        at = lambda column: F.max_by(column, "ordinal")
        lowest = F.least(F.max_by("level", F.when(F.col("ordinal") <= F.col("_reset"), F.col("ordinal"))),
                         F.min(F.when(after, F.col("level"))))
        sources = rows.groupBy(*SPOUT_KEY).agg(
            F.max("tick").alias("tick"), at("acked_rate").alias("acked_rate"), at("complete_latency").alias("complete_latency"),
            (at("level") - lowest).alias("severity"))
        last = self.ticks.groupBy("topology_id").agg(F.max("ordinal").alias("_end")).join(plans, "topology_id", "left").select(
            "topology_id", F.coalesce(F.col("_plan") == F.col("_end"), F.lit(False)).alias("_baseline"))
        made = workers.groupBy("topology_id").agg(
            F.max_by("workers_after", "moves").alias("_workers"), F.max("moves").alias("_moves"))
        before = self.state.topologies if self.state else last.select(
            "topology_id", F.lit(True).alias("baseline"), F.lit(start_workers).cast("bigint").alias("workers"),
            F.lit(0).cast("bigint").alias("moves"))
        topologies = before.join(last, "topology_id", "full").join(made, "topology_id", "left").select(
            "topology_id", F.coalesce("_baseline", "baseline").alias("baseline"),
            F.coalesce("_workers", "workers", F.lit(start_workers)).cast("bigint").alias("workers"),
            F.coalesce("_moves", "moves", F.lit(0)).cast("bigint").alias("moves"))
        return FlowState(sources, topologies)

    def commits(self) -> DataFrame:
        """One row per plan: component to executor count, the worker count if it changes,
        and a wait of 0 seconds. A plan counts as committed once it is made."""
        executors = self.executor_plan().groupBy("topology_id", "tick").agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("component_id", "executors_after")))
            ).alias("num_executors")
        )
        workers = self.worker_plan().select(
            "topology_id", "tick",
            F.when(F.col("workers_after") > F.col("workers_before"), F.col("workers_after")).alias("num_workers"),
        )
        return executors.join(workers, ["topology_id", "tick"]).withColumn(
            "wait_secs", F.lit(0).cast("bigint")
        )

    def cooldown(self) -> DataFrame:
        """State of every tick: plan, baseline (after a plan, and at the start) or check."""
        plans = self.plans.select("topology_id", "ordinal", F.lit("plan").alias("_planned"))
        rests = self.plans.select(
            "topology_id", (F.col("ordinal") + 1).alias("ordinal"), F.lit("baseline").alias("_rest")
        )
        return (
            self.ticks.join(plans, ["topology_id", "ordinal"], "left")
            .join(rests, ["topology_id", "ordinal"], "left")
            .select(
                "topology_id", "tick", "ordinal",
                F.when(F.col("ordinal") == 1, "baseline")
                .otherwise(F.coalesce("_planned", "_rest", F.lit("check"))).alias("state"),
            )
        )

    def audit(self) -> DataFrame:
        """Per source and tick: rates against target, old and new severity, relative change,
        and whether the topology got a plan."""
        starts = self.plans.select(
            "topology_id", (F.col("ordinal") + 1).alias("ordinal"),
            (F.col("ordinal") + 1).alias("_start"),
        )
        # Segments belong to the topology's ticks, as a source may miss the baseline tick.
        segments = ordered_scan(
            self.ticks.join(starts, ["topology_id", "ordinal"], "left"), ["topology_id"], ["ordinal"],
            {"_last_start": last_known(F.col("_start"))}, width=self.width, grain=1,
        ).select(
            "topology_id", "ordinal",
            F.coalesce("_last_start", F.lit(1).cast("bigint")).alias("segment"),
        )
        segmented = self.summed.join(segments, ["topology_id", "ordinal"])
        # Without a row at the baseline tick, the level there is the one before the first
        # row of the segment, which is level - delta.
        segmented = segmented.withColumn(
            "_floor",
            F.when(F.col("ordinal") == F.col("segment"), F.col("level"))
            .otherwise(F.least("level", F.col("level") - F.col("delta"))),
        )
        scanned = ordered_scan(
            segmented, [*SPOUT_KEY, "segment"], ["ordinal"], {"_lowest": running_min(F.col("_floor"))},
            width=self.width, grain=1,
        ).withColumn("severity", F.col("level") - F.col("_lowest"))
        aged = ordered_scan(
            scanned, [*SPOUT_KEY, "segment"], ["ordinal"], {"_before": previous(F.col("severity"))},
            width=self.width, grain=1,
        )
        planned = self.plans.select("topology_id", "ordinal", F.lit(True).alias("_plan"))
        return aged.join(planned, ["topology_id", "ordinal"], "left").select(
            *SPOUT_KEY, "tick", "ordinal", "target_rate", "prev_acked_rate", "acked_rate", "below",
            relative_change(F.col("acked_rate"), F.col("prev_acked_rate")).alias("rate_change"),
            relative_change(F.col("complete_latency"), F.col("prev_complete_latency")).alias("latency_change"),
            F.coalesce("_before", F.lit(0).cast("bigint")).alias("severity_before"),
            "severity",
            F.coalesce("_plan", F.lit(False)).alias("planned"),
        )


def workers_over_plans(
    load: DataFrame, cores: int = CORES, workers: int = START_WORKERS, max_workers: int = MAX_WORKERS,
    block: int = WORKER_BLOCK, starts: DataFrame | None = None,
) -> DataFrame:
    """Worker count before and after each plan, given its ``moves`` number and ``demand``.

    One plan maps a worker count w to w + 1 when ``demand div (cores * w) > 2`` and w is
    below the limit. There are few worker counts, so a block of plans is a small table
    from count to count. The tables are composed by doubling, each with the one as many blocks
    before it as it already spans, and only then expanded again. No row holds more than a
    block of plans or one table. ``starts`` (topology_id, workers) are counts other than
    ``workers``, and not below it, to start from.
    """
    counts = F.sequence(F.lit(workers), F.lit(max(workers, max_workers))).cast("array<bigint>")

    def step(w: Column, demand: Column) -> Column:
        more = F.expr("cast(0 as bigint)")
        grows = (F.floor(demand / (F.lit(cores) * w)) > THREADS_PER_CORE) & (w < max_workers)
        return w + F.when(grows, F.lit(1).cast("bigint")).otherwise(more)

    blocks = cut_lineage(
        load.withColumn("_block", F.floor((F.col("moves") - 1) / block))
        .groupBy("topology_id", "_block")
        .agg(F.array_sort(F.collect_list(F.struct("moves", "demand", "tick", "changes", "threads"))).alias("_plans"))
        .withColumn("_map", F.aggregate(
            "_plans", counts,
            lambda acc, p: F.transform(acc, lambda w: step(w, p["demand"])),
        ))
    )
    scanned = blocks.select("topology_id", "_block", "_map")
    last, span = blocks.agg(F.max("_block")).first()[0] or 0, 1
    while span <= last:
        earlier = scanned.select("topology_id", (F.col("_block") + span).alias("_block"), F.col("_map").alias("_first"))
        both = F.transform("_first", lambda w: F.element_at("_map", (w - workers + 1).cast("int")))
        scanned = cut_lineage(scanned.join(earlier, ["topology_id", "_block"], "left").select(
            "topology_id", "_block", F.coalesce(both, "_map").alias("_map")))
        span *= 2
    entered = blocks.select("topology_id", "_block").join(
        scanned.select("topology_id", (F.col("_block") + 1).alias("_block"), "_map"), ["topology_id", "_block"], "left")
    if starts is None:
        entered = entered.withColumn("_start", F.lit(workers).cast("bigint"))
    else:
        entered = entered.join(starts.select("topology_id", F.col("workers").alias("_own")), "topology_id", "left").withColumn(
            "_start", F.coalesce("_own", F.lit(workers)).cast("bigint"))
    entries = entered.select("topology_id", "_block", F.coalesce(
        F.element_at("_map", (F.col("_start") - workers + 1).cast("int")), "_start").alias("_entry"))
    out_row = ("struct<tick:bigint,moves:bigint,changes:bigint,threads:bigint,"
               "workers_before:bigint,workers_after:bigint>")
    begin = F.struct(F.col("_entry").alias("w"), F.expr(f"cast(array() as array<{out_row}>)").alias("rows"))
    return (
        blocks.drop("_map").join(entries, ["topology_id", "_block"])
        .select("topology_id", F.explode(F.aggregate(
            "_plans", begin,
            lambda acc, p: F.struct(
                step(acc["w"], p["demand"]).alias("w"),
                F.concat(acc["rows"], F.array(F.struct(
                    p["tick"].alias("tick"), p["moves"].alias("moves"), p["changes"].alias("changes"),
                    p["threads"].alias("threads"), acc["w"].alias("workers_before"),
                    step(acc["w"], p["demand"]).alias("workers_after"),
                ))).alias("rows"),
            ),
        )["rows"]).alias("_r"))
        .select("topology_id", "_r.*")
    )


def strict_hot_bolts(reach: DataFrame, metrics: DataFrame, limit: float = STRICT_CAPACITY) -> DataFrame:
    """The stricter rule without ranking: every reachable operator above the limit is
    raised once per tick."""
    return (
        reach_metrics(reach, metrics).filter(F.col("capacity") > limit)
        .dropDuplicates(["topology_id", "tick", "component_id"])
        .select("topology_id", "tick", "component_id", F.col("executors").alias("executors_before"),
                (F.col("executors") + 1).alias("executors_after"))
    )
