"""Queries on executor statistics and the flow check."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import flowcheck as fc
from flowgauge.operators import graph, rollup
from flowgauge.plans import adapters as ad
from flowgauge.plans import sql_views as v
from flowgauge.plans.registry import query, rounded, with_ctes
from flowgauge.session import cut_lineage, scratch_path
from flowgauge.sources import tables

CM = (v.STATS, v.METRICS)
CHECKS = (*CM, v.TARGETS, v.CHECKS)
LOOP = (*CHECKS, v.REACH, v.LOOP)
WORKERS = (*LOOP, v.WORKERS)


def _metrics(spark, sf):
    """The roll-up as a written table, for queries that read it more than once: the raw
    statistics are scanned a single time."""
    return cut_lineage(ad.metrics(spark, sf))


def _spouts(metrics):
    return metrics.filter("component_type = 'spout'")


def _reach(metrics):
    return graph.reachable_bolts(ad.pipeline_edges(metrics), ad.component_types(metrics))


def _flow(spark, sf) -> fc.FlowCheck:
    metrics = _metrics(spark, sf)
    return fc.flow_check(metrics, ad.targets(metrics), _reach(metrics))


def _checks(spark, sf):
    metrics = _metrics(spark, sf)
    return fc.spout_checks(_spouts(metrics), ad.targets(metrics))


# --- roll-up ---------------------------------------------------------------------------


def _scanned(spark, sf):
    """Executor statistics from a written table of statistics per stream."""
    path = scratch_path(spark, "streams")
    ad.stream_stats(spark, sf).write.parquet(path)
    return tables.stream_stats(spark, path)


@query("executor_stats_scan", with_ctes(v.STREAM_STATS, body="""
select topology_id, tick, component_id, component_type, executor_id, emitted, transferred, acked, failed,
       round(latency + 3.7e-10, 6) as latency_ms
from stats"""))
def executor_stats_scan(spark, sf):
    return rounded(
        _scanned(spark, sf).select(
            "topology_id", "tick", "component_id", "component_type", "executor_id", "emitted", "transferred",
            "acked", "failed", F.coalesce("complete_latency_ms", "process_latency_ms").alias("latency_ms")),
        "latency_ms")


@query("unknown_types", with_ctes(v.STREAM_STATS, body="""
select distinct topology_id, component_id, component_type from stats
where component_type is null or component_type not in ('spout', 'bolt')"""))
def unknown_types(spark, sf):
    return rollup.unknown_types(_scanned(spark, sf))


@query("spout_rollup", with_ctes(*CM, body="""
select topology_id, tick, component_id, executors, acked, failed, emitted, transferred,
       round(acked_rate + 3.7e-10, 6) as acked_rate, round(emit_rate + 3.7e-10, 6) as emit_rate,
       round(transfer_rate + 3.7e-10, 6) as transfer_rate, round(acked_latency + 3.7e-10, 6) as complete_latency
from cm where component_type = 'spout'"""))
def spout_rollup(spark, sf):
    out = rollup.spout_rollup(ad.executor_stats(spark, sf)).drop("tasks", "uptime_secs")
    return rounded(out, "acked_rate", "emit_rate", "transfer_rate", "complete_latency")


@query("bolt_rollup", with_ctes(*CM, body="""
select topology_id, tick, component_id, executors, acked, failed, emitted, transferred,
       round(acked_rate + 3.7e-10, 6) as acked_rate, round(emit_rate + 3.7e-10, 6) as emit_rate,
       round(transfer_rate + 3.7e-10, 6) as transfer_rate, executed, execute_rate,
       round(execute_rate_exact + 3.7e-10, 6) as execute_rate_exact, round(acked_latency + 3.7e-10, 6) as process_latency,
       round(execute_latency + 3.7e-10, 6) as execute_latency, round(capacity + 3.7e-10, 6) as capacity,
       round(max_capacity + 3.7e-10, 6) as max_capacity
from cm where component_type = 'bolt'"""))
def bolt_rollup(spark, sf):
    out = rollup.bolt_rollup(ad.executor_stats(spark, sf)).drop("tasks", "uptime_secs")
    return rounded(out, "acked_rate", "emit_rate", "transfer_rate", "execute_rate_exact",
                   "process_latency", "execute_latency", "capacity", "max_capacity")


@query("weighted_latency", with_ctes(*CM, body="""
select topology_id, tick, component_id,
       case when component_type = 'spout' then round(acked_latency + 3.7e-10, 6) end as complete_latency,
       case when component_type = 'bolt' then round(acked_latency + 3.7e-10, 6) end as process_latency,
       round(execute_latency + 3.7e-10, 6) as execute_latency
from cm"""))
def weighted_latency(spark, sf):
    columns = ("complete_latency", "process_latency", "execute_latency")
    return rounded(ad.metrics(spark, sf).select(*rollup.COMPONENT, *columns), *columns)


@query("capacity_stats", with_ctes(*CM, body="""
select topology_id, tick, component_id, executors, round(capacity + 3.7e-10, 6) as capacity,
       round(max_capacity + 3.7e-10, 6) as max_capacity
from cm where component_type = 'bolt'"""))
def capacity_stats(spark, sf):
    out = ad.metrics(spark, sf).filter("component_type = 'bolt'").select(
        *rollup.COMPONENT, "executors", "capacity", "max_capacity")
    return rounded(out, "capacity", "max_capacity")


@query("window_rates", with_ctes(*CM, body="""
select topology_id, tick, component_id, round(acked_rate + 3.7e-10, 6) as acked_rate, round(emit_rate + 3.7e-10, 6) as emit_rate,
       round(transfer_rate + 3.7e-10, 6) as transfer_rate, execute_rate, round(execute_rate_exact + 3.7e-10, 6) as execute_rate_exact
from cm"""))
def window_rates(spark, sf):
    rates = ("acked_rate", "emit_rate", "transfer_rate", "execute_rate_exact")
    return rounded(
        ad.metrics(spark, sf).select(*rollup.COMPONENT, *rates[:3], "execute_rate", rates[3]), *rates)


@query("thread_count", with_ctes(*CM, body="""
select topology_id, tick, cast(sum(executors) as bigint) as threads from cm group by topology_id, tick"""))
def thread_count(spark, sf):
    return rollup.thread_count(ad.metrics(spark, sf))


@query("carry_forward", with_ctes(*CM, body="""
, gaps as (
  select *, coalesce(lead(tick) over (partition by topology_id, component_id order by tick) - 21600,
                     max(tick) over (partition by topology_id)) as until
  from cm)
select topology_id, component_id, cast(poll as bigint) as tick, poll <> tick as stale, executors, acked,
       round(acked_rate + 3.7e-10, 6) as acked_rate, round(capacity + 3.7e-10, 6) as capacity
from (select *, unnest(generate_series(tick, until, 21600)) as poll from gaps)""".lstrip("\n")))
def carry_forward(spark, sf):
    filled = rollup.carry_forward(
        _metrics(spark, sf), ad.TICK_SECS, ["executors", "acked", "acked_rate", "capacity"])
    return rounded(filled, "acked_rate", "capacity")


@query("metric_poll_series", with_ctes(*CM, body="""
, ends as (select topology_id, max(tick) as last_tick from cm group by topology_id),
one as (
  select cm.*, min(tick) over (partition by topology_id) as first_tick,
         coalesce(lead(tick) over (partition by topology_id order by tick) - 21600, last_tick) as until
  from cm join ends using (topology_id) where component_id = 'spout-main'),
polls as (
  select topology_id, component_id, unnest(generate_series(tick, until, 21600)) as poll, tick as seen,
         first_tick, acked, acked_rate, acked_latency
  from one)
select topology_id, component_id, cast(poll as bigint) as tick, poll <> seen as stale, acked,
       round(acked_rate + 3.7e-10, 6) as acked_rate, round(acked_latency + 3.7e-10, 6) as complete_latency,
       cast((poll - first_tick) // 21600 as bigint) as poll_no
from polls where (poll - first_tick) // 21600 < 1000""".lstrip("\n")))
def metric_poll_series(spark, sf):
    polled = rollup.poll_series(
        _metrics(spark, sf), "spout-main", ad.TICK_SECS, ["acked", "acked_rate", "complete_latency"])
    return rounded(polled, "acked_rate", "complete_latency")


def _as_text(column):
    """SQL for a number as Spark prints it, below 0.001 in scientific notation."""
    x = f"round({column} + 3.7e-10, 6)"
    power = f"floor(log10({x}))"
    return (f"coalesce(case when {x} > 0 and {x} < 0.001 then cast(round({x} / pow(10, {power}), 5) as varchar) "
            f"|| 'E' || cast({power} as integer) else cast({x} as varchar) end, 'NaN')")


@query("metric_report", with_ctes(*CM, body=f"""
select topology_id, tick, component_id,
       concat_ws(chr(10), '-------------------------', component_id, 'uptime :0',
         'executors: ' || executors || ' / tasks: 0' || chr(10),
         'emitted: ' || emitted || ' / transferred: ' || transferred,
         'acked: ' || acked || ' / failed: ' || failed,
         case when component_type = 'spout' then
           concat_ws(chr(10), 'latency: ' || {_as_text("acked_latency")}, 'acked/sec :' || {_as_text("acked_rate")})
         else
           concat_ws(chr(10), 'executed: ' || executed || ' => capacity: ' || {_as_text("capacity")},
             'process latency: ' || {_as_text("acked_latency")}
               || ' / execute latency: ' || {_as_text("execute_latency")},
             'acked/sec :' || {_as_text("acked_rate")}, 'executed/sec :' || execute_rate) end,
         'emitted/sec :' || {_as_text("emit_rate")}, 'transferred/sec :' || {_as_text("transfer_rate")},
         '-------------------------') as report
from cm"""))
def metric_report(spark, sf):
    cols = ("acked_rate", "emit_rate", "transfer_rate", "complete_latency", "process_latency",
            "execute_latency", "capacity")
    return rollup.metric_report(rounded(ad.metrics(spark, sf), *cols))


# --- targets and checks ----------------------------------------------------------------


@query("spout_target_join", with_ctes(*CM, v.TARGETS, body="""
select s.topology_id, s.component_id, s.tick, round(s.acked_rate + 3.7e-10, 6) as acked_rate, t.target_rate
from cm s join targets t on t.topology_id = s.topology_id and t.component_id = s.component_id"""))
def spout_target_join(spark, sf):
    metrics = _metrics(spark, sf)
    joined = fc.spout_targets(_spouts(metrics), ad.targets(metrics))
    return rounded(joined.select(*fc.SPOUT_KEY, "tick", "acked_rate", "target_rate"), "acked_rate")


@query("below_target", with_ctes(*CM, v.TARGETS, body="""
select s.topology_id, s.component_id, s.tick, round(s.acked_rate + 3.7e-10, 6) as acked_rate, t.target_rate
from cm s join targets t on t.topology_id = s.topology_id and t.component_id = s.component_id
where t.target_rate > s.acked_rate"""))
def below_target(spark, sf):
    metrics = _metrics(spark, sf)
    below = fc.below_target(_spouts(metrics), ad.targets(metrics))
    return rounded(below.select(*fc.SPOUT_KEY, "tick", "acked_rate", "target_rate"), "acked_rate")


@query("hot_components", with_ctes(*CM, body="""
select topology_id, tick, component_id, executors, round(capacity + 3.7e-10, 6) as capacity from cm where capacity > 0.7"""))
def hot_components(spark, sf):
    hot = fc.hot_components(ad.metrics(spark, sf))
    return rounded(hot.select(*rollup.COMPONENT, "executors", "capacity"), "capacity")


@query("hot_components_strict", with_ctes(*CM, v.REACH, body="""
select distinct b.topology_id, b.tick, b.component_id, b.executors as executors_before,
       b.executors + 1 as executors_after
from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id
where b.capacity > 0.9"""))
def hot_components_strict(spark, sf):
    metrics = _metrics(spark, sf)
    return fc.strict_hot_bolts(_reach(metrics), metrics)


@query("prev_current_join", with_ctes(*CHECKS, body="""
select topology_id, component_id, tick, round(prev_acked_rate + 3.7e-10, 6) as prev_acked_rate,
       round(acked_rate + 3.7e-10, 6) as acked_rate, round(prev_complete_latency + 3.7e-10, 6) as prev_complete_latency,
       round(complete_latency + 3.7e-10, 6) as complete_latency
from paired"""))
def prev_current_join(spark, sf):
    paired = fc.with_previous(_spouts(_metrics(spark, sf))).select(
        *fc.SPOUT_KEY, "tick", "prev_acked_rate", "acked_rate", "prev_complete_latency", "complete_latency")
    return rounded(paired, *paired.columns[3:])


@query("throughput_delta", with_ctes(*CHECKS, body="""
select topology_id, component_id, tick,
       round((acked_rate - prev_acked_rate) / nullif(prev_acked_rate, 0) + 3.7e-10, 6) as rate_change
from paired"""))
def throughput_delta(spark, sf):
    paired = fc.with_previous(_spouts(_metrics(spark, sf)), ("acked_rate",))
    return rounded(paired.select(
        *fc.SPOUT_KEY, "tick",
        fc.relative_change(F.col("acked_rate"), F.col("prev_acked_rate")).alias("rate_change")), "rate_change")


@query("severity_delta", with_ctes(*CHECKS, body="""
select topology_id, component_id, tick, below, delta from checks"""))
def severity_delta(spark, sf):
    return _checks(spark, sf).select(*fc.SPOUT_KEY, "tick", "below", "delta")


@query("severity_clamp", with_ctes(*CHECKS, body="""
, summed as (select *, cast(sum(delta) over (partition by topology_id, component_id order by tick) as bigint) as c
             from checks)
select topology_id, component_id, tick, delta,
       c - least(0, min(c) over (partition by topology_id, component_id order by tick)) as severity_no_reset
from summed""".lstrip("\n")))
def severity_clamp(spark, sf):
    return fc.severity_without_reset(_checks(spark, sf)).select(*fc.SPOUT_KEY, "tick", "delta", "severity_no_reset")


# --- candidates ------------------------------------------------------------------------


@query("reachable_bolts", with_ctes(*CM, v.EDGES, body="""
, walk as (
  select topology_id, src as root, dst as component_id from edges
  where (topology_id, src) in (select topology_id, component_id from cm where component_type = 'spout')
  union
  select w.topology_id, w.root, e.dst from walk w
  join edges e on e.topology_id = w.topology_id and e.src = w.component_id)
select w.topology_id, w.root, w.component_id from walk w
where exists (select 1 from cm where cm.topology_id = w.topology_id and cm.component_id = w.component_id
              and cm.component_type = 'bolt')""".lstrip("\n"), recursive=True))
def reachable_bolts(spark, sf):
    return _reach(_metrics(spark, sf))


@query("reach_metrics_join", with_ctes(*CM, v.REACH, body="""
select r.topology_id, b.tick, r.root, b.component_id, b.executors, round(b.capacity + 3.7e-10, 6) as capacity
from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id"""))
def reach_metrics_join(spark, sf):
    metrics = _metrics(spark, sf)
    return rounded(fc.reach_metrics(_reach(metrics), metrics), "capacity")


RANKED = (*CM, v.REACH, """
ranked as (
  select r.topology_id, b.tick, r.root, b.component_id, b.executors, b.capacity,
         row_number() over (partition by r.topology_id, b.tick, r.root
                            order by b.capacity desc nulls last, b.component_id) as rank
  from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id)""")


@query("rank_bolts", with_ctes(*RANKED, body="""
select topology_id, tick, root, component_id, round(capacity + 3.7e-10, 6) as capacity, rank from ranked"""))
def rank_bolts(spark, sf):
    metrics = _metrics(spark, sf)
    ranked = fc.rank_bolts(fc.reach_metrics(_reach(metrics), metrics))
    return rounded(ranked.drop("executors"), "capacity")


@query("pick_bolts", with_ctes(*RANKED, body="""
select topology_id, tick, root, component_id, round(capacity + 3.7e-10, 6) as capacity, rank from ranked
where rank = 1 or capacity > 0.7"""))
def pick_bolts(spark, sf):
    metrics = _metrics(spark, sf)
    ranked = fc.rank_bolts(fc.reach_metrics(_reach(metrics), metrics))
    return rounded(fc.pick_bolts(ranked).drop("executors"), "capacity")


# --- the whole check -------------------------------------------------------------------


@query("severity_trigger", with_ctes(*LOOP, recursive=True, body="""
select topology_id, tick, 'spout-main' as root from loop where planned"""))
def severity_trigger(spark, sf):
    return _flow(spark, sf).triggers()


PLAN_BODY = "select topology_id, tick, component_id, executors_before, executors_after from plan"


@query("executor_plan", with_ctes(*LOOP, recursive=True, body=PLAN_BODY))
def executor_plan(spark, sf):
    return _flow(spark, sf).executor_plan()


# Both sources ask for the operators they share; each of those is raised once.
@query("planned_anti", with_ctes(v.TWO_SOURCE_STATS, v.METRICS, v.TWO_SOURCE_TARGETS, v.CHECKS, v.TWO_SOURCE_PLAN,
                                 recursive=True, body="""
select topology_id, tick, component_id, cast(count(distinct component_id) as bigint) as raised from plan group by all"""))
def planned_anti(spark, sf):
    metrics = cut_lineage(ad.two_source_metrics(spark, sf))
    edges = ad.pipeline_edges(metrics, ad.PIPELINE_EDGES + ad.SIDE_EDGES)
    reach = graph.reachable_bolts(edges, ad.component_types(metrics))
    flow = fc.flow_check(metrics, ad.two_source_targets(metrics), reach)
    return flow.executor_plan().groupBy(*rollup.COMPONENT).agg(F.count(F.lit(1)).alias("raised"))


@query("plan_counts", with_ctes(*WORKERS, recursive=True, body="""
select topology_id, tick, changes, moves from demand"""))
def plan_counts(spark, sf):
    return _flow(spark, sf).plan_counts()


@query("worker_plan", with_ctes(*WORKERS, recursive=True, body="""
select topology_id, tick, moves, changes, threads, workers_before, workers_after from workers"""))
def worker_plan(spark, sf):
    return _flow(spark, sf).worker_plan()


@query("plan_commit", with_ctes(*WORKERS, recursive=True, body="""
select p.topology_id, p.tick,
       string_agg(p.component_id || '=' || p.executors_after, ',' order by p.component_id) as num_executors,
       max(case when w.workers_after > w.workers_before then w.workers_after end) as num_workers,
       cast(0 as bigint) as wait_secs
from plan p join workers w on w.topology_id = p.topology_id and w.tick = p.tick
group by p.topology_id, p.tick"""))
def plan_commit(spark, sf):
    entries = F.array_sort(F.map_entries("num_executors"))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return _flow(spark, sf).commits().select(
        "topology_id", "tick", F.array_join(text, ",").alias("num_executors"), "num_workers", "wait_secs")


@query("flow_check_loop", with_ctes(*WORKERS, recursive=True, body="""
select p.topology_id, p.tick, w.moves, p.component_id, p.executors_before, p.executors_after,
       w.workers_before, w.workers_after
from plan p join workers w on w.topology_id = p.topology_id and w.tick = p.tick"""))
def flow_check_loop(spark, sf):
    flow = _flow(spark, sf)
    workers = flow.worker_plan().select("topology_id", "tick", "moves", "workers_before", "workers_after")
    return flow.executor_plan().join(workers, ["topology_id", "tick"])


@query("rebalance_cooldown", with_ctes(*LOOP, recursive=True, body="""
select k.topology_id, k.tick, k.ordinal,
       coalesce(l.state, case when k.ordinal = 1 then 'baseline' else 'check' end) as state
from ticks k left join loop l on l.topology_id = k.topology_id and l.tick = k.tick"""))
def rebalance_cooldown(spark, sf):
    return _flow(spark, sf).cooldown()


@query("flow_audit", with_ctes(*LOOP, recursive=True, body="""
select c.topology_id, c.component_id, c.tick, c.target_rate, round(c.acked_rate + 3.7e-10, 6) as acked_rate, c.below,
       round((c.acked_rate - c.prev_acked_rate) / nullif(c.prev_acked_rate, 0) + 3.7e-10, 6) as rate_change,
       l.old_severity as severity_before, l.severity, l.planned
from checks c join loop l on l.topology_id = c.topology_id and l.tick = c.tick"""))
def flow_audit(spark, sf):
    audit = _flow(spark, sf).audit().select(
        *fc.SPOUT_KEY, "tick", "target_rate", "acked_rate", "below", "rate_change", "severity_before",
        "severity", "planned")
    return rounded(audit, "acked_rate", "rate_change")
