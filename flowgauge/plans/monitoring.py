"""Queries on metric samples, the load score and the scaling rules.

The samples lie far apart in the test tables, so the windows here are hours and days where
a live system would use seconds and minutes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import scaling as sc
from flowgauge.operators import series as se
from flowgauge.plans import adapters as ad
from flowgauge.plans import sql_views as v
from flowgauge.plans.registry import query, rounded, with_ctes
from flowgauge.session import scratch_path
from flowgauge.sources import tables

STEP, FINE_STEP, WINDOW = 6 * 3600, 3600, 86400
LATENCY_SOURCE, HOST = "x-split-2", "split-1"


def _coarse(spark, sf) -> se.Grid:
    """Steps over all the time that the table covers."""
    return se.grid_over(ad.events(spark, sf), STEP, WINDOW)


def _fine(spark, sf) -> se.Grid:
    return se.grid_over(ad.events(spark, sf), FINE_STEP, WINDOW)


def _steps(step: int) -> str:
    return f"""steps as (
  select unnest(generate_series(
    cast(low // {step * 1_000_000} * {step} as bigint), cast((high + {step * 1_000_000 - 1}) // {step * 1_000_000} * {step} as bigint), {step})) as step
  from (select epoch_us(min(ts)) as low, epoch_us(max(ts)) as high from events))"""


STEPS, FINE_STEPS = _steps(STEP), _steps(FINE_STEP)

IN_WINDOW = f"s.us between (g.step - {WINDOW}) * 1000000 and g.step * 1000000"


@query("samples_scan", with_ctes(v.SAMPLES, body="""
select metric, name, us, value from samples"""))
def samples_scan(spark, sf):
    path = scratch_path(spark, "samples")
    tables.write_samples(ad.samples(spark, sf), path)
    name = F.coalesce(*[F.col("labels")[k] for k in ("BoltId", "SpoutId", "ClusterHost", "pod")])
    return tables.samples(spark, path).select(
        "metric", name.alias("name"), F.unix_micros("ts").alias("us"), "value")


@query("label_eq", with_ctes(v.SAMPLES, body=f"""
select 'ClusterHost=' || name as series, us, value from samples
where metric = 'worker_cluster_used' and name = '{HOST}'"""))
def label_eq(spark, sf):
    return se.select_series(ad.samples(spark, sf), "worker_cluster_used", {"ClusterHost": HOST}).drop("metric", "ts")


@query("label_regex", with_ctes(v.SAMPLES, body="""
select 'BoltId=' || name as series, us, value from samples
where metric = 'bolts_capacity' and regexp_full_match(name, '^split-.*')"""))
def label_regex(spark, sf):
    return se.select_series(
        ad.samples(spark, sf), "bolts_capacity", matches={"BoltId": "^split-.*"}).drop("metric", "ts")


AVERAGES = """
averages as (
  select s.name, g.step, avg(s.value) as value
  from steps g join samples s on {window}
  where s.metric = '{metric}' and {where}
  group by all)"""
SPLITS = AVERAGES.format(window=IN_WINDOW, metric="bolts_capacity", where="s.name like 'split-%'")


@query("avg_over_time", with_ctes(v.SAMPLES, STEPS, SPLITS, body="""
select 'BoltId=' || name as series, cast(step as bigint) as step, value from averages"""))
def avg_over_time(spark, sf):
    chosen = se.select_series(ad.samples(spark, sf), "bolts_capacity", matches={"BoltId": "^split-.*"})
    return se.avg_over_time(chosen, _coarse(spark, sf))


@query("avg_of_avg", with_ctes(v.SAMPLES, STEPS, SPLITS, body="""
select cast(step as bigint) as step, round(avg(value) + 3.7e-10, 6) as value from averages group by step"""))
def avg_of_avg(spark, sf):
    chosen = se.select_series(ad.samples(spark, sf), "bolts_capacity", matches={"BoltId": "^split-.*"})
    return rounded(se.avg_by(se.avg_over_time(chosen, _coarse(spark, sf))), "value")


@query("first_series", with_ctes(v.SAMPLES, STEPS, AVERAGES.format(
    window=IN_WINDOW, metric="spouts_complete_latency", where="true"), body="""
select cast(step as bigint) as step, 'SpoutId=' || min(name) as series, arg_min(value, name) as value
from averages group by step"""))
def first_series(spark, sf):
    chosen = se.select_series(ad.samples(spark, sf), "spouts_complete_latency")
    return se.first_series(se.avg_over_time(chosen, _coarse(spark, sf)))


INSTANT = f"""
latest as (
  select s.metric, s.name, g.step, arg_max(s.value, s.us) as value
  from steps g join samples s on {IN_WINDOW}
  group by all)"""


@query("sum_by_pod", with_ctes(v.SAMPLES, STEPS, INSTANT, body="""
select name as pod, cast(step as bigint) as step, round(sum(value) + 3.7e-10, 6) as value from latest
where metric = 'pod_memory_working_set_bytes' group by all"""))
def sum_by_pod(spark, sf):
    chosen = se.select_series(
        ad.samples(spark, sf), "pod_memory_working_set_bytes", {"namespace": ad.NAMESPACE}, by=("pod",))
    return rounded(se.sum_by(se.instant_vector(chosen, _coarse(spark, sf), ("pod", "series")), "pod"), "value")


def _rates(steps):
    return (v.SAMPLES, steps, f"""
pairs as (
  select s.name, g.step, s.us, s.value,
         lag(s.value) over (partition by s.name, g.step order by s.us, s.value) as before
  from steps g join samples s on {IN_WINDOW}
  where s.metric = 'pod_cpu_usage_seconds_total'),
rates as (
  select name, step,
         sum(case when before is null then 0.0 when value < before then value else value - before end)
           / ((max(us) - min(us)) / 1000000.0) as value
  from pairs group by all having max(us) > min(us))""")


@query("counter_rate", with_ctes(*_rates(STEPS), body=f"""
select 'namespace={ad.NAMESPACE},pod=' || name as series, cast(step as bigint) as step, value from rates"""))
def counter_rate(spark, sf):
    chosen = se.select_series(ad.samples(spark, sf), "pod_cpu_usage_seconds_total")
    return se.counter_rate(chosen, _coarse(spark, sf))


@query("range_query", with_ctes(*_rates(FINE_STEPS), body="""
select name as pod, cast(step as bigint) as step, round(sum(value) + 3.7e-10, 6) as value from rates group by all"""))
def range_query(spark, sf):
    chosen = se.select_series(
        ad.samples(spark, sf), "pod_cpu_usage_seconds_total", {"namespace": ad.NAMESPACE}, by=("pod",))
    return rounded(se.sum_by(se.counter_rate(chosen, _fine(spark, sf), ("pod", "series")), "pod"), "value")


# --- score -----------------------------------------------------------------------------

UTILIZATION = """
utilization as (
  select name as host, step,
         max(case when metric = 'worker_cluster_used' then value end) as used,
         max(case when metric = 'worker_cluster_total' then value end) as total
  from latest where metric in ('worker_cluster_used', 'worker_cluster_total') group by all)"""


@query("ratio_join", with_ctes(v.SAMPLES, STEPS, INSTANT, UTILIZATION, body="""
select host, cast(step as bigint) as step, used, total, coalesce(used / nullif(total, 0), 0.0) as worker_used
from utilization"""))
def ratio_join(spark, sf):
    return sc.worker_utilization(ad.samples(spark, sf), _coarse(spark, sf)).drop("failed")


@query("worker_utilization", with_ctes(v.SAMPLES, STEPS, INSTANT, UTILIZATION, body=f"""
select host, cast(step as bigint) as step, coalesce(used / nullif(total, 0), 0.0) as worker_used
from utilization where host = '{HOST}'"""))
def worker_utilization(spark, sf):
    return sc.worker_utilization(ad.samples(spark, sf), _coarse(spark, sf), HOST).select("host", "step", "worker_used")


def _score_ctes(steps):
    return (v.SAMPLES, steps, INSTANT, UTILIZATION, SPLITS, f"""
capacity as (select step, avg(value) as value from averages group by step),
latency as (
  select g.step, avg(s.value) as value from steps g join samples s on {IN_WINDOW}
  where s.metric = 'spouts_complete_latency' and s.name = '{LATENCY_SOURCE}' group by g.step),
inputs as (
  select h.host, cast(g.step as bigint) as step, u.used,
         case when u.total = 0 and u.used is not null then 0.0 else coalesce(u.used / nullif(u.total, 0), 0.0) end as worker_used,
         case when u.total = 0 and u.used is not null then 0.0 else coalesce(c.value, 0.0) end as bolt_capacity,
         case when u.total = 0 and u.used is not null then 0.0 else coalesce(l.value, 0.0) end as spout_latency
  from (select distinct host from utilization) h cross join steps g
  left join utilization u on u.host = h.host and u.step = g.step
  left join capacity c on c.step = g.step left join latency l on l.step = g.step),
scored as (
  select *, round(0.6 * worker_used / 0.7 + 0.2 * bolt_capacity / 0.5 + 0.2 * spout_latency / 100, 9) as score
  from inputs)""")


def _inputs(spark, sf, grid):
    return sc.score_inputs(ad.samples(spark, sf), grid, LATENCY_SOURCE)


def _scored(spark, sf, grid):
    return sc.load_score(_inputs(spark, sf, grid))


@query("score_fallback", with_ctes(*_score_ctes(FINE_STEPS), body="""
select host, step, worker_used, round(bolt_capacity + 3.7e-10, 6) as bolt_capacity, spout_latency from inputs"""))
def score_fallback(spark, sf):
    return rounded(_inputs(spark, sf, _fine(spark, sf)).drop("used"), "bolt_capacity")


@query("load_score", with_ctes(*_score_ctes(STEPS), body="select host, step, round(score + 3.7e-10, 6) as score from scored"))
def load_score(spark, sf):
    return rounded(_scored(spark, sf, _coarse(spark, sf)).select("host", "step", "score"), "score")


@query("score_parts", with_ctes(*_score_ctes(STEPS), body="""
select host, step, 'worker_used' as item, round(0.6 * worker_used / 0.7 + 3.7e-10, 6) as part from inputs union all
select host, step, 'bolt_capacity', round(0.2 * bolt_capacity / 0.5 + 3.7e-10, 6) from inputs union all
select host, step, 'spout_latency', round(0.2 * spout_latency / 100 + 3.7e-10, 6) from inputs"""))
def score_parts(spark, sf):
    return rounded(sc.score_parts(_inputs(spark, sf, _coarse(spark, sf))), "part")


@query("is_active", with_ctes(*_score_ctes(STEPS), body="select host, step, score > 0.7 as is_active from scored"))
def is_active(spark, sf):
    return sc.is_active(_scored(spark, sf, _coarse(spark, sf))).select("host", "step", "is_active")


@query("score_report", with_ctes(*_score_ctes(STEPS), body="""
select host, step, 'custom_metric' as metric_name, round(score + 3.7e-10, 6) as metric_value from scored union all
select host, step, 'worker_used', round(worker_used + 3.7e-10, 6) from scored union all
select host, step, 'bolt_capacity', round(bolt_capacity + 3.7e-10, 6) from scored union all
select host, step, 'spout_latency', round(spout_latency + 3.7e-10, 6) from scored"""))
def score_report(spark, sf):
    return rounded(sc.score_report_rows(sc.score_report(_scored(spark, sf, _coarse(spark, sf)))), "metric_value")


@query("score_snapshots", with_ctes(*_score_ctes(FINE_STEPS), body="""
select host, step, round(score + 3.7e-10, 6) as score,
       round(first_value(score) over (partition by host, step // 21600 order by step) + 3.7e-10, 6) as served_score
from scored"""))
def score_snapshots(spark, sf):
    held = sc.score_snapshots(_scored(spark, sf, _fine(spark, sf)), hold=21600)
    return rounded(held.select("host", "step", "score", "served_score"), "score", "served_score")


# --- replicas --------------------------------------------------------------------------

SPAN = PERIOD = 6 * 3600
COOLDOWN = 86400
RECOMMENDED = """
recommended as (
  select host, step, score, current,
         cast(least(greatest(ceil(current * score / 0.75), 1), 7) as bigint) as desired
  from (select *, cast(least(greatest(floor(coalesce(used, 0)), 1), 7) as bigint) as current from scored))"""
STABILIZED = f"""
stabilized as (
  select *, min(desired) over w as scale_up_to, max(desired) over w as scale_down_to
  from recommended
  window w as (partition by host order by step range between {SPAN} preceding and current row))"""
LIMITED = f"""
numbered as (select *, row_number() over (partition by host order by step) as n from stabilized),
limited as (
  select host, step, n,
         cast(current + case when scale_up_to > current then 1 when scale_down_to < current then -1 else 0 end
              as bigint) as replicas,
         case when scale_up_to > current then step end as last_up,
         case when scale_up_to <= current and scale_down_to < current then step end as last_down
  from numbered where n = 1
  union all
  select x.host, x.step, x.n,
         cast(l.replicas + case
           when x.scale_up_to > l.replicas and (l.last_up is null or x.step - l.last_up >= {PERIOD}) then 1
           when x.scale_down_to < l.replicas and (l.last_down is null or x.step - l.last_down >= {PERIOD}) then -1
           else 0 end as bigint),
         case when x.scale_up_to > l.replicas and (l.last_up is null or x.step - l.last_up >= {PERIOD}) then x.step
              else l.last_up end,
         case when x.scale_up_to > l.replicas and (l.last_up is null or x.step - l.last_up >= {PERIOD}) then l.last_down
              when x.scale_down_to < l.replicas and (l.last_down is null or x.step - l.last_down >= {PERIOD}) then x.step
              else l.last_down end
  from limited l join numbered x on x.host = l.host and x.n = l.n + 1)"""


def _recommended(spark, sf):
    used = F.floor(F.coalesce("used", F.lit(0.0)))
    current = F.least(F.greatest(used, F.lit(1)), F.lit(7)).cast("bigint")
    return sc.replica_target(_scored(spark, sf, _fine(spark, sf)), current)


@query("replica_target", with_ctes(*_score_ctes(FINE_STEPS), RECOMMENDED, body="""
select host, step, round(score + 3.7e-10, 6) as score, current, desired from recommended"""))
def replica_target(spark, sf):
    return rounded(_recommended(spark, sf).select("host", "step", "score", "current", "desired"), "score")


@query("initial_cooldown", with_ctes(*_score_ctes(FINE_STEPS), RECOMMENDED, body=f"""
select host, step, desired
from (select *, min(step) over (partition by host) as first_step from recommended) where step >= first_step + {COOLDOWN}"""))
def initial_cooldown(spark, sf):
    return sc.after_cooldown(_recommended(spark, sf), COOLDOWN).select("host", "step", "desired")


@query("replica_stabilized", with_ctes(*_score_ctes(FINE_STEPS), RECOMMENDED, STABILIZED, body="""
select host, step, desired, scale_up_to, scale_down_to from stabilized"""))
def replica_stabilized(spark, sf):
    return sc.replica_stabilized(_recommended(spark, sf), SPAN).select(
        "host", "step", "desired", "scale_up_to", "scale_down_to")


@query("replica_rate_limit", with_ctes(*_score_ctes(FINE_STEPS), RECOMMENDED, STABILIZED, LIMITED,
                                       recursive=True, body="select host, step, replicas from limited"))
def replica_rate_limit(spark, sf):
    stabilized = sc.replica_stabilized(_recommended(spark, sf), SPAN)
    return sc.replica_rate_limit(stabilized, PERIOD).select("host", "step", "replicas")


@query("backlog_replicas", """
with steps as (
  select user_id % 10 as queue, cast(epoch_us(ts) as bigint) as ts_us, event_id,
         case when event_type in ('view', 'click') then 1 when event_type in ('error', 'signup') then -1 else 0 end as delta
  from events),
summed as (select *, sum(delta) over (partition by queue order by ts_us, event_id) as c from steps),
counted as (select *, cast(c - least(0, min(c) over (partition by queue order by ts_us, event_id)) as bigint) as backlog
            from summed)
select queue, ts_us, event_id, backlog,
       cast(least(greatest(ceil(backlog / 5), 1), 10) as bigint) as replicas
from counted""")
def backlog_replicas(spark, sf):
    return sc.backlog_replicas(ad.queue_steps(spark, sf)).select(
        "queue", "ts_us", "event_id", "backlog", "replicas")
