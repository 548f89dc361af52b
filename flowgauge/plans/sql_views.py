"""The adapter views once more as SQL text, the common ground of the oracle queries."""

COMPONENT = """
case when user_id % 10 = 9 then 'spout-main'
     when user_id % 10 < 3 then 'split-' || (user_id % 3 + 1)
     when user_id % 10 < 6 then 'avg-' || (user_id % 3 + 1)
     else 'sum-' || (user_id % 3 + 1) end
"""



def stats_of(component: str) -> str:
    return f"""
stats as (
  select 't' || ((user_id // 10) % 3) as topology_id,
         cast(floor(epoch(ts) / 21600) * 21600 as bigint) as tick,
         {component} as component_id,
         user_id // 10 as executor_id,
         count(*) as emitted,
         count(*) filter (where event_type <> 'view') as transferred,
         count(*) filter (where event_type <> 'error') as acked,
         count(*) filter (where event_type = 'error') as failed,
         cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
  from events group by all)
"""


STATS = stats_of(COMPONENT)
# The same with a second source in each topology; one topology has no target for it.
TWO_SOURCE_STATS = stats_of(f"case when user_id % 10 = 8 then 'spout-side' else {COMPONENT} end")

METRICS = """
cm as (
  select topology_id, tick, component_id,
         case when component_id like 'spout-%' then 'spout' else 'bolt' end as component_type,
         count(*) as executors,
         cast(sum(acked) as bigint) as acked, cast(sum(failed) as bigint) as failed,
         cast(sum(emitted) as bigint) as emitted, cast(sum(transferred) as bigint) as transferred,
         cast(sum(acked) as double) / 600 as acked_rate,
         cast(sum(emitted) as double) / 600 as emit_rate,
         cast(sum(transferred) as double) / 600 as transfer_rate,
         case when component_id not like 'spout-%' then cast(sum(emitted) as bigint) end as executed,
         case when component_id not like 'spout-%' then cast(floor(sum(emitted) / 600) as double) end as execute_rate,
         case when component_id not like 'spout-%' then cast(sum(emitted) as double) / 600 end as execute_rate_exact,
         round(sum(cast(cents as double) / emitted / 100.0 * acked) / nullif(sum(acked), 0), 9) as acked_latency,
         case when component_id not like 'spout-%'
              then round(sum(cast(cents as double) / emitted / 100.0 * emitted) / nullif(sum(emitted), 0), 9) end
           as execute_latency,
         case when component_id not like 'spout-%' then round(sum(cents / 10000.0) / count(*), 9) end as capacity,
         case when component_id not like 'spout-%' then greatest(max(cents / 10000.0), 0.0) end as max_capacity
  from stats group by topology_id, tick, component_id)
"""

EDGES = """
edge_list(edge_no, src, dst) as (values
  (1, 'spout-main', 'split-1'), (2, 'spout-main', 'split-2'), (3, 'spout-main', 'split-3'),
  (4, 'split-1', 'avg-1'), (5, 'split-2', 'avg-2'), (6, 'split-3', 'avg-3'),
  (7, 'avg-1', 'sum-1'), (8, 'avg-2', 'sum-2'), (9, 'avg-3', 'sum-3'), (10, 'split-1', 'avg-2')),
edges as (select topology_id, cast(edge_no as bigint) as edge_no, src, dst
          from (select distinct topology_id from stats), edge_list)
"""

TARGETS = """
targets as (
  select topology_id, component_id,
         round(cast(sum(acked) as double) / 600.0 / count(*) * 1.1, 6) as target_rate
  from cm where component_type = 'spout' group by all
  union all
  select distinct topology_id, 'spout-trigger', 4000.0 from cm)
"""

TWO_SOURCE_TARGETS = """
targets as (
  select topology_id, component_id,
         round(cast(sum(acked) as double) / 600.0 / count(*) * 1.1, 6) as target_rate
  from cm where component_type = 'spout' and not (topology_id = 't2' and component_id = 'spout-side') group by all
  union all
  select distinct topology_id, 'spout-trigger', 4000.0 from cm)
"""

# In the graph above every operator lies below the one source.
REACH = """
reach as (
  select distinct c.topology_id, 'spout-main' as root, c.component_id
  from cm c join cm s on s.topology_id = c.topology_id and s.component_type = 'spout'
  where c.component_type = 'bolt')
"""

CHECKS = """
paired as (
  select s.topology_id, s.component_id, s.tick, s.acked_rate, s.acked_latency as complete_latency, t.target_rate,
         lag(s.acked_rate) over w as prev_acked_rate, lag(s.acked_latency) over w as prev_complete_latency
  from cm s join targets t on t.topology_id = s.topology_id and t.component_id = s.component_id
  where s.component_type = 'spout'
  window w as (partition by s.topology_id, s.component_id order by s.tick)),
checks as (
  select *, target_rate > acked_rate as below,
         cast(case
           when not (target_rate > acked_rate) or prev_acked_rate is null then 0
           when acked_rate > prev_acked_rate then
             case when prev_acked_rate = 0 or (acked_rate - prev_acked_rate) / prev_acked_rate > 0.01 then -1
                  when prev_complete_latency > complete_latency then 0 else 1 end
           else
             case when prev_acked_rate <> 0 and (prev_acked_rate - acked_rate) / prev_acked_rate > 0.02
                  then 1 else 0 end
             + case when complete_latency > prev_complete_latency
                     and (prev_complete_latency = 0
                          or (complete_latency - prev_complete_latency) / prev_complete_latency > 1)
                    then 1 else 0 end
         end as bigint) as delta
  from paired)
"""

# One source per topology here, so one severity; `phase` 1 marks the tick after a plan.
LOOP = """
ticks as (select topology_id, tick, row_number() over (partition by topology_id order by tick) as ordinal
          from (select distinct topology_id, tick from cm)),
steps as (
  select k.topology_id, k.tick, k.ordinal, coalesce(c.delta, 0) as delta, coalesce(c.below, false) as below,
         exists (select 1 from cm b where b.topology_id = k.topology_id and b.tick = k.tick
                 and b.component_type = 'bolt') as has_bolts
  from ticks k join (select distinct topology_id from checks) using (topology_id)
  left join checks c on c.topology_id = k.topology_id and c.tick = k.tick),
loop as (
  select topology_id, tick, ordinal, cast(0 as bigint) as old_severity, cast(0 as bigint) as severity,
         false as planned, 'baseline' as state
  from steps where ordinal = 1
  union all
  select n.topology_id, n.tick, n.ordinal,
         case when l.planned then 0 else l.severity end,
         case when l.planned then 0 else greatest(l.severity + n.delta, 0) end,
         not l.planned and n.below and n.has_bolts and greatest(l.severity + n.delta, 0) >= 2,
         case when l.planned then 'baseline'
              when n.below and n.has_bolts and greatest(l.severity + n.delta, 0) >= 2 then 'plan'
              else 'check' end
  from loop l join steps n on n.topology_id = l.topology_id and n.ordinal = l.ordinal + 1),
ranked as (
  select r.topology_id, b.tick, r.root, b.component_id, b.executors, b.capacity,
         row_number() over (partition by r.topology_id, b.tick, r.root
                            order by b.capacity desc nulls last, b.component_id) as rank
  from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id),
plan as (
  select k.topology_id, k.tick, k.component_id, k.executors as executors_before,
         k.executors + 1 as executors_after
  from ranked k join loop l on l.topology_id = k.topology_id and l.tick = k.tick and l.planned
  where k.rank = 1 or k.capacity > 0.7)
"""

# Two sources, each with a severity of its own; a plan of either resets both. The second one's
# operators are a part of the first one's, so both may ask for the same operator at once.
TWO_SOURCE_PLAN = """
reach as (
  select distinct c.topology_id, s.component_id as root, c.component_id
  from cm c join cm s on s.topology_id = c.topology_id and s.component_type = 'spout'
  where c.component_type = 'bolt' and (s.component_id = 'spout-main' or c.component_id like '%-2' or c.component_id like '%-3')),
ticks as (select topology_id, tick, row_number() over (partition by topology_id order by tick) as ordinal
          from (select distinct topology_id, tick from cm)),
live as (
  select distinct r.topology_id, b.tick, r.root
  from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id),
asks as (
  select c.topology_id, c.tick, c.component_id as root, c.delta, c.below and l.root is not null as may
  from checks c left join live l on l.topology_id = c.topology_id and l.tick = c.tick and l.root = c.component_id),
steps as (
  select k.topology_id, k.tick, k.ordinal, coalesce(m.delta, 0) as delta_m, coalesce(m.may, false) as may_m,
         coalesce(s.delta, 0) as delta_s, coalesce(s.may, false) as may_s
  from ticks k join (select distinct topology_id from checks) using (topology_id)
  left join asks m on m.topology_id = k.topology_id and m.tick = k.tick and m.root = 'spout-main'
  left join asks s on s.topology_id = k.topology_id and s.tick = k.tick and s.root = 'spout-side'),
loop as (
  select topology_id, tick, ordinal, cast(0 as bigint) as main, cast(0 as bigint) as side,
         false as main_asks, false as side_asks
  from steps where ordinal = 1
  union all
  select n.topology_id, n.tick, n.ordinal,
         case when l.main_asks or l.side_asks then 0 else greatest(l.main + n.delta_m, 0) end,
         case when l.main_asks or l.side_asks then 0 else greatest(l.side + n.delta_s, 0) end,
         not (l.main_asks or l.side_asks) and n.may_m and l.main + n.delta_m >= 2,
         not (l.main_asks or l.side_asks) and n.may_s and l.side + n.delta_s >= 2
  from loop l join steps n on n.topology_id = l.topology_id and n.ordinal = l.ordinal + 1),
asked as (
  select topology_id, tick, 'spout-main' as root from loop where main_asks
  union all select topology_id, tick, 'spout-side' from loop where side_asks),
ranked as (
  select r.topology_id, b.tick, r.root, b.component_id, b.capacity,
         row_number() over (partition by r.topology_id, b.tick, r.root
                            order by b.capacity desc nulls last, b.component_id) as rank
  from reach r join cm b on b.topology_id = r.topology_id and b.component_id = r.component_id),
plan as (
  select k.topology_id, k.tick, k.root, k.component_id
  from ranked k join asked a on a.topology_id = k.topology_id and a.tick = k.tick and a.root = k.root
  where k.rank = 1 or k.capacity > 0.7)
"""

WORKERS = """
demand as (
  select p.topology_id, p.tick, count(*) as changes,
         (select cast(sum(executors) as bigint) from cm c
          where c.topology_id = p.topology_id and c.tick = p.tick) as threads,
         row_number() over (partition by p.topology_id order by p.tick) as moves
  from plan p group by p.topology_id, p.tick),
workers as (
  select topology_id, tick, moves, changes, threads, cast(2 as bigint) as workers_before,
         cast(case when (threads + changes) // 4 > 2 then 3 else 2 end as bigint) as workers_after
  from demand where moves = 1
  union all
  select d.topology_id, d.tick, d.moves, d.changes, d.threads, w.workers_after,
         w.workers_after + case when w.workers_after < 28
           and (d.threads + d.changes) // (2 * w.workers_after) > 2 then 1 else 0 end
  from workers w join demand d on d.topology_id = w.topology_id and d.moves = w.moves + 1)
"""

# Statistics per stream, without the runtime's own streams and components, put together by executor.
STREAM_STATS = f"""
streams as (
  select 't' || ((user_id // 10) % 3) as topology_id,
         cast(floor(epoch(ts) / 21600) * 21600 as bigint) as tick,
         case when user_id % 70 = 7 then '__acker' when user_id % 70 = 17 then 'sink-' || (user_id % 2)
              else {COMPONENT} end as component_id,
         user_id // 10 as executor_id,
         case event_type when 'signup' then '__metrics' when 'error' then 'errors' when 'purchase' then 'orders'
              else 'default' end as stream_id,
         count(*) as emitted,
         count(*) filter (where event_type <> 'view') as transferred,
         count(*) filter (where event_type <> 'error') as acked,
         count(*) filter (where event_type = 'error') as failed,
         cast(cast(sum(cast(round(value * 100) as bigint)) as bigint) as double) / count(*) / 100.0 as latency
  from events group by all),
stats as (
  select topology_id, tick, component_id,
         case when component_id like 'spout-%' then 'spout' when component_id = 'sink-1' then 'sink'
              when component_id <> 'sink-0' then 'bolt' end as component_type,
         executor_id, cast(sum(emitted) as bigint) as emitted, cast(sum(transferred) as bigint) as transferred,
         cast(sum(acked) as bigint) as acked, cast(sum(failed) as bigint) as failed,
         sum(latency * acked) / nullif(sum(acked), 0) as latency
  from streams where not starts_with(stream_id, '__') and not starts_with(component_id, '__') group by all)
"""

SAMPLES = """
samples as (
  select case event_type when 'view' then 'bolts_capacity' when 'click' then 'spouts_complete_latency'
              when 'error' then 'worker_cluster_used' when 'signup' then 'pod_memory_working_set_bytes'
              else 'pod_cpu_usage_seconds_total' end as metric,
         case when user_id % 3 = 0 then 'split-' else 'x-split-' end || (user_id % 5 + 1) as name,
         cast(epoch_us(ts) as bigint) as us,
         case event_type when 'view' then floor(cast(round(value * 100) as bigint) * 1024 / 10000) / 1024.0
              when 'error' then floor(value / 50.0)
              else floor(cast(round(value * 100) as bigint) * 64 / 100) / 64.0 end as value
  from events
  union all
  select 'worker_cluster_total',
         case when user_id % 3 = 0 then 'split-' else 'x-split-' end || (user_id % 5 + 1),
         cast(epoch_us(ts) as bigint),
         case when extract(hour from ts) = 3 then 0.0 else 28.0 end
  from events where event_type = 'error')
"""

READINGS = """
readings as (
  select event_id as id, cast(floor(epoch(ts) / 3600) * 3600 as bigint) as ts_s, value,
         cast(1 as bigint) as property, user_id % 4 as plug_id, (user_id // 4) % 3 as household_id,
         user_id % 5 as house_id
  from events)
"""

ORDER_GRAPH = """
edges as (
  select o_orderkey as edge_no, 'c' || o_custkey as src, 'o' || o_orderkey as dst from orders
  union all
  select distinct l_partkey, 'o' || l_orderkey, 'p' || l_partkey from lineitem
  union all
  select l_partkey, 'p' || l_partkey, 's' || min(l_suppkey) from lineitem group by l_partkey)
"""
