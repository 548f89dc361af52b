"""Queries on definitions and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import flowcheck as fc
from flowgauge.operators import graph
from flowgauge.plans import adapters as ad
from flowgauge.plans import sql_views as v
from flowgauge.plans.registry import query, with_ctes
from flowgauge.plans.telemetry import CM, _metrics
from flowgauge.session import cut_lineage, scratch_path
from flowgauge.sources import topology
from flowgauge.sources.lines import by_folder, read_lines, write_files

# Definition files as text lines: one file per block of orders, its first line the name,
# then an edge "order part" per line item. Some lines are broken the way real ones are.
LINES = """
lines as (
  select 'file-' || (l_orderkey // 512) as file, cast(1 as bigint) as line_no,
         'topology-' || (l_orderkey // 512) as line
  from lineitem group by l_orderkey // 512
  union all
  select file, 1 + row_number() over (partition by file order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice),
         case when l_partkey % 11 = 0 then ' o' || l_orderkey || ' p' || l_partkey
              when l_partkey % 11 = 1 then 'o' || l_orderkey || '  p' || l_partkey
              when l_partkey % 11 = 2 then 'o' || l_orderkey || ' p' || l_partkey || ' x'
              when l_partkey % 11 = 3 then 'o' || l_orderkey || 'p' || l_partkey
              when l_partkey % 11 = 4 then 'o' || l_orderkey || ' p' || l_partkey || ' '
              when l_partkey % 11 = 5 and l_linenumber = 1 then ''
              when l_partkey % 11 = 5 and l_linenumber = 2 then ' '
              else 'o' || l_orderkey || ' p' || l_partkey end
  from (select 'file-' || (l_orderkey // 512) as file, * from lineitem))
"""


def _through_files(spark, lines, *how):
    """``lines`` written as text files and read back with the numbers that the reader gives them."""
    path = scratch_path(spark, "definitions")
    write_files(lines, path, *how)
    return by_folder(read_lines(spark, path))


def _definition_lines(spark, sf):
    items = ad.table(spark, sf, "lineitem")
    block = F.floor(F.col("l_orderkey") / 512).cast("string")
    file = F.concat(F.lit("file-"), block)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    src = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    dst = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    case, odd = F.col("l_partkey") % 11, F.col("l_linenumber")
    line = (
        F.when(case == 0, F.concat(F.lit(" "), src, F.lit(" "), dst))
        .when(case == 1, F.concat(src, F.lit("  "), dst))
        .when(case == 2, F.concat(src, F.lit(" "), dst, F.lit(" x")))
        .when(case == 3, F.concat(src, dst))
        .when(case == 4, F.concat(src, F.lit(" "), dst, F.lit(" ")))
        .when((case == 5) & (odd == 1), "").when((case == 5) & (odd == 2), " ")
        .otherwise(F.concat(src, F.lit(" "), dst))
    )
    body = items.select(file.alias("file"), *order, line.alias("line"))
    # A file's first line has no item and stands before the lines that have one.
    heads = items.select(block.alias("_block")).distinct().select(
        F.concat(F.lit("file-"), F.col("_block")).alias("file"), F.concat(F.lit("topology-"), F.col("_block")).alias("line"))
    return _through_files(spark, heads.unionByName(body, allowMissingColumns=True), order, items.count())


@query("edges_ingest", with_ctes(LINES, body="""
, parts as (select file, line_no, line, string_split(rtrim(line, ' '), ' ') as p from lines where line_no > 1)
select h.line as topology_id, p.line_no - 1 as edge_no, p.p[1] as src, p.p[2] as dst
from parts p join lines h on h.file = p.file and h.line_no = 1
where contains(p.line, ' ') and len(p.p) = 2""".lstrip("\n")))
def edges_ingest(spark, sf):
    return topology.edges(_definition_lines(spark, sf))


@query("edges_reject", with_ctes(LINES, body="""
, parts as (select file, line_no, line, string_split(rtrim(line, ' '), ' ') as p from lines where line_no > 1)
select file, line_no, line, case when not contains(line, ' ') then 'no space' else 'not two parts' end as reason
from parts where not contains(line, ' ') or len(p) <> 2""".lstrip("\n")))
def edges_reject(spark, sf):
    return topology.edge_rejects(_definition_lines(spark, sf))


TARGET_LINES = """
lines as (
  select 'targets-' || (o_custkey // 64) as file,
         row_number() over (partition by o_custkey // 64 order by o_orderkey) as line_no,
         case when o_orderkey % 13 = 0 then 'c' || o_custkey || ' none'
              when o_orderkey % 13 = 1 then 'c' || o_custkey || ' ' || o_totalprice || ' extra'
              when o_orderkey % 13 = 2 then 'c' || o_custkey
              else 'c' || o_custkey || ' ' || o_totalprice end as line
  from orders)
"""


@query("targets_ingest", with_ctes(TARGET_LINES, body="""
, parsed as (
  select file, line_no, string_split(line, ' ')[1] as component_id,
         try_cast(string_split(line, ' ')[2] as double) as target_rate
  from lines where contains(line, ' '))
select file, component_id, arg_max(target_rate, line_no) as target_rate
from parsed where target_rate is not null group by file, component_id""".lstrip("\n")))
def targets_ingest(spark, sf):
    orders = ad.table(spark, sf, "orders")
    who = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    price, case = F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.col("o_orderkey") % 13
    line = (
        F.when(case == 0, F.concat(who, F.lit(" none")))
        .when(case == 1, F.concat(who, F.lit(" "), price, F.lit(" extra")))
        .when(case == 2, who).otherwise(F.concat(who, F.lit(" "), price))
    )
    file = F.concat(F.lit("targets-"), F.floor(F.col("o_custkey") / 64).cast("string"))
    lines = orders.select(file.alias("file"), F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return topology.targets(_through_files(spark, lines))


@query("component_typing", with_ctes(*CM, v.EDGES, body="""
, ends as (select topology_id, src as component_id from edges union select topology_id, dst from edges)
select e.topology_id, e.component_id, max(c.component_type) as component_type
from ends e left join cm c on c.topology_id = e.topology_id and c.component_id = e.component_id
group by all""".lstrip("\n")))
def component_typing(spark, sf):
    metrics = _metrics(spark, sf)
    return graph.typed_components(ad.pipeline_edges(metrics), ad.component_types(metrics))


# Every order opens a topology named after its customer; the latest one counts.
@query("topology_lookup", """
select 'customer-' || c_custkey as name, 'run-' || max(o_orderkey) as topology_id
from customer join orders on o_custkey = c_custkey group by c_custkey""")
def topology_lookup(spark, sf):
    wanted = ad.table(spark, sf, "customer").select(
        F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("name"))
    runs = ad.table(spark, sf, "orders").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("name"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("topology_id"),
        F.col("o_orderkey").alias("seq"))
    return topology.lookup(wanted, runs)


@query("adjacency", with_ctes(v.ORDER_GRAPH, body="""
select src as component_id, cast(0 as bigint) as block_no, string_agg(dst, ',' order by edge_no) as neighbors,
       count(*) as n
from edges group by src"""))
def adjacency(spark, sf):
    lists = graph.adjacency(ad.order_graph(spark, sf))
    return lists.select("component_id", "block_no", F.array_join("neighbors", ",").alias("neighbors"),
                        F.size("neighbors").cast("bigint").alias("n"))


WALK = """
walk as (
  select distinct src as root, src as component_id, cast(0 as bigint) as depth, cast([] as bigint[]) as path
  from edges where src like 'c%'
  union all
  select w.root, e.dst, w.depth + 1, list_append(w.path, e.edge_no)
  from walk w join edges e on e.src = w.component_id)
"""


@query("reachable_paths", with_ctes(v.ORDER_GRAPH, WALK, recursive=True, body="""
select root, component_id, depth, array_to_string(path, '/') as path from walk where depth > 0"""))
def reachable_paths(spark, sf):
    edges = ad.order_graph(spark, sf)
    paths = graph.reachable_paths(edges, ad.customers_as_roots(spark, sf))
    return paths.select("root", "component_id", "depth",
                        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("reachable_components", with_ctes(v.ORDER_GRAPH, """
reach as (
  select src as root, dst as component_id from edges where src like 'c%'
  union
  select r.root, e.dst from reach r join edges e on e.src = r.component_id)""", recursive=True, body="""
select root, component_id from reach"""))
def reachable_components(spark, sf):
    edges = ad.order_graph(spark, sf)
    return graph.reachable(edges, ad.customers_as_roots(spark, sf)).drop("topology_id")


@query("pre_order_tree", with_ctes(v.ORDER_GRAPH, WALK, recursive=True, body="""
select root, component_id, depth, row_number() over (partition by root order by path) as position from walk"""))
def pre_order_tree(spark, sf):
    edges = ad.order_graph(spark, sf)
    return graph.pre_order(edges, ad.customers_as_roots(spark, sf)).select(
        "root", "component_id", "depth", "position")


@query("cycle_check", """
with recursive edges as (
  select 't' || ((o_custkey // 16) % 3) as topology_id, cast(o_custkey as varchar) as src,
         cast((o_custkey // 16) * 16 + min(o_orderkey) % 16 as varchar) as dst
  from orders group by o_custkey),
reach as (
  select topology_id, src as root, dst as component_id from edges
  union
  select r.topology_id, r.root, e.dst from reach r
  join edges e on e.topology_id = r.topology_id and e.src = r.component_id)
select topology_id, component_id from reach where root = component_id""")
def cycle_check(spark, sf):
    return graph.cycle_nodes(ad.ring_graph(spark, sf))


@query("spout_target_reject", with_ctes(v.TWO_SOURCE_STATS, v.METRICS, v.TWO_SOURCE_TARGETS, body="""
select distinct topology_id, component_id from cm
where component_type = 'spout' and (topology_id, component_id) not in (select topology_id, component_id from targets)"""))
def spout_target_reject(spark, sf):
    metrics = cut_lineage(ad.two_source_metrics(spark, sf))
    return fc.spouts_without_target(metrics.filter("component_type = 'spout'"), ad.two_source_targets(metrics))
