"""Dataflow graphs as edge tables ``(topology_id, edge_no, src, dst)``.

Walks are loops over a frontier table: one equi-join with the edges per level, written to
the shared folder each round, so the number of rounds is the depth of the graph and no
plan grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.operators.ordered import AUTO, MAX_GROUP_ROWS, chunk_width, ordered_scan, running_count, running_sum
from flowgauge.session import cut_lineage, dealt

NODE = ["topology_id", "component_id"]
#: The same for joins and windows. A sort compares the first bytes of its first column, and topologies are few.
BY_NODE = ["component_id", "topology_id"]
#: Ways of fewer than 2 ** SHORT_WAYS steps are walked level by level.
SHORT_WAYS = 3
#: So many levels are walked before the ways are looked at.
FIRST_LEVELS = 4


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct components named by the edges; one pass over the edge table."""
    return edges.select(
        "topology_id", F.explode(F.array("src", "dst")).alias("component_id")
    ).distinct()


def typed_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Endpoints with the type their metrics report; null type when unknown.

    The type comes from the metrics side, never from the shape of the graph.
    """
    return endpoints(edges).join(
        components.select(*NODE, "component_type"), NODE, "left"
    )


def adjacency(
    edges: DataFrame, block: int = 1000, width: int | str | None = AUTO, grain: int = 100_000
) -> DataFrame:
    """Neighbours of each node in edge order, duplicates kept.

    A list is stored in blocks of ``block`` neighbours, so that a node with a large share
    of all edges gives many rows and not one unbounded array.
    """
    edges = cut_lineage(edges)
    rows, keys = edges.count(), ["src", "topology_id"]
    if width == AUTO:
        width = chunk_width(edges, keys, "edge_no", grain)
    if width is None:
        edges = dealt(edges, rows, *keys)
    numbered = ordered_scan(edges, keys, ["edge_no"], {"_rank": running_count()}, width=width).withColumn(
        "block_no", F.floor((F.col("_rank") - 1) / block))
    if width is not None:
        numbered = dealt(numbered, rows, *keys, "block_no")
    return (
        numbered.groupBy(*keys, "block_no")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "dst"))).alias("_list"))
        .select(
            "topology_id", F.col("src").alias("component_id"), "block_no",
            F.col("_list")["dst"].alias("neighbors"),
        )
    )


def _outgoing(edges: DataFrame, *extra: str) -> DataFrame:
    """Edges keyed like a frontier: the component they leave and the one they enter."""
    return edges.select(
        "topology_id", F.col("src").alias("component_id"), F.col("dst").alias("_dst"), *extra
    )


def _levels(edges: DataFrame, roots: DataFrame, named: bool = False) -> list[DataFrame]:
    """The paths below each root, a table per length. ``named`` rows have an ``_id`` within their level, the id
    of the path they extend in ``_up``, and the last edge. ``_between`` are the components on a path between its ends."""
    steps = cut_lineage(_outgoing(edges, "edge_no"), "zstd")
    name = [F.monotonically_increasing_id().alias("_id")] if named else []
    none = F.lit(None).cast("bigint")
    frontier = cut_lineage(
        roots.select(
            "topology_id", F.col("component_id").alias("root"), "component_id",
            F.lit(0).cast("bigint").alias("depth"),
            F.expr("cast(array() as array<bigint>)").alias("path"),
            F.array().cast("array<string>").alias("_between"), *name, *([none.alias("_up"), none.alias("_edge")] if named else []),
        )
    )
    new = (F.col("_dst") != F.col("root")) & (F.col("_dst") != F.col("component_id")) & ~F.array_contains("_between", F.col("_dst"))
    levels = [frontier]
    while True:
        between = F.col("_between") if len(levels) == 1 else F.concat("_between", F.array("component_id"))
        frontier = cut_lineage(
            frontier.join(steps, BY_NODE).filter(new).select(
                "topology_id", "root", F.col("_dst").alias("component_id"),
                F.lit(len(levels)).cast("bigint").alias("depth"),
                F.concat("path", F.array("edge_no")).alias("path"),
                between.alias("_between"), *name,
                *([F.col("_id").alias("_up"), F.col("edge_no").alias("_edge")] if named else []),
            ), "zstd"
        )
        if frontier.isEmpty():
            return levels
        levels.append(frontier)
        if not _leads_on(frontier, steps):
            return levels


def _together(levels: list[DataFrame]) -> DataFrame:
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result.drop("_between", "_id", "_up", "_edge")


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per path below each root (topology_id, root, component_id, depth, path).

    ``path`` holds the edge numbers taken. An edge back to a component of the same path is not
    taken, so the walk ends on cycles too; ``cycle_nodes`` reports those.
    """
    return _together(_levels(edges, roots))


def reachable_paths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """A node once per path from the root to it, the root itself left out."""
    return walk(edges, roots).filter("depth > 0")


def pre_order(edges: DataFrame, roots: DataFrame, width: int | str | None = AUTO) -> DataFrame:
    """Components in the order a depth-first listing prints them, with their position.

    While every root has few paths they are sorted: array comparison puts a path right before its
    extensions. Otherwise no task sees all paths of a root. The size of a path's subtree comes from
    the sizes of the level below, and a path stands behind the one it extends and the subtrees of the
    siblings before it. ``width`` None always sorts, a number never does.
    """
    levels = _levels(edges, roots, named=True)
    if width == AUTO:
        most = _together(levels).groupBy("topology_id", "root").count().agg(F.max("count")).first()[0]
        width = None if (most or 0) <= MAX_GROUP_ROWS else AUTO
    if width is None:
        return ordered_scan(_together(levels), ["root", "topology_id"], ["path"], {"position": running_count()}, width=None)
    sized: list[DataFrame] = []
    for level in reversed(levels):
        size = F.lit(1).cast("bigint")
        if sized:
            held = sized[-1].groupBy(F.col("_up").alias("_id")).agg(F.sum("_size").alias("_held"))
            level, size = level.join(held, "_id", "left"), size + F.coalesce("_held", F.lit(0))
        sized.append(cut_lineage(level.withColumn("_size", size).drop("_held", "_between")))
    placed = [sized.pop().withColumn("position", F.lit(1).cast("bigint"))]
    while sized:
        numbered = ordered_scan(sized.pop(), ["_up"], ["_edge", "component_id"], {"_upto": running_sum(F.col("_size"))},
                                width=width, grain=1)
        above = placed[-1].select(F.col("_id").alias("_up"), F.col("position").alias("_at"))
        placed.append(cut_lineage(numbered.join(above, "_up").withColumn(
            "position", F.col("_at") + 1 + F.col("_upto") - F.col("_size")).drop("_at", "_upto")))
    return _together([level.drop("_size") for level in placed])


def _only_way(steps: DataFrame) -> DataFrame:
    """(topology_id, component_id, _dst) of the nodes that one distinct edge leaves."""
    single = steps.groupBy(*BY_NODE).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    return steps.join(single, BY_NODE, "left_semi").select(*NODE, "_dst")


def _jumps(way: DataFrame) -> list[DataFrame]:
    """Tables of jumps of 1, 2, 4, ... steps along the only way, as long as any node has one. Each
    joins the one before with itself, so a chain of n nodes takes log2(n) rounds. A jump within a
    ring goes on for ever; the longest chain without a ring bounds the rounds."""
    bound, tables = way.count(), [way]
    while 2 ** len(tables) <= bound:
        last = tables[-1]
        far = last.select("topology_id", F.col("component_id").alias("_dst"), F.col("_dst").alias("_far"))
        longer = cut_lineage(last.join(far, ["_dst", "topology_id"]).select(*NODE, F.col("_far").alias("_dst")))
        if longer.isEmpty():
            break
        tables.append(longer)
    return tables


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (topology_id, root, component_id) below each root; safe on cycles.

    The first FIRST_LEVELS levels are walked one by one, which ends most graphs. In deeper ones
    nodes that one edge leaves lead one way only, and whole such ways are crossed by jumps that double
    in length. A frontier is walked over the other nodes alone, so its rounds are the
    branchings on a path and not its edges; the nodes on the ways are filled in at the end, by the
    same jumps.
    """
    steps = cut_lineage(_outgoing(edges))
    if _repeats(steps):
        steps = cut_lineage(steps.distinct())
    frontier = roots.select(
        "topology_id", F.col("component_id").alias("root"), F.col("component_id")
    ).distinct()
    seen, entered, names = _by_levels(steps, None, frontier, [], FIRST_LEVELS)
    if entered is None:
        return seen
    steps = cut_lineage(steps.distinct())
    tables = _jumps(cut_lineage(_only_way(steps)))
    if len(tables) <= SHORT_WAYS:  # nothing is gained by crossing ways of a few steps
        return _by_levels(steps, seen, entered, names, None)[0]
    found = ["topology_id", "root", "component_id"]
    forks = cut_lineage(steps.join(tables[0].select(*NODE), BY_NODE, "left_anti"))
    while True:
        ends = cut_lineage(_ends(entered, tables))  # where the ways of the nodes just met lead
        met = ends.join(forks, BY_NODE).select("topology_id", "root", F.col("_dst").alias("component_id")).distinct()
        entered = cut_lineage(met.join(seen, found, "left_anti"))
        if entered.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(entered))
    for table in tables:  # all nodes up to 2 ** k steps on, then twice as many
        further = seen.join(table, BY_NODE).select("topology_id", "root", F.col("_dst").alias("component_id"))
        seen = cut_lineage(seen.unionByName(further).distinct())
    return seen


def _by_levels(
    steps: DataFrame, seen: DataFrame | None, frontier: DataFrame, names: list[DataFrame], rounds: int | None
) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """The same pairs level by level, for at most ``rounds`` levels: the pairs seen, the frontier if
    it leads on, and the components of each level.

    The frontier holds only pairs not seen before, so every pair is expanded once. Pairs are
    compared with those seen only where a component of the level stands on an earlier one as well.
    """
    while rounds is None or rounds > 0:
        found = cut_lineage(
            frontier.join(steps, BY_NODE)
            .select("topology_id", "root", F.col("_dst").alias("component_id"))
            .distinct()
        )
        here = cut_lineage(found.select(*NODE).distinct())
        if any(not here.join(there, BY_NODE, "left_semi").isEmpty() for there in names):
            found = cut_lineage(found.join(seen, ["component_id", "root", "topology_id"], "left_anti"))
        if seen is not None and found.isEmpty():
            return seen, None, names
        seen = found if seen is None else seen.unionByName(found)
        names = [*names, here]
        if not _leads_on(here, steps):
            return seen, None, names
        frontier, rounds = found, rounds if rounds is None else rounds - 1
    return seen, frontier, names


def _repeats(steps: DataFrame) -> bool:
    """Whether so many edges stand more than once that it pays to drop them; pairs are distinct either way."""
    rows, kinds = steps.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*NODE, "_dst"))).first()
    return rows > 1.25 * kinds


def _leads_on(components: DataFrame, steps: DataFrame) -> bool:
    """Whether a step leaves one of ``components``. A few of them mostly show it; if not, all are looked up."""
    few = F.broadcast(components.select(*NODE).limit(1000).distinct())
    if not steps.join(few, BY_NODE, "left_semi").isEmpty():
        return True
    names = cut_lineage(components.select(*NODE).distinct())
    return not steps.join(names, BY_NODE, "left_semi").isEmpty()


def _ends(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``rows`` with each component replaced by the end of its only way. The longest jumps come first:
    a node that has one of 2 ** k steps takes it, and what is left of its way is shorter. On a ring there is no
    end and any node of it will do."""
    for table in reversed(tables):
        rows = rows.join(table, BY_NODE, "left").select(
            "topology_id", "root", F.coalesce("_dst", "component_id").alias("component_id"))
    return rows.distinct()


def reachable_bolts(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Operators below each source. A source met on the way is walked through but is no
    candidate itself."""
    typed = components.select(*NODE, "component_type")
    sources = typed.filter("component_type = 'spout'")
    bolts = typed.filter("component_type = 'bolt'").select(*NODE)
    return reachable(edges, sources).join(bolts, NODE, "left_semi")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves.

    The graph is shrunk first: nodes without incoming or outgoing edges go, and nodes with one of each
    are taken out of their chain, which becomes one edge. Chains are followed by doubling pointers and
    either step alone leaves little to the other, so a long path, a long ring or a tree takes logarithmic
    rounds. What neither shrinks further is split by coloring: each node takes the largest name that
    reaches it, and walking back from that name within its color gives its strongly connected group.
    Groups are removed and the rest is tried again. Then the chains are put back, the last first: their
    nodes lie on a cycle if both ends are in the same group. Tables stay as large as the edge list; no
    closure is built.
    """
    key = ["topology_id"]
    live = cut_lineage(edges.select("topology_id", "src", "dst").distinct())
    loops = live.filter("src = dst").select("topology_id", F.col("src").alias("component_id"))
    live = cut_lineage(live.filter("src <> dst"))
    groups, chains, before = [], [], -1
    while True:
        live, size = _rake(live)
        if not size:
            break
        if size != before:  # else both steps left the graph as it is
            live, chain, rings = _compress(live)
            if chain is not None:
                chains.append(chain)
                # Two rings share no edge, so one name does for those of a round.
                groups.append(rings.withColumn("label", F.lit(f"ring {len(chains)}")))
                before = live.count()
                continue
        members = cut_lineage(_strong_groups(live))
        groups.append(members.filter("size > 1").select(*NODE, F.concat(F.lit("group "), "color").alias("label")))
        gone = members.select(*NODE)
        for side in ("src", "dst"):
            live = live.join(gone.withColumnRenamed("component_id", side), [*key, side], "left_anti")
        live, before = cut_lineage(live), -1
    labels = None
    for group in groups:
        labels = group if labels is None else labels.unionByName(group)
    for chain in reversed(chains):
        labels = cut_lineage(_put_back(labels, chain))
    found = loops if labels is None else loops.unionByName(labels.select(*NODE))
    return found.distinct()


def _rake(live: DataFrame) -> tuple[DataFrame, int]:
    """Without edges that no cycle can hold, as long as each pass takes away a quarter; with the count."""
    before = live.count()
    while before:
        live = cut_lineage(_trim_once(_trim_once(live)))
        after = live.count()
        if 4 * after > 3 * before:
            return live, after
        before = after
    return live, before


def _compress(live: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The graph with every chain of nodes with one incoming and one outgoing edge as a single edge;
    (NODE, tail, head) of the nodes taken out, the nodes before and after their chain; and the nodes of rings
    of nothing but such nodes. No chain, no tables.

    A node's pointer leads 2 ** k steps on, or to the last node of its chain. In each round the pointers of
    a chain reach its end from twice as far, so when a round closes none, only rings are still open.
    """
    ends = live.select("topology_id", F.col("src").alias("component_id"), F.col("dst").alias("_next"),
                       F.lit(None).cast("string").alias("_last")).unionByName(
        live.select("topology_id", F.col("dst").alias("component_id"), F.lit(None).cast("string").alias("_next"),
                    F.col("src").alias("_last")))
    inner = cut_lineage(ends.groupBy(*NODE).agg(
        F.min("_next").alias("_next"), F.min("_last").alias("_last"), F.count("_next").alias("_out"),
        F.count("_last").alias("_in")).filter("_out = 1 and _in = 1").drop("_out", "_in"))
    if inner.isEmpty():
        return live, None, None
    after = inner.select("topology_id", F.col("component_id").alias("_next"), F.lit(True).alias("_open"))
    jumps = cut_lineage(inner.join(after, ["topology_id", "_next"], "left").select(
        *NODE, F.when(F.col("_open"), F.col("_next")).otherwise(F.col("component_id")).alias("_at"),
        F.coalesce("_open", F.lit(False)).alias("_open")))
    closed, rest = jumps.filter("not _open"), jumps.filter("_open")
    still = rest.count()
    while still:
        far = jumps.select("topology_id", F.col("component_id").alias("_at"), F.col("_at").alias("_far"), F.col("_open").alias("_on"))
        rest = rest.join(far, ["topology_id", "_at"]).select(
            *NODE, F.col("_far").alias("_at"), F.col("_on").alias("_open"))
        jumps = cut_lineage(closed.unionByName(rest))
        closed, rest = jumps.filter("not _open"), jumps.filter("_open")
        left = rest.count()
        if left == still:
            break
        still = left
    # A chain is named by its last node, which knows the head; its first one knows the tail.
    of_chain = closed.select(*NODE, F.col("_at").alias("_chain")).join(inner, NODE)
    is_inner = inner.select("topology_id", F.col("component_id").alias("_last"))
    tails = of_chain.join(is_inner, ["topology_id", "_last"], "left_anti").select(
        "topology_id", "_chain", F.col("_last").alias("tail"))
    heads = of_chain.filter("component_id = _chain").select("topology_id", "_chain", F.col("_next").alias("head"))
    between = cut_lineage(tails.join(heads, ["topology_id", "_chain"]))
    chain = cut_lineage(of_chain.select(*NODE, "_chain").join(between, ["topology_id", "_chain"]).drop("_chain"))
    for side in ("src", "dst"):
        live = live.join(inner.select("topology_id", F.col("component_id").alias(side)), ["topology_id", side], "left_anti")
    short = between.filter("tail <> head").select("topology_id", F.col("tail").alias("src"), F.col("head").alias("dst"))
    return cut_lineage(live.unionByName(short).distinct()), chain, rest.select(*NODE)


def _put_back(labels: DataFrame, chain: DataFrame) -> DataFrame:
    """``labels`` (NODE, label) with those of the nodes of ``chain``: the label that both ends have. A chain
    that ends where it begins is a cycle; its end is one too and takes its own name if it has no label."""
    own = chain.filter("tail = head").select("topology_id", F.col("tail").alias("component_id")).distinct()
    labels = labels.unionByName(own.join(labels, NODE, "left_anti").withColumn("label", F.concat(F.lit("self "), "component_id")))
    at = lambda side: labels.select("topology_id", F.col("component_id").alias(side), F.col("label").alias(f"_{side}"))
    inside = chain.join(at("tail"), ["topology_id", "tail"]).join(at("head"), ["topology_id", "head"]).filter("_tail = _head")
    return labels.unionByName(inside.select(*NODE, F.col("_tail").alias("label")))


def _trim_once(live: DataFrame) -> DataFrame:
    """Edges that start where an edge ends and end where an edge starts."""
    entered = live.select("topology_id", F.col("dst").alias("src")).distinct()
    left = live.select("topology_id", F.col("src").alias("dst")).distinct()
    return live.join(entered, ["topology_id", "src"], "left_semi").join(
        left, ["topology_id", "dst"], "left_semi"
    )


def _push_colors(live: DataFrame, colors: DataFrame) -> DataFrame:
    """Largest color among a node and the nodes before it; ``_own`` stays the node's."""
    pushed = live.join(
        colors.select("topology_id", F.col("component_id").alias("src"), "color"), ["topology_id", "src"]
    ).select("topology_id", F.col("dst").alias("component_id"), "color")
    return (
        colors.unionByName(pushed, allowMissingColumns=True).groupBy(*NODE)
        .agg(F.max("color").alias("color"), F.max("_own").alias("_own"))
    )


def _strong_groups(live: DataFrame) -> DataFrame:
    """The strongly connected group around each color's name, with its size."""
    colors = endpoints(live).withColumn("color", F.col("component_id"))
    while True:
        grown = cut_lineage(_push_colors(live, _push_colors(live, colors.withColumn("_own", F.col("color")))))
        colors = grown.drop("_own")
        if grown.filter("color <> _own").isEmpty():
            break
    inside = cut_lineage(
        live.join(colors.withColumnRenamed("component_id", "src").withColumnRenamed("color", "_cs"),
                  ["topology_id", "src"])
        .join(colors.withColumnRenamed("component_id", "dst").withColumnRenamed("color", "_cd"),
              ["topology_id", "dst"])
        .filter("_cs = _cd")
        .select("topology_id", F.col("_cs").alias("color"), "src", "dst")
    )
    frontier = colors.filter("component_id = color")
    seen = frontier
    while True:
        back = inside.join(
            frontier.withColumnRenamed("component_id", "dst"), ["topology_id", "color", "dst"]
        ).select("topology_id", F.col("src").alias("component_id"), "color").distinct()
        frontier = cut_lineage(back.join(seen, [*NODE, "color"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    sizes = seen.groupBy("topology_id", "color").agg(F.count(F.lit(1)).alias("size"))
    return seen.join(sizes, ["topology_id", "color"])
