import random

import pytest

from flowgauge.operators import graph

EDGES = "topology_id string, edge_no bigint, src string, dst string"


def reach_of(edges, start):
    out, todo = set(), [start]
    while todo:
        node = todo.pop()
        for _, _, s, d in edges:
            if s == node and d not in out:
                out.add(d)
                todo.append(d)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(t, i, f"{rng.randint(0, 14):02}", f"{rng.randint(0, 14):02}") for t in ("x", "y") for i in range(16)]
    got = {tuple(r) for r in graph.cycle_nodes(spark.createDataFrame(edges, EDGES)).collect()}
    want = {(t, n) for t in ("x", "y") for n in {e[2] for e in edges if e[0] == t}
            if n in reach_of([e for e in edges if e[0] == t], n)}
    assert got == want


def _brute_cycles(edges):
    return {(t, n) for t in {e[0] for e in edges} for n in {e[2] for e in edges if e[0] == t}
            if n in reach_of([e for e in edges if e[0] == t], n)}


def test_cycles_through_chains(spark):
    """Random graphs whose edges are chains of nodes, all in one table."""
    rng, edges = random.Random(7), []
    for t in range(40):
        for i in range(rng.randint(2, 9)):
            a, b = rng.randint(0, 4), rng.randint(0, 4)
            stops = [f"n{a}", *[f"c{i}-{k}" for k in range(rng.choice([0, 0, 1, 2, 5, 9]))], f"n{b}"]
            edges += [(f"t{t}", i, u, v) for u, v in zip(stops, stops[1:])]
    got = [tuple(r) for r in graph.cycle_nodes(spark.createDataFrame(edges, EDGES)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_cycles(edges)


def test_cycles_on_long_chains_take_few_rounds(spark, monkeypatch):
    """A path, a ring, and a path with a leaf at every node, of 3,000 nodes each."""
    n, written = 3000, []
    edges = [("path", i, f"{i:05}", f"{i + 1:05}") for i in range(n)]
    edges += [("ring", i, f"{i:05}", f"{(i + 1) % n:05}") for i in range(n)]
    edges += [(t, i, f"{i:05}", f"{i + 1:05}") for t in ("rake",) for i in range(n)]
    edges += [("rake", i, f"{i:05}", f"leaf{i:05}") for i in range(n)]
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut(df))
    got = graph.cycle_nodes(spark.createDataFrame(edges, EDGES)).groupBy("topology_id").count().collect()
    assert [tuple(r) for r in got] == [("ring", n)] and len(written) < 60


def test_no_edges_no_cycles(spark):
    assert graph.cycle_nodes(spark.createDataFrame([], EDGES)).count() == 0
    loop = spark.createDataFrame([("t", 1, "a", "a"), ("t", 2, "a", "b")], EDGES)
    assert [tuple(r) for r in graph.cycle_nodes(loop).collect()] == [("t", "a")]


def test_two_rings_joined_by_a_path(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "n"), ("n", "c"), ("c", "d"), ("d", "c"), ("q", "q")]
    edges = spark.createDataFrame([("t", i, s, d) for i, (s, d) in enumerate(pairs)], EDGES)
    assert sorted(r.component_id for r in graph.cycle_nodes(edges).collect()) == ["a", "b", "c", "d", "q"]


DIAMOND = [("r", "x"), ("r", "y"), ("x", "z"), ("y", "z"), ("z", "w"), ("r", "x")]


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame([("t", i, s, d) for i, (s, d) in enumerate(DIAMOND)], EDGES)


@pytest.fixture(scope="module")
def root(spark):
    return spark.createDataFrame([("t", "r")], "topology_id string, component_id string")


def test_one_row_per_path(diamond, root):
    names = sorted(r.component_id for r in graph.reachable_paths(diamond, root).collect())
    assert names == ["w", "w", "w", "x", "x", "y", "z", "z", "z"]
    assert sorted(r.component_id for r in graph.reachable(diamond, root).collect()) == ["w", "x", "y", "z"]


@pytest.mark.parametrize("width", [None, 1])
def test_pre_order(diamond, root, width):
    rows = graph.pre_order(diamond, root, width=width).orderBy("position").collect()
    assert [r.component_id for r in rows] == ["r", "x", "z", "w", "y", "z", "w", "x", "z", "w"]
    assert [r.position for r in rows] == list(range(1, 11))


def test_pre_order_of_random_graphs(spark):
    """Sorted and by sizes of subtrees, beside a plain listing; several roots, a cycle, a wide node."""
    rng = random.Random(5)
    edges = [("t", i, f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for i in range(18)]
    edges += [("t", 100 + i, "n0", f"leaf{i}") for i in range(40)] + [("u", 1, "n0", "n1"), ("u", 2, "n1", "n0")]

    def listing(t, root):
        out = []

        def visit(node, met):
            out.append(node)
            for _, _, _, d in sorted(e for e in edges if e[0] == t and e[2] == node):
                if d not in met:
                    visit(d, met | {d})

        visit(root, {root})
        return out

    roots = [("t", "n0"), ("t", "n3"), ("u", "n0"), ("u", "gone")]
    df = spark.createDataFrame(edges, EDGES)
    tops = spark.createDataFrame(roots, "topology_id string, component_id string")
    for width in (None, 3, "auto"):
        rows = graph.pre_order(df, tops, width=width).collect()
        for t, root in roots:
            own = sorted((r.position, r.component_id) for r in rows if (r.topology_id, r.root) == (t, root))
            assert own == list(enumerate(listing(t, root), 1))


def test_reach_survives_a_cycle(spark, root):
    edges = spark.createDataFrame([("t", 1, "r", "a"), ("t", 2, "a", "b"), ("t", 3, "b", "a")], EDGES)
    assert sorted(r.component_id for r in graph.reachable(edges, root).collect()) == ["a", "b"]


def test_sources_below_a_source_are_no_candidates(spark):
    edges = spark.createDataFrame([("t", 1, "s1", "b1"), ("t", 2, "b1", "s2"), ("t", 3, "s2", "b2")], EDGES)
    types = spark.createDataFrame(
        [("t", "s1", "spout"), ("t", "s2", "spout"), ("t", "b1", "bolt"), ("t", "b2", "bolt")],
        "topology_id string, component_id string, component_type string")
    got = {(r.root, r.component_id) for r in graph.reachable_bolts(edges, types).collect()}
    assert got == {("s1", "b1"), ("s1", "b2"), ("s2", "b2")}


@pytest.mark.parametrize("width", [None, 2])
def test_adjacency_blocks_keep_order_and_duplicates(diamond, width):
    rows = graph.adjacency(diamond, block=2, width=width).filter("component_id = 'r'").orderBy("block_no").collect()
    assert [r.neighbors for r in rows] == [["x", "y"], ["x"]]


def test_a_long_path_takes_rounds_by_doubling(spark, monkeypatch):
    """A path of 600 nodes with a ring, a fork and a second way in at its side."""
    edges = [("t", i, f"n{i}", f"n{i + 1}") for i in range(600)]
    edges += [("t", 700, "n600", "r0"), ("t", 701, "r0", "r1"), ("t", 702, "r1", "r0"), ("t", 703, "n300", "side"),
              ("t", 704, "in", "n310"), ("u", 1, "n0", "n5"), ("u", 2, "n0", "n5")]
    df = spark.createDataFrame(edges, "topology_id string, edge_no bigint, src string, dst string")
    roots = spark.createDataFrame([("t", "n0"), ("t", "in"), ("t", "r1"), ("u", "n0"), ("u", "gone")], "topology_id string, component_id string")
    rounds = []
    kept = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda frame: rounds.append(1) or kept(frame))
    got = {tuple(r) for r in graph.reachable(df, roots).collect()}
    want = {("t", "n0", f"n{i}") for i in range(1, 601)} | {("t", "n0", x) for x in ("r0", "r1", "side")}
    want |= {("t", "in", f"n{i}") for i in range(310, 601)} | {("t", "in", x) for x in ("r0", "r1")}
    want |= {("t", "r1", "r0"), ("t", "r1", "r1"), ("u", "n0", "n5")}
    assert got == want and len(rounds) < 40
    assert graph.reachable(df.limit(0), roots).count() == 0


def test_a_shallow_walk_builds_no_jumps(spark, monkeypatch):
    """Three levels with repeated edges, a component on two levels and a ring: nothing of the ways is computed."""
    edges = [("t", i, f"c{i % 4}", f"o{i}") for i in range(12)] + [("t", i, f"o{i}", f"p{i % 5}") for i in range(12)]
    edges += [("t", i, f"p{i}", "s") for i in range(5)] * 3 + [("t", 50, "c1", "s"), ("t", 51, "c1", "p1"), ("t", 52, "p4", "o4")]
    built = []
    kept = graph._jumps
    monkeypatch.setattr(graph, "_jumps", lambda way: built.append(1) or kept(way))
    roots = spark.createDataFrame([("t", f"c{i}") for i in range(4)], "topology_id string, component_id string")
    rows = [tuple(r) for r in graph.reachable(spark.createDataFrame(edges, EDGES), roots).select("root", "component_id").collect()]
    assert set(rows) == {(f"c{i}", n) for i in range(4) for n in reach_of(edges, f"c{i}")} and len(rows) == len(set(rows))
    assert not built


def test_a_walk_ends_with_the_level_that_leads_nowhere(spark, diamond, root, monkeypatch):
    """Five tables for the paths of a graph three edges deep, and one for the names of its last level; no
    table names the ends of a path twice."""
    written = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, *how: written.append(df) or cut(df, *how))
    levels = graph._levels(diamond, root)
    assert [level.count() for level in levels] == [1, 3, 3, 3] and len(written) == 6
    assert {tuple(r["_between"]) for r in levels[3].collect()} == {("x", "z"), ("y", "z")}


def test_pre_order_sorts_by_root_first(diamond, root):
    """Every path has the same topology; a sort that begins with it compares whole rows."""
    import re

    plan = graph.pre_order(diamond, root)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window .*\[root#\d+, topology_id#\d+\], \[path#", plan)


def test_adjacency_deals_out_by_size(spark, monkeypatch):
    """More rows make more tasks than the session's four, for small nodes and for a cut hot one alike."""
    from flowgauge import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    edges = spark.createDataFrame([("t", i, f"n{i % 40 if i % 2 else 0}", f"d{i}") for i in range(100)], EDGES)
    want = {f"n{k}": [f"d{i}" for i in range(100) if (i % 40 if i % 2 else 0) == k] for k in range(40)}
    for width in ("auto", 7):
        lists = graph.adjacency(edges, block=8, width=width)
        assert "RepartitionByExpression" in lists._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in sorted(lists.collect(), key=lambda r: (r.component_id, r.block_no)):
            got.setdefault(r.component_id, []).extend(r.neighbors)
        assert got == {k: v for k, v in want.items() if v}
