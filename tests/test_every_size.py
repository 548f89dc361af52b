"""Cases that the test tables do not hold: nulls, bounds, cycles, unknown types, silent hosts."""

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import graph, rollup, scaling as sc
from flowgauge.operators.ordered import clamped_running_sum, ordered_scan, previous, running_sum


@pytest.mark.parametrize("width", [None, 3])
def test_null_keys_and_positions_stay(spark, width):
    rows = [("a", None, 0, 1), ("a", 2, 1, 2), ("a", 9, 2, -7), (None, 1, 3, 4), (None, 8, 4, 5), ("b", None, 5, 6)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint, v bigint")
    out = ordered_scan(df, ["k"], ["t", "id"], {"s": running_sum(F.col("v")), "p": previous(F.col("v"))}, width=width)
    assert {r.id: (r.s, r.p) for r in out.collect()} == {
        0: (1, None), 1: (3, 1), 2: (-4, 2), 3: (4, None), 4: (9, 4), 5: (6, None)}
    low = clamped_running_sum(df, ["k"], ["t", "id"], F.col("v"), "level", width=width)
    assert {r.id: r.level for r in low.collect()} == {0: 1, 1: 3, 2: 0, 3: 4, 4: 9, 5: 6}


@pytest.mark.parametrize("options", [{}, {"fold_limit": 0}])
def test_rate_limit_stays_within_its_bounds(spark, options):
    wanted = [10] * 40 + [0] * 40
    df = spark.createDataFrame([("h", 60 * i, 5, w, w) for i, w in enumerate(wanted)],
                               "host string, step bigint, current bigint, scale_up_to bigint, scale_down_to bigint")
    got = [r.replicas for r in sc.replica_rate_limit(df, 300, **options).orderBy("step").collect()]
    assert max(got) == 7 and got[39] == 7 and got[-1] == 1 and min(got) == 1


def test_walk_ends_on_a_cycle(spark):
    edges = spark.createDataFrame([("t", 1, "a", "b"), ("t", 2, "b", "a"), ("t", 3, "b", "c")],
                                  "topology_id string, edge_no bigint, src string, dst string")
    roots = spark.createDataFrame([("t", "a")], "topology_id string, component_id string")
    assert sorted(r.component_id for r in graph.reachable_paths(edges, roots).collect()) == ["b", "c"]


def test_polls_go_on_to_the_last_tick(spark):
    df = spark.createDataFrame([("t", "x", 0, 1), ("t", "x", 20, 2), ("t", "y", 60, 3)],
                               "topology_id string, component_id string, tick bigint, acked bigint")
    out = rollup.poll_series(df, "x", 10, ["acked"]).orderBy("tick").collect()
    assert [(r.tick, r.acked) for r in out] == [(0, 1), (10, 1), (20, 2), (30, 2), (40, 2), (50, 2), (60, 2)]


def test_named_host_without_samples_has_scores(spark):
    samples = spark.createDataFrame([], "metric string, labels map<string,string>, ts timestamp, value double")
    from flowgauge.operators.series import Grid

    rows = sc.score_inputs(samples, Grid(0, 600, 60, 60), "spout-main", host="h").collect()
    assert len(rows) == 11 and all(r.worker_used == r.bolt_capacity == r.spout_latency == 0 for r in rows)
