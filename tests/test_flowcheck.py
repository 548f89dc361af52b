import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import flowcheck as fc
from flowgauge.operators import rollup
from flowgauge.session import cut_lineage

METRICS = ("topology_id string, tick bigint, component_id string, component_type string, executors bigint, "
           "acked_rate double, complete_latency double, capacity double")

# previous rate, current rate, previous latency, current latency, change of severity
TRUTH = [
    (100.0, 102.0, 5.0, 9.0, -1), (100.0, 100.5, 5.0, 9.0, 1), (100.0, 100.5, 9.0, 5.0, 0),
    (100.0, 99.0, 5.0, 5.0, 0), (100.0, 90.0, 5.0, 5.0, 1), (100.0, 90.0, 5.0, 11.0, 2),
    (100.0, 100.0, 5.0, 11.0, 1), (100.0, 100.0, 5.0, 10.0, 0), (0.0, 1.0, 5.0, 9.0, -1),
    (0.0, 0.0, 5.0, 5.0, 0), (0.0, 0.0, 5.0, 50.0, 1), (100.0, 100.0, 0.0, 1.0, 1),
    (100.0, 90.0, None, 5.0, 1), (100.0, 90.0, 5.0, None, 1), (100.0, 100.5, None, 5.0, 1),
    (100.0, 98.0, 5.0, 5.0, 0), (100.0, 101.0, 5.0, 5.0, 1),
]


def delta_of(p, c, pl, cl):
    """The change of severity for one pair of rows; None counts as missing."""
    if c > p:
        if p == 0 or (c - p) / p > fc.RISE:
            return -1
        return 0 if None not in (pl, cl) and pl > cl else 1
    dropped = p != 0 and (p - c) / p > fc.DROP
    slower = None not in (pl, cl) and cl > pl and (pl == 0 or (cl - pl) / pl > fc.LATENCY_GROWTH)
    return int(dropped) + int(slower)


def test_severity_truth_table(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(TRUTH)],
                               "i int, p double, c double, pl double, cl double, want int")
    delta = fc.severity_delta(F.col("p"), F.col("c"), F.col("pl"), F.col("cl"))
    for r in df.withColumn("got", delta).collect():
        assert r.got == r.want, r
        assert delta_of(r.p, r.c, r.pl, r.cl) == r.want, r


def make_topologies(seed, ticks=120):
    """Random metrics of three topologies with two sources, rows missing here and there."""
    rng = random.Random(seed)
    rows, reach = [], []
    for topo in ("t0", "t1", "t2"):
        bolts = {"s1": ["b1", "b2", "b3"], "s2": ["b3", "b4"]}
        reach += [(topo, s, b) for s, bs in bolts.items() for b in bs]
        for tick in range(ticks):
            at = 1000 + 30 * tick
            for s in bolts:
                if rng.random() < 0.85:
                    rows.append((topo, at, s, "spout", rng.randint(1, 3), rng.choice([90.0, 95.0, 100.0, 100.5, 130.0]),
                                 rng.choice([None, 5.0, 6.0, 13.0]), None))
            for b in ("b1", "b2", "b3", "b4", "stray"):
                if rng.random() < (0.3 if topo == "t2" else 0.8):
                    rows.append((topo, at, b, "bolt", rng.randint(1, 4), 1.0, None, rng.choice([0.1, 0.5, 0.7, 0.8, 0.95])))
    targets = [(t, s, 110.0) for t in ("t0", "t1", "t2") for s in ("s1", "s2")] + [("t0", "ghost", 1.0)]
    return rows, targets, reach


def brute_force(rows, targets, reach):
    """The check as a plain loop over ticks."""
    target = {(t, s): v for t, s, v in targets}
    plans, audit, workers_seen = set(), {}, []
    for topo in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == topo]
        severity, last, baseline, workers, moves = {}, {}, True, 2, 0
        for tick in sorted({r[1] for r in mine}):
            now = [r for r in mine if r[1] == tick]
            bolts = {r[2]: r for r in now if r[3] == "bolt"}
            picked, seen = {}, {}
            for _, _, s, kind, _, rate, latency, _ in now:
                if kind != "spout" or (topo, s) not in target:
                    continue
                old = severity.get(s, 0)
                if not baseline and s in last and target[topo, s] > rate:
                    severity[s] = max(0, old + delta_of(last[s][0], rate, last[s][1], latency))
                    if severity[s] >= 2:
                        below = sorted((bolts[b] for t, r, b in reach if (t, r) == (topo, s) and b in bolts),
                                       key=lambda r: (-r[7], r[2]))
                        for i, b in enumerate(below):
                            if i == 0 or b[7] > 0.7:
                                picked[b[2]] = b[4]
                last[s] = (rate, latency)
                seen[s] = (old, severity.get(s, 0))
            for s, (old, new) in seen.items():
                audit[topo, s, tick] = (old, new, bool(picked))
            baseline = bool(picked)
            if picked:
                moves += 1
                threads, before = sum(r[4] for r in now), workers
                if (threads + len(picked)) // (2 * workers) > 2 and workers < 28:
                    workers += 1
                workers_seen.append((topo, tick, moves, len(picked), threads, before, workers))
                plans |= {(topo, tick, b, n, n + 1) for b, n in picked.items()}
                severity = {}
    return plans, audit, workers_seen


@pytest.mark.parametrize("mode", ["fold", "follow", "chunked"])
@pytest.mark.parametrize("seed", [1, 2])
def test_flow_check_equals_the_loop(spark, seed, mode):
    rows, targets, reach = make_topologies(seed)
    options = {"fold": {}, "follow": {"fold_limit": 0},
               "chunked": {"fold_limit": 0, "max_group_rows": 16}}[mode]
    flow = fc.flow_check(
        spark.createDataFrame(rows, METRICS),
        spark.createDataFrame(targets, "topology_id string, component_id string, target_rate double"),
        spark.createDataFrame(reach, "topology_id string, root string, component_id string"), **options)
    plans, audit, workers = brute_force(rows, targets, reach)
    assert len(workers) > 20
    got = {tuple(r) for r in flow.executor_plan().collect()}
    assert got == plans
    seen = {(r.topology_id, r.component_id, r.tick): (r.severity_before, r.severity, r.planned)
            for r in flow.audit().collect()}
    assert seen == audit
    got = flow.worker_plan().select(
        "topology_id", "tick", "moves", "changes", "threads", "workers_before", "workers_after").collect()
    assert sorted(tuple(r) for r in got) == sorted(workers)
    states = flow.cooldown().groupBy("state").count().collect()
    assert {r.state: r["count"] for r in states}["plan"] == len(workers)
    assert all(r.wait_secs == 0 and r.num_executors for r in flow.commits().collect())


@pytest.mark.parametrize("mode, cuts", [("follow", [20]), ("fold", [1, 2, 45])])
def test_flow_check_in_parts_equals_the_loop(spark, cuts, mode):
    """Ticks in several parts, each with the state that the part before left."""
    rows, targets, reach = make_topologies(3, ticks=60)
    rows = [r for r in rows if r[0] != "t1" or r[1] > 1000 + 30 * 30]  # a topology that comes later
    targets_df = spark.createDataFrame(targets, "topology_id string, component_id string, target_rate double")
    reach_df = spark.createDataFrame(reach, "topology_id string, root string, component_id string")
    plans, _, workers = brute_force(rows, targets, reach)
    state = fc.FlowState(spark.createDataFrame([], fc.SOURCE_STATE), spark.createDataFrame([], fc.TOPOLOGY_STATE))
    got, seen = set(), []
    for low, high in zip([0, *cuts], [*cuts, 10**6]):
        part = spark.createDataFrame([r for r in rows if low <= (r[1] - 1000) // 30 < high], METRICS)
        flow = fc.flow_check(part, targets_df, reach_df, state=state, **({} if mode == "fold" else {"fold_limit": 0}))
        changed = cut_lineage(flow.worker_plan())
        got |= {tuple(r) for r in flow.executor_plan().collect()}
        seen += [tuple(r) for r in changed.select(
            "topology_id", "tick", "moves", "changes", "threads", "workers_before", "workers_after").collect()]
        state = fc.FlowState(*map(cut_lineage, flow.state_after(changed)))
    assert got == plans and sorted(seen) == sorted(workers) and len(workers) > 10


def test_plan_invariants(spark):
    rows, targets, reach = make_topologies(9)
    plans, _, workers = brute_force(rows, targets, reach)
    assert all(after == before + 1 for *_, before, after in plans)
    assert max(w[-1] for w in workers) <= fc.MAX_WORKERS


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_workers_by_blocks(spark, block):
    rng = random.Random(4)
    load = [("t", 30 * i, i, 1, rng.randint(1, 60), 0) for i in range(1, 90)]
    load = [(t, k, m, c, th, c + th) for t, k, m, c, th, _ in load]
    df = spark.createDataFrame(
        load, "topology_id string, tick bigint, moves bigint, changes bigint, threads bigint, demand bigint")
    w, want = 2, []
    for *_, demand in load:
        before = w
        w += int(demand // (2 * w) > 2 and w < 28)
        want.append((before, w))
    out = fc.workers_over_plans(df, block=block).orderBy("moves").collect()
    assert [(r.workers_before, r.workers_after) for r in out] == want
    # From the count after the first 30 plans, the rest goes the same way.
    starts = spark.createDataFrame([("t", want[29][1]), ("else", 9)], "topology_id string, workers bigint")
    rest = df.filter("moves > 30").withColumn("moves", F.col("moves") - 30)
    out = fc.workers_over_plans(rest, block=block, starts=starts).orderBy("moves").collect()
    assert [(r.workers_before, r.workers_after) for r in out] == want[30:]


def test_rejects_and_zero_weights(spark):
    stats = spark.createDataFrame(
        [("t", 0, "s", "spout", 1, 4, None, None, 0, 0, 0, 0, None, 7.0, None, None, None),
         ("t", 0, "b", "bolt", 1, 2, None, None, 5, 5, 0, 1, 1199, None, 3.0, 2.0, 0.5),
         ("t", 0, "b", "bolt", 2, 2, None, None, 5, 5, 0, 1, 0, None, 4.0, 8.0, 1.5),
         ("t", 0, "b", "bolt", 3, 2, None, None, 0, 0, 0, 0, 0, None, 4.0, 8.0, 0.1),
         ("t", 0, "x", "valve", 3, 2, None, None, 0, 0, 0, 0, 0, None, 4.0, 8.0, 0.1)],
        "topology_id string, tick bigint, component_id string, component_type string, executor_id bigint, "
        "num_executors int, num_tasks int, uptime_secs int, emitted bigint, transferred bigint, acked bigint, "
        "failed bigint, executed bigint, complete_latency_ms double, process_latency_ms double, "
        "execute_latency_ms double, capacity double")
    spout = rollup.spout_rollup(stats).first()
    assert spout.complete_latency is None and spout.acked_rate == 0.0 and spout.executors == 4
    bolt = rollup.bolt_rollup(stats).first()
    assert bolt.execute_rate == 1.0 and round(bolt.execute_rate_exact, 4) == 1.9983
    assert bolt.process_latency is None and bolt.execute_latency == 2.0
    assert bolt.capacity == 1.05 and bolt.max_capacity == 1.5  # by reported count 2, not by 3 rows
    assert [r.component_id for r in rollup.unknown_types(stats).collect()] == ["x"]
    none = stats.sparkSession.createDataFrame([], "topology_id string, component_id string, target_rate double")
    assert [r.component_id for r in fc.spouts_without_target(rollup.spout_rollup(stats), none).collect()] == ["s"]


def test_carry_forward(spark):
    df = spark.createDataFrame([("t", 0, "a", 1), ("t", 40, "a", 2), ("t", 60, "b", 9)],
                               "topology_id string, tick bigint, component_id string, v bigint")
    out = rollup.carry_forward(df, 20, ["v"]).orderBy("component_id", "tick").collect()
    assert [(r.component_id, r.tick, r.v, r.stale) for r in out] == [
        ("a", 0, 1, False), ("a", 20, 1, True), ("a", 40, 2, False), ("a", 60, 2, True), ("b", 60, 9, False)]
