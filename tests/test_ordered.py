import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import ordered as o
from flowgauge.operators.chain import follow
from flowgauge.operators.joins import attach


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key, n in (("hot", 400), ("warm", 40), ("one", 1)):
        times = sorted(rng.sample(range(10_000), n))
        data += [(key, t, i, rng.choice([None, rng.randint(-3, 3)])) for i, t in enumerate(times)]
    return data


@pytest.mark.parametrize("width", [None, 1, 37, 1000, "auto"])
def test_scan_equals_a_loop(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    steps = {
        "total": o.running_sum(F.coalesce("v", F.lit(0))), "nullable": o.running_sum(F.col("v")),
        "n": o.running_count(), "low": o.running_min(F.col("v")),
        "high": o.running_max(F.col("v")), "known": o.last_known(F.col("v")), "before": o.previous(F.col("v")),
    }
    out = o.ordered_scan(df, ["k"], ["t", "i"], steps, width=width, grain=100, max_rows=50)
    got = {(r.k, r.i): r for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("hot", "warm", "one"):
        mine = sorted(r for r in rows if r[0] == key)
        for place, (_, _, i, v) in enumerate(mine):
            seen = [r[3] for r in mine[: place + 1] if r[3] is not None]
            r = got[key, i]
            assert r.total == sum(seen) and r.n == place + 1
            assert r.nullable == (sum(seen) if seen else None)
            assert r.low == (min(seen) if seen else None) and r.high == (max(seen) if seen else None)
            assert r.known == (seen[-1] if seen else None)
            assert r.before == (mine[place - 1][3] if place else None)


def test_probe_narrows_bursts(spark):
    burst = [("a", 5000 + i % 10, i) for i in range(1000)]
    df = spark.createDataFrame(burst, "k string, t bigint, i bigint")
    assert o.chunk_width(df, ["k"], "t", 3600, max_rows=2000) is None
    assert o.chunk_width(df, ["k"], "t", 3600, max_rows=100) == 360


@pytest.mark.parametrize("width", [None, 13])
def test_clamped_sum(spark, width):
    rng = random.Random(5)
    deltas = [rng.choice([-1, 0, 1, 2]) for _ in range(200)]
    df = spark.createDataFrame([("k", i, d) for i, d in enumerate(deltas)], "k string, t bigint, d bigint")
    out = o.clamped_running_sum(df, ["k"], ["t"], F.col("d"), "s", width=width)
    want = list(accumulate(deltas, lambda s, d: max(0, s + d), initial=0))[1:]
    assert [r.s for r in out.orderBy("t").collect()] == want


def test_trailing_window_is_closed(spark):
    rng = random.Random(7)
    points = sorted(rng.sample(range(0, 2000, 10), 90))
    df = spark.createDataFrame([("k", t, rng.randint(0, 99)) for t in points], "k string, t bigint, v bigint")
    data = {r.t: r.v for r in df.collect()}
    out = o.trailing_window(df, ["k"], "t", 100, {"low": F.min("v"), "n": F.count("v")})
    for r in out.collect():
        window = [v for t, v in data.items() if r.t - 100 <= t <= r.t]
        assert (r.low, r.n) == (min(window), len(window))


def test_follow_long_and_short_chains(spark):
    rng = random.Random(11)
    links = [(k, n, n + rng.randint(1, 4)) for k in "ab" for n in range(300)]
    df = spark.createDataFrame(links, "k string, n bigint, m bigint")
    roots = spark.createDataFrame([("a", 0), ("b", 250), ("c", 1)], "k string, n bigint")
    got = {(r.k, r.n) for r in follow(df, roots, ["k"], ["n"], ["m"]).collect()}
    table, want = {(k, n): m for k, n, m in links}, set()
    for k, n in (("a", 0), ("b", 250), ("c", 1)):
        while n is not None:
            want.add((k, n))
            n = table.get((k, n))
    assert got == want


@pytest.mark.parametrize("limit", [0, 100])
def test_attach_broadcast_and_salted_agree(spark, limit):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "x"), (1, "y"), (9, "z")], "k bigint, v string")
    out = attach(big, small, ["k"], F.col("id"), "left", broadcast_rows=limit)
    counts = {r.v: r["count"] for r in out.groupBy("v").count().collect()}
    assert counts == {"x": 334, "y": 333, None: 333}
