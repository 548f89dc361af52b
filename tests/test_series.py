import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import series as se

SCHEMA = "metric string, labels map<string,string>, ts timestamp, value double"


def sample(metric, pod, second, value):
    return metric, {"pod": pod, "namespace": "n"}, datetime.fromtimestamp(second, timezone.utc), value


@pytest.fixture(scope="module")
def points():
    rng = random.Random(2)
    data = {}
    for pod in ("a", "b", "c"):
        # many samples lie exactly on the grid, where the closed ends matter
        times = sorted(rng.sample(range(1000, 4000), 60) + [1200, 1500, 1800, 2400, 3000])
        data[pod] = [(t, float(rng.randint(0, 50))) for t in sorted(set(times))]
    return data


@pytest.fixture(scope="module")
def samples(spark, points):
    return spark.createDataFrame([sample("m", p, t, v) for p, xs in points.items() for t, v in xs], SCHEMA)


GRIDS = [se.Grid(900, 4200, 300, 600), se.Grid(900, 4200, 300, 200), se.Grid(1500, 3000, 200, 300)]


def inside(xs, grid, step):
    return [(t, v) for t, v in xs if step - grid.window <= t <= step]


def steps(grid):
    first = -(-grid.start // grid.step) * grid.step
    return range(first, grid.end + 1, grid.step)


@pytest.mark.parametrize("grid", GRIDS)
def test_averages(samples, points, grid):
    got = {(r.pod, r.step): r.value for r in
           se.avg_over_time(se.select_series(samples, "m", by=("pod",)), grid, ("pod",)).collect()}
    want = {}
    for pod, xs in points.items():
        for step in steps(grid):
            vs = [v for _, v in inside(xs, grid, step)]
            if vs:
                want[pod, step] = sum(vs) / len(vs)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("grid", GRIDS)
def test_latest(samples, points, grid):
    got = {(r.pod, r.step): r.value for r in
           se.instant_vector(se.select_series(samples, "m", by=("pod",)), grid, ("pod",)).collect()}
    want = {(p, s): inside(xs, grid, s)[-1][1] for p, xs in points.items() for s in steps(grid) if inside(xs, grid, s)}
    assert got == want


@pytest.mark.parametrize("grid", GRIDS)
@pytest.mark.parametrize("width", [None, 250_000_000])
def test_rates_with_resets(samples, points, grid, width):
    chosen = se.select_series(samples, "m", by=("pod",))
    got = {(r.pod, r.step): r.value for r in se.counter_rate(chosen, grid, ("pod",), width=width).collect()}
    want = {}
    for pod, xs in points.items():
        for step in steps(grid):
            seen = inside(xs, grid, step)
            if len(seen) > 1:
                gain = sum(v if v < p else v - p for (_, p), (_, v) in zip(seen, seen[1:]))
                want[pod, step] = gain / (seen[-1][0] - seen[0][0])
    assert got == pytest.approx(want)


def test_selectors(spark):
    df = spark.createDataFrame(
        [sample("m", "split-1", 0, 1.0), sample("m", "x-split-1", 0, 2.0), sample("k", "split-1", 0, 3.0)], SCHEMA)
    assert [r.value for r in se.select_series(df, "m", {"pod": "x-split-1"}).collect()] == [2.0]
    assert [r.value for r in se.select_series(df, "m", matches={"pod": "split-.*"}).collect()] == [1.0]
    assert se.select_series(df, "k").first().series == "namespace=n,pod=split-1"


def test_mean_of_means_counts_each_series_once(spark):
    df = spark.createDataFrame(
        [("a", 0, 10.0), ("b", 0, 20.0)], "series string, step bigint, value double")
    assert se.avg_by(df).first().value == 15.0
    assert se.first_series(df).first().series == "a"
