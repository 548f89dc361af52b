import pytest
from pyspark.sql import functions as F

from flowgauge.functions.scalars import half_up, jittered, unit_value
from flowgauge.operators import replay, sensors

READINGS = "id bigint, ts_s bigint, value double, property bigint, plug_id bigint, household_id bigint, house_id bigint"


def file_of(spark, runs, house=1):
    rows, n = [], 0
    for no, size in enumerate(runs):
        for _ in range(size):
            rows.append((n, 1000 + no, 1.0, 1, 0, 0, house))
            n += 1
    return spark.createDataFrame(rows, READINGS)


@pytest.mark.parametrize("runs, speed", [
    ([5], None), ([4, 9], 4), ([3] * 19 + [50], 3), ([2] * 19 + [100, 7], 2), ([2] * 18 + [40] + [9] * 6, 4)])
@pytest.mark.parametrize("width", [None, 7])
def test_source_speed(spark, runs, speed, width):
    found = replay.run_lengths(file_of(spark, runs), width=width)
    assert [r.rows for r in found.orderBy("run_no").collect()] == runs
    assert replay.source_speed(found).first().speed == speed


def test_a_hot_publisher_is_cut_by_the_probe(spark):
    df = file_of(spark, [4, 9, 2] * 10).unionByName(file_of(spark, [3, 1], house=2))
    runs = replay.run_lengths(df, max_rows=5).orderBy("house_id", "run_no").collect()
    assert [r.rows for r in runs] == [4, 9, 2] * 10 + [3, 1]


def test_equal_times_apart_are_two_runs(spark):
    df = spark.createDataFrame([(i, t, 1.0, 1, 0, 0, 1) for i, t in enumerate([5, 5, 6, 5])], READINGS)
    assert [r.rows for r in replay.run_lengths(df).orderBy("run_no").collect()] == [2, 1, 1]


def test_day_gap_rounds_halves_up(spark):
    df = spark.createDataFrame([(0, 100, 1.0, 1, 0, 0, 1)], READINGS)
    for days, want in ((0.5, 1), (-2.5, -2), (-0.5, 0), (2.4, 2)):
        assert replay.day_gap(df, 100 + int(days * 86400)).first().gap_s == want * 86400
    assert [r[0] for r in spark.range(1).select(half_up(F.lit(-2.5))).collect()] == [-2]


def test_jitter_is_repeatable_and_bounded(spark):
    df = spark.range(5000).select("id", F.lit(-50.0).alias("v"), unit_value(F.col("id"), 3).alias("u"))
    row = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.01
    texts = [r[0] for r in df.select(jittered(F.col("v"), F.col("u"))).collect()]
    assert all(45 <= float(t) <= 55 and len(t.split(".")[1]) == 3 for t in texts)
    assert texts == [r[0] for r in df.select(jittered(F.col("v"), F.col("u"))).collect()]


@pytest.mark.parametrize("width", [None, 4])
def test_schedule_progress_and_resume(spark, width):
    df = file_of(spark, [10, 13])
    plan = replay.paced_schedule(df, 5, width=width)
    assert [r.tick for r in plan.orderBy("id").collect()] == [i // 5 for i in range(23)]
    done = replay.replay_progress(plan, width=width).orderBy("tick").collect()
    assert [(r.speed, r.total) for r in done] == [(5, 5), (5, 10), (5, 15), (5, 20), (3, 23)]
    assert {r.tick for r in replay.paced_schedule(df, 0).collect()} == {0}
    saved = spark.createDataFrame([(1, 20)], "house_id bigint, sent bigint")
    assert [r.id for r in replay.resume_after(df, saved, width=width).orderBy("id").collect()] == [20, 21, 22]
    assert replay.skip_rows(df, 21, width=width).count() == 2


def test_slices_and_forecast(spark):
    day = 86400
    rows = []
    for d, v in enumerate([10.0, 20.0, 60.0, 40.0]):
        rows += [(d, d * day + 7200, v, 1, 0, 0, 1), (d, d * day, 4.0, 1, 0, 0, 1), (d, d * day, 99.0, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows, READINGS)
    loads = sensors.slice_sum(sensors.slice_avg(df, (60,))).filter("level = 'house'")
    got = {r.slice: r.forecast for r in sensors.slice_forecast(loads, ["house_id"]).collect()}
    # 00:00 looks at 02:00 of earlier days: nothing, then 10, then median(10, 20), then 20
    assert [got[d * day] for d in range(4)] == [4.0, (4 + 10) / 2, (4 + 15) / 2, (4 + 20) / 2]
    assert got[7200] == 10.0  # 04:00 was never seen


def test_slice_avg_is_the_mean_of_all_readings(spark):
    df = spark.createDataFrame([(i, 60 * (i // 3), float(i), 1, 0, 0, 1) for i in range(12)], READINGS)
    got = {(r.slice_min, r.slice): r.load for r in sensors.slice_avg(df, (1, 2)).collect()}
    assert got[(1, 60)] == 4.0 and got[(2, 0)] == 2.5
