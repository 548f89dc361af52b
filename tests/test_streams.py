"""Streams of several files and batches, stopped and started again, beside the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import flowcheck as fc
from flowgauge.operators import replay
from flowgauge.operators import sensors as slices
from flowgauge.sources import readings as files
from flowgauge.streaming import run, sensors, telemetry
from tests.test_flowcheck import METRICS, make_topologies


def one_file(df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # a file source takes files by age


@pytest.fixture(scope="module")
def flow(spark):
    rows, targets, reach = make_topologies(6, ticks=60)
    return (spark.createDataFrame(rows, METRICS).cache(),
            spark.createDataFrame(targets, "topology_id string, component_id string, target_rate double"),
            spark.createDataFrame(reach, "topology_id string, root string, component_id string"))


def plan_rows(df):
    return sorted(tuple(r) for r in df.select(
        "topology_id", "tick", "moves", "component_id", "executors_before", "executors_after", "workers_before", "workers_after").collect())


@pytest.fixture(scope="module")
def want(flow):
    whole = fc.flow_check(*flow)
    return plan_rows(whole.executor_plan().join(whole.worker_plan().drop("changes", "threads"), ["topology_id", "tick"]))


def test_flow_check_one_file_per_batch_with_a_restart(spark, flow, want, tmp_path):
    metrics, targets, reach = flow
    source, stream = str(tmp_path / "metrics"), telemetry.FlowStream(str(tmp_path / "flow"), targets, reach)
    parts = [metrics.filter(F.col("tick").between(1000 + 30 * a, 1000 + 30 * b - 1)) for a, b in ((0, 7), (7, 20), (20, 45), (45, 60))]
    for some in (parts[:2], parts[2:]):
        for part in some:
            one_file(part, source)
        reader = spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream.start(reader)
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    assert plan_rows(stream.plans(spark)) == want and len(want) > 10


def test_a_repeated_batch_changes_nothing(spark, flow, want, tmp_path):
    metrics, targets, reach = flow
    stream = telemetry.FlowStream(str(tmp_path), targets, reach)
    first, second = metrics.filter("tick < 1900"), metrics.filter("tick >= 1900")
    for part, batch in ((first, 0), (first, 0), (first.limit(0), 1), (second, 2), (second, 2)):
        stream.step(part, batch)
    assert plan_rows(stream.plans(spark)) == want


LINES = {
    1: ["7,1377986401,0,1,11,0,1", "8,1377986402,12345678.5,1,11,0,1", "9,1377986402,1.50,1,11,0,1,more,\"x", "broken", "10,x,1,1,1,1,1"],
    2: ["7,1378159201,68.451,1,11,0,2", "", "8,1378159201,1e2,1,11,0,2 "],
}


@pytest.fixture
def houses(tmp_path):
    for house, lines in LINES.items():
        (tmp_path / "in" / f"house-{house}").mkdir(parents=True)
        (tmp_path / "in" / f"house-{house}" / "a.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "in")


def test_lines_stay_as_they_are(spark, houses):
    lines = files.read_reading_lines(spark, houses)
    good = files.readings_of(lines)
    kept = {r.line for r in replay.replay_original(good).collect()}
    assert kept == {*LINES[1][:3], LINES[2][0], LINES[2][2]}
    bad = {(r.line, r.reject_reason) for r in files.reading_rejects(lines).collect()}
    assert bad == {("broken", "missing fields"), (LINES[1][4], "no ts_s"), ("", "missing fields")}
    assert good.filter("id = 9").first().value == 1.5 and lines.count() == 8


@pytest.mark.parametrize("mode", ["original", "date", "realtime"])
def test_publish(spark, houses, tmp_path, mode):
    good = files.readings_of(files.read_reading_lines(spark, houses))
    gaps = replay.day_gap(good, 1377986401 + 10 * 86400)
    assert {r.house_id: r.gap_s // 86400 for r in gaps.collect()} == {1: 10, 2: 8}
    stream = files.readings_of(files.read_reading_lines(spark, houses, stream=True))
    begin = int(time.time())
    out = run.drain(sensors.publish(stream, mode, gaps, seed=5), "sent")
    sent = {(r.key, r.value.split(",")[0]): r.value for r in out.collect()}
    assert len(sent) == 5
    for r in good.collect():
        line = sent[str(r.house_id), str(r.id)]
        old, new = r.line.split(",", 3), line.split(",", 3)
        assert new[0] == old[0] and new[3] == old[3]
        if mode == "original":
            assert line == r.line
            continue
        assert abs(float(new[2]) - r.value) <= 0.1 * r.value + 0.001 and len(new[2].split(".")[1]) == 3
        if mode == "date":
            assert int(new[1]) == r.ts_s + (10 if r.house_id == 1 else 8) * 86400
        else:
            assert begin <= int(new[1]) <= time.time()


def test_unknown_mode(spark, houses):
    with pytest.raises(ValueError):
        sensors.publish(files.read_reading_lines(spark, houses), "backwards")


def test_one_file_per_second(spark, tmp_path):
    """Four files at one per batch: the batches are the schedule."""
    rows = spark.range(40).select(F.lit(1).alias("house_id"), "id", F.concat(F.col("id").cast("string"), F.lit(",1,1,1,1,1,1")).alias("line"))
    ticks = replay.paced_schedule(rows, 10, width=None)
    source = str(tmp_path / "ticks")
    for tick in range(4):
        files.write_ticks(ticks.filter(F.col("tick") == tick).coalesce(1), source)
        time.sleep(0.02)
    seen = []
    reader = sensors.paced(spark.readStream.option("recursiveFileLookup", "true")).text(source)
    query = (reader.writeStream.foreachBatch(lambda df, n: seen.append((n, sorted(int(r.value.split(",")[0]) for r in df.collect()))))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(**sensors.every(0.2)).start())
    sensors.run_paced(query)
    assert [x for x in seen if x[1]] == [(n, list(range(10 * n, 10 * n + 10))) for n in range(4)]


def test_progress_of_more_than_a_hundred_batches(spark, tmp_path):
    source = str(tmp_path / "many")
    spark.range(104 * 3).repartition(104).write.parquet(source)
    with sensors.ProgressLog(spark, str(tmp_path / "log"), "many") as log:
        reader = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(source)
        query = (reader.writeStream.queryName("many").format("noop").option("checkpointLocation", str(tmp_path / "state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    rows = log.rows().filter("rows > 0").collect()
    assert sorted(r.batch for r in rows) == list(range(len(rows))) and len(rows) > 100
    assert sum(r.rows for r in rows) == 104 * 3 and len(query.recentProgress) <= 100


def test_slices_over_batches_with_late_readings(spark, tmp_path):
    rng = random.Random(2)
    schema = "id bigint, ts_s bigint, value double, property int, plug_id int, household_id int, house_id int"
    rows = [(i, 60 * i + rng.randrange(-200, 200) + 7200, float(rng.randrange(100)), int(i % 9 > 0), i % 3, 0, 1) for i in range(400)]
    stream = sensors.SliceStream(str(tmp_path), minutes=(1, 5, 120), lateness=600)
    parts = [rows[:150], [], rows[150:300], rows[150:300], rows[300:], [(999, 7300, 1e6, 1, 0, 0, 1)]]
    for batch, part in zip((0, 1, 2, 2, 3, 4), parts):
        stream.step(spark.createDataFrame(part, schema), batch)
    got = {(r.plug_id, r.slice_min, r.slice): r.load for r in stream.slices(spark).collect()}
    batch = slices.slice_avg(spark.createDataFrame(rows, schema), (1, 5, 120)).collect()
    mark = max(r[1] for r in rows) - 600
    assert got == {(r.plug_id, r.slice_min, r.slice): r.load for r in batch if r.slice + r.slice_min * 60 <= mark}
    assert stream.slices(spark).count() == len(got)
