import pytest

from flowgauge.schemas import EXECUTOR_STATS, SAMPLES, STREAM_STATS
from flowgauge.sources import lines, readings, tables, topology
from flowgauge.sources.lines import read_lines


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name, n in (("big", 500), ("small", 3)):
        (tmp_path / name).write_text("\n".join(f"{name} {i}" for i in range(1, n + 1)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 0
        got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(n, i): f"{n} {i}" for n, k in (("big", 500), ("small", 3)) for i in range(1, k + 1)}


def test_edge_files(spark, tmp_path):
    lines = ["pipe", "a b", "a b ", " a b", "a  b", "a b c", "ab", "", " ", "b c"]
    (tmp_path / "one").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "two").write_text("other\nx y")
    (tmp_path / "empty").write_text("")
    df = read_lines(spark, str(tmp_path))
    got = sorted(tuple(r) for r in topology.edges(df).collect())
    assert got == [("other", 1, "x", "y"), ("pipe", 1, "a", "b"), ("pipe", 2, "a", "b"), ("pipe", 9, "b", "c")]
    bad = {r.line_no: (r.line, r.reason) for r in topology.edge_rejects(df).collect()}
    assert bad == {4: (" a b", "not two parts"), 5: ("a  b", "not two parts"), 6: ("a b c", "not two parts"),
                   7: ("ab", "no space"), 8: ("", "no space"), 9: (" ", "not two parts")}
    known = df.filter("line = 'pipe'").first().file
    listed = spark.createDataFrame([(known[:-3] + n,) for n in ("one", "two", "empty")], "file string")
    assert [r.file.rsplit("/", 1)[1] for r in topology.empty_files(listed, df).collect()] == ["empty"]


def test_files_of_lines_round_trip(spark, tmp_path):
    rows = [(f"f{k}", n, "" if n % 5 == 0 else f" {k}  {n} ") for k in range(3) for n in range(1, 40)]
    shuffled = spark.createDataFrame(rows[::-1], "file string, line_no bigint, line string").repartition(5)
    lines.write_files(shuffled, str(tmp_path / "out"))
    back = lines.by_folder(read_lines(spark, str(tmp_path / "out")))
    assert sorted(tuple(r) for r in back.select("file", "line_no", "line").collect()) == rows


def test_streams_of_the_runtime_do_not_count(spark, tmp_path):
    row = lambda stream, n, latency: ("t", 0, "b", "bolt", 1, 2, 3, 4, n, n, n, 0, n, None, latency, latency, 0.5, stream)
    rows = [row("default", 3, 1.0), row("errors", 1, 5.0), row("__metrics", 9, 9.0)]
    rows += [("t", 0, "__acker", "bolt", 2, 1, 1, 1, 1, 1, 1, 1, 1, None, 1.0, 1.0, 1.0, "default")]
    spark.createDataFrame(rows, STREAM_STATS).write.parquet(str(tmp_path / "s"))
    [got] = tables.stream_stats(spark, str(tmp_path / "s")).collect()
    assert (got.emitted, got.executed, got.num_executors, got.num_tasks, got.capacity) == (4, 4, 2, 3, 0.5)
    assert (got.process_latency_ms, got.execute_latency_ms, got.complete_latency_ms) == (2.0, 2.0, None)
    [whole] = tables.stream_stats(spark, str(tmp_path / "s"), system=True).collect()
    assert whole.emitted == 13
    assert tables.of_streams(spark.createDataFrame(rows[2:3], STREAM_STATS)).count() == 0


def test_targets(spark, tmp_path):
    (tmp_path / "t").write_text("a 1\nb 2 extra\na 3.5\nbad\nc x\nd  4\n")
    df = read_lines(spark, str(tmp_path / "t"))
    got = {r.component_id: r.target_rate for r in topology.targets(df).collect()}
    assert got == {"a": 3.5, "b": 2.0}
    assert sorted(r.line for r in topology.target_rejects(df).collect()) == ["bad", "c x", "d  4"]


def test_lookup(spark):
    known = spark.createDataFrame([("a", "a-1", 1), ("a", "a-2", 2), ("b", "b-1", 3)],
                                  "name string, topology_id string, seq bigint")
    wanted = spark.createDataFrame([("a",), ("z",)], "name string")
    assert [tuple(r) for r in topology.lookup(wanted, known).collect()] == [("a", "a-2")]
    assert [r.name for r in topology.lookup_missing(wanted, known).collect()] == ["z"]


def test_readings_files_are_one_union(spark, tmp_path):
    for house in (1, 2):
        (tmp_path / f"house-{house}.csv").write_text(f"7,1377986401,68.451,1,11,0,{house}\n8,1377986402,0,0,11,0,{house}\n")
    rows = readings.read_readings(spark, str(tmp_path)).orderBy("house_id", "id").collect()
    assert [(r.house_id, r.id, r.value) for r in rows] == [(1, 7, 68.451), (1, 8, 0.0), (2, 7, 68.451), (2, 8, 0.0)]
    assert {r.publisher_file.rsplit("/", 1)[1] for r in rows} == {"house-1.csv", "house-2.csv"}


def test_tables_round_trip(spark, tmp_path):
    from datetime import datetime

    df = spark.createDataFrame([("m", {"a": "b"}, datetime(2024, 1, 2), 1.0), ("k", {"a": "b"}, datetime(2024, 1, 3), 2.0)], SAMPLES)
    tables.write_samples(df, str(tmp_path / "s"))
    back = tables.samples(spark, str(tmp_path / "s")).filter("metric = 'm'")
    assert back.schema == SAMPLES and [r.value for r in back.collect()] == [1.0]
    assert "PartitionFilters: [isnotnull(metric" in back._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    stats = [("t", 0, n, "bolt", 1, 1, 1, 1, 1, 1, 1, 1, 1, None, 1.0, 1.0, 1.0) for n in ("b", "__system")]
    spark.createDataFrame(stats, EXECUTOR_STATS).write.parquet(str(tmp_path / "e"))
    assert [r.component_id for r in tables.executor_stats(spark, str(tmp_path / "e")).collect()] == ["b"]
    assert tables.executor_stats(spark, str(tmp_path / "e"), stream=True).isStreaming


@pytest.mark.parametrize("master, folder, fails", [("local[2]", None, False)])
def test_shared_folder(spark, master, folder, fails):
    from flowgauge.session import scratch_path, shared_folder

    assert scratch_path(spark, "x").startswith(shared_folder(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_files_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    from flowgauge import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    rows = [(f"f{k}", n, f"{k} {n}") for k in range(9) for n in range(1, 13)]
    df = spark.createDataFrame(rows[::-1], "file string, line_no bigint, line string")
    assert lines.dealt(df, len(rows), "file").rdd.getNumPartitions() == 11
    lines.write_files(df, str(tmp_path / "out"))
    back = lines.by_folder(read_lines(spark, str(tmp_path / "out")))
    assert sorted(tuple(r) for r in back.select("file", "line_no", "line").collect()) == rows


def test_no_line_is_shuffled_to_be_numbered(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    plan = read_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "broadcast" in plan
