import random

import pytest
from pyspark.sql import functions as F

from flowgauge.operators import scaling as sc


def limit_loop(rows, period, down_period):
    replicas, last_up, last_down, out = rows[0][1], None, None, []
    for step, _, up, down in rows:
        if up > replicas and (last_up is None or step - last_up >= period):
            replicas, last_up = replicas + 1, step
        elif down < replicas and (last_down is None or step - last_down >= down_period):
            replicas, last_down = replicas - 1, step
        out.append(replicas)
    return out


LIMIT_COLUMNS = "host string, step bigint, current bigint, scale_up_to bigint, scale_down_to bigint"


@pytest.mark.parametrize("periods", [(300, 300), (120, 600)])
@pytest.mark.parametrize("options", [{}, {"fold_limit": 0}, {"fold_limit": 0, "width": 700}])
def test_rate_limit_equals_the_loop(spark, options, periods):
    rng = random.Random(6)
    data, want = [], {}
    for host in "abc":
        rows, low, step = [], 3, 0
        for _ in range(150):
            low = min(7, max(1, low + rng.choice([-2, -1, 0, 0, 1, 2])))
            rows.append((step, rng.randint(1, 7), low, min(7, low + rng.choice([0, 0, 1, 2]))))
            step += 60 if host != "c" else rng.choice([7, 60, 290])
        want[host] = limit_loop(rows, *periods)
        data += [(host, *r) for r in rows]
    df = spark.createDataFrame(data, LIMIT_COLUMNS)
    out = sc.replica_rate_limit(df, *periods, **options)
    for host in "abc":
        got = out.filter(F.col("host") == host).orderBy("step").collect()
        assert [r.replicas for r in got] == want[host]


@pytest.mark.parametrize("options", [{}, {"fold_limit": 0}])
def test_directions_do_not_hold_each_other_back(spark, options):
    rows = [("h", 60 * i, 3, w, w) for i, w in enumerate([4, 3, 4, 3, 3, 4, 3])]
    out = sc.replica_rate_limit(spark.createDataFrame(rows, LIMIT_COLUMNS), 300, **options)
    assert [r.replicas for r in out.orderBy("step").collect()] == [4, 3, 3, 3, 3, 4, 3]


def test_score_terms_and_report(spark):
    df = spark.createDataFrame([("h", 0, 0.7, 0.5, 100.0)],
                               "host string, step bigint, worker_used double, bolt_capacity double, spout_latency double")
    scored = sc.is_active(sc.load_score(df))
    row = scored.first()
    assert row.score == 1.0 and row.is_active
    assert sum(r.part for r in sc.score_parts(df).collect()) == pytest.approx(1.0)
    rows = sc.score_report_rows(sc.score_report(scored)).collect()
    assert [r.metric_name for r in rows] == ["custom_metric", *sc.SCORE_TERMS]
    assert sc.score_spec() == [{"metricName": "custom_metric", "targetValue": 0.7}]


def test_replica_target_bounds(spark):
    df = spark.createDataFrame([(0.0,), (0.75,), (0.76,), (9.0,)], "score double")
    out = sc.replica_target(df, F.lit(2)).collect()
    assert [r.desired for r in out] == [1, 2, 3, 7]


@pytest.mark.parametrize("width", [None, 50])
def test_backlog_never_negative(spark, width):
    rng = random.Random(8)
    deltas = [rng.choice([1, 1, 1, -1, -1, 0]) for _ in range(300)]
    df = spark.createDataFrame([(1, i, i, d) for i, d in enumerate(deltas)],
                               "queue bigint, ts_us bigint, event_id bigint, delta bigint")
    level, want = 0, []
    for d in deltas:
        level = max(0, level + d)
        want.append((level, min(10, max(1, -(-level // 5)))))
    out = sc.backlog_replicas(df, width=width).orderBy("event_id").collect()
    assert [(r.backlog, r.replicas) for r in out] == want
