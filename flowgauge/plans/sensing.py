"""Queries on sensor readings: replay and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgauge.operators import replay, sensors
from flowgauge.plans import adapters as ad
from flowgauge.plans import sql_views as v
from flowgauge.plans.registry import query, rounded, with_ctes
from flowgauge.session import cut_lineage, scratch_path
from flowgauge.sources import readings as reading_files

NOW, SEED, SPEED = 1722470400, 7, 25


# Files as they are found: some values are written without or with more decimals, some lines have a
# field more, some are broken. What a line says of its time and value is what its text says.
RAW = """
raw as (
  select house_id, id, ts_s, case id % 40 when 0 then '0' when 1 then '12345678.5' when 2 then value || '00'
                                          when 3 then '1e2' else cast(value as varchar) end as text,
         property || ',' || plug_id || ',' || household_id || ',' || house_id as rest, id % 40 as k from readings),
lines as (
  select house_id, id, ts_s, text, rest, k, case
    when k = 5 then 'sensor offline'
    when k = 6 then id || ',' || ts_s || ',' || text
    when k = 7 then id || ',' || ts_s || ',n/a,' || rest
    when k = 8 then id || ',' || ts_s || ',' || text || ',' || rest || ',extra, "field"'
    else id || ',' || ts_s || ',' || text || ',' || rest end as line from raw),
good as (select *, cast(text as double) as value from lines where k not in (5, 6, 7))
"""


def reading_lines(spark, sf):
    """(house_id, id, ts_s, line) as in the counterpart."""
    readings = ad.readings(spark, sf)
    k, text = F.col("id") % 40, F.col("value").cast("string")
    text = (F.when(k == 0, "0").when(k == 1, "12345678.5").when(k == 2, F.concat(text, F.lit("00")))
            .when(k == 3, "1e2").otherwise(text))
    head = F.concat_ws(",", F.col("id").cast("string"), F.col("ts_s").cast("string"))
    rest = F.concat_ws(",", *[F.col(c).cast("string") for c in ("property", "plug_id", "household_id", "house_id")])
    line = (F.when(k == 5, "sensor offline").when(k == 6, F.concat_ws(",", head, text))
            .when(k == 7, F.concat_ws(",", head, F.lit("n/a"), rest))
            .when(k == 8, F.concat(F.concat_ws(",", head, text, rest), F.lit(',extra, "field"')))
            .otherwise(F.concat_ws(",", head, text, rest)))
    return readings.select("house_id", "id", "ts_s", line.alias("line"))


def _files(spark, sf):
    """The lines written as one folder of text files per house, and read back."""
    path = scratch_path(spark, "readings")
    reading_files.write_lines(reading_lines(spark, sf), path)
    return reading_files.read_reading_lines(spark, path)


def _readings(spark, sf):
    return cut_lineage(reading_files.readings_of(_files(spark, sf)))


@query("readings_scan", with_ctes(v.READINGS, RAW, body="""
select id, ts_s, value, property, plug_id, household_id, good.house_id, line
from good join readings r using (id)""".replace("ts_s, value", "good.ts_s, good.value")))
def readings_scan(spark, sf):
    small = ("property", "plug_id", "household_id", "house_id")
    read = reading_files.readings_of(_files(spark, sf))
    return read.select("id", "ts_s", "value", *[F.col(c).cast("bigint").alias(c) for c in small], "line")


@query("readings_reject", with_ctes(v.READINGS, RAW, body="""
select 'house=' || house_id as publisher, line, case when k = 7 then 'no value' else 'missing fields' end as reject_reason
from lines where k in (5, 6, 7)"""))
def readings_reject(spark, sf):
    """Lines that are no reading, with the reason; none becomes a reading with nulls."""
    return reading_files.reading_rejects(_files(spark, sf)).select(
        F.regexp_extract("publisher_file", "(house=[^/]+)/", 1).alias("publisher"), "line", "reject_reason")


@query("readings_union", with_ctes(v.READINGS, RAW, body="""
select 'house=' || house_id as publisher, count(*) as readings, min(id) as first_id, max(id) as last_id
from good group by house_id"""))
def readings_union(spark, sf):
    folder = F.regexp_extract("publisher_file", "(house=[^/]+)/", 1)
    return reading_files.readings_of(_files(spark, sf)).groupBy(folder.alias("publisher")).agg(
        F.count(F.lit(1)).alias("readings"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


NUMBERED = "numbered as (select *, row_number() over (partition by house_id order by id) as row_no from readings)"


@query("skip_rows", with_ctes(v.READINGS, NUMBERED, body="""
select house_id, id, ts_s, row_no from numbered where row_no > 100"""))
def skip_rows(spark, sf):
    return replay.skip_rows(ad.readings(spark, sf), 100).select("house_id", "id", "ts_s", "row_no")


# Saved positions: what each publisher had sent by the middle of the month.
@query("replay_resume", with_ctes(v.READINGS, NUMBERED, body="""
, saved as (select house_id, count(*) as sent from readings where ts_s < 1705363200 group by house_id)
select n.house_id, n.id, n.row_no from numbered n left join saved s using (house_id)
where n.row_no > coalesce(s.sent, 0)""".lstrip("\n")))
def replay_resume(spark, sf):
    readings = ad.readings(spark, sf)
    saved = readings.filter("ts_s < 1705363200").groupBy("house_id").agg(F.count(F.lit(1)).alias("sent"))
    return replay.resume_after(readings, saved).select("house_id", "id", "row_no")


RUNS = """
paired as (select *, lag(ts_s) over (partition by house_id order by id) as before from readings),
starts as (select *, sum(case when before = ts_s then 0 else 1 end)
                       over (partition by house_id order by id) as run_no from paired),
runs as (select house_id, cast(run_no as bigint) as run_no, min(ts_s) as ts_s, count(*) as rows
         from starts group by house_id, run_no)
"""
SPEEDS = """
speeds as (
  select house_id, cast(floor(avg(case when run_no < n_runs then rows end)) as bigint) as speed
  from (select *, max(run_no) over (partition by house_id) as n_runs from runs)
  where run_no <= 19 group by house_id)
"""


@query("run_lengths", with_ctes(v.READINGS, RUNS, body="select house_id, run_no, ts_s, rows from runs"))
def run_lengths(spark, sf):
    return replay.run_lengths(ad.readings(spark, sf))


@query("source_speed", with_ctes(v.READINGS, RUNS, SPEEDS, body="select house_id, speed from speeds"))
def source_speed(spark, sf):
    return replay.source_speed(replay.run_lengths(ad.readings(spark, sf)))


def _long_house(readings):
    return readings.withColumn("house_id", F.col("house_id").cast("bigint"))


GAPS = f"""
gaps as (
  select house_id, arg_min(ts_s, id) as first_ts,
         cast(86400 * floor(({NOW} - arg_min(ts_s, id)) / 86400.0 + 0.5) as bigint) as gap_s
  from readings group by house_id)
"""
JITTER = f"""
printf('%.3f', abs(value + value * (cast((id % 2147483647 * 1583458089 + {SEED}) % 2147483647 as double)
                                     / 2147483647.0 * 0.2 - 0.1)))
"""


@query("replay_original", with_ctes(v.READINGS, RAW, body="select house_id, id, line from good"))
def replay_original(spark, sf):
    return replay.replay_original(_long_house(_readings(spark, sf)))


@query("day_gap", with_ctes(v.READINGS, GAPS, body="select house_id, first_ts, gap_s from gaps"))
def day_gap(spark, sf):
    return replay.day_gap(ad.readings(spark, sf), NOW)


MORE = """case when k = 8 then ',extra, "field"' else '' end"""
GOOD_GAPS = GAPS.replace("from readings", "from good")


@query("replay_date_shift", with_ctes(v.READINGS, RAW, GOOD_GAPS, body=f"""
select r.house_id, id, id || ',' || (ts_s + gap_s) || ',' || {JITTER} || ',' || rest || {MORE} as line
from good r join gaps g on g.house_id = r.house_id"""))
def replay_date_shift(spark, sf):
    return replay.replay_date_shift(_long_house(_readings(spark, sf)), NOW, SEED)


@query("value_jitter", with_ctes(v.READINGS, body=f"select id, value, {JITTER} as jittered from readings"))
def value_jitter(spark, sf):
    return ad.readings(spark, sf).select("id", "value", replay.moved_value(SEED).alias("jittered"))


SCHEDULE = f"schedule as (select *, (row_no - 1) // {SPEED} as tick from numbered)"


@query("paced_schedule", with_ctes(v.READINGS, NUMBERED, RUNS, SPEEDS, body="""
select n.house_id, n.id, n.row_no, (n.row_no - 1) // s.speed as tick
from numbered n join speeds s on s.house_id = n.house_id"""))
def paced_schedule(spark, sf):
    readings = ad.readings(spark, sf)
    speeds = replay.source_speed(replay.run_lengths(readings))
    return replay.paced_schedule(readings, speeds=speeds).select("house_id", "id", "row_no", "tick")


GOOD_SCHEDULE = f"""
schedule as (
  select *, (row_number() over (partition by house_id order by id) - 1) // {SPEED} as tick from good)
"""


@query("replay_realtime", with_ctes(v.READINGS, RAW, GOOD_SCHEDULE, body=f"""
select house_id, id, tick, id || ',' || ({NOW} + tick) || ',' || {JITTER} || ',' || rest || {MORE} as line
from schedule"""))
def replay_realtime(spark, sf):
    return replay.replay_realtime(replay.paced_schedule(_long_house(_readings(spark, sf)), SPEED), NOW, SEED)


@query("replay_progress", with_ctes(v.READINGS, NUMBERED, SCHEDULE, body="""
select house_id, tick, count(*) as speed,
       cast(sum(count(*)) over (partition by house_id order by tick) as bigint) as total
from schedule group by house_id, tick"""))
def replay_progress(spark, sf):
    return replay.replay_progress(replay.paced_schedule(ad.readings(spark, sf), SPEED))


# --- slices ----------------------------------------------------------------------------

SLICED = """
sliced as (
  select r.*, n as slice_min, ts_s // (n * 60) * (n * 60) as slice
  from readings r, (select unnest([1, 5, 10, 15, 20, 30, 60, 120]::bigint[]) as n)
  where property = 1)
"""
LOADS = """
loads as (
  select house_id, household_id, plug_id, slice_min, slice, avg(value) as load
  from sliced group by all),
households as (select house_id, household_id, slice_min, slice, sum(load) as load from loads group by all),
houses as (select house_id, slice_min, slice, sum(load) as load from households group by all)
"""


@query("slice_split", with_ctes(v.READINGS, SLICED, body="""
select id, house_id, household_id, plug_id, value, slice_min, cast(slice as bigint) as slice from sliced"""))
def slice_split(spark, sf):
    return sensors.slice_split(ad.readings(spark, sf)).select(
        "id", "house_id", "household_id", "plug_id", "value", "slice_min", "slice")


@query("slice_avg", with_ctes(v.READINGS, SLICED, LOADS, body="""
select house_id, household_id, plug_id, slice_min, cast(slice as bigint) as slice, round(load + 3.7e-10, 6) as load
from loads"""))
def slice_avg(spark, sf):
    return rounded(sensors.slice_avg(ad.readings(spark, sf)), "load")


@query("slice_sum", with_ctes(v.READINGS, SLICED, LOADS, body="""
select 'household' as level, house_id, household_id, slice_min, cast(slice as bigint) as slice,
       round(load + 3.7e-10, 6) as load from households
union all
select 'house', house_id, null, slice_min, cast(slice as bigint), round(load + 3.7e-10, 6) from houses"""))
def slice_sum(spark, sf):
    return rounded(sensors.slice_sum(sensors.slice_avg(ad.readings(spark, sf))), "load")


@query("slice_forecast", with_ctes(v.READINGS, SLICED, LOADS, body="""
, asked as (
  select house_id, slice_min, slice, load, slice + 2 * slice_min * 60 as target_slice from houses)
select a.house_id, a.slice_min, cast(a.slice as bigint) as slice, cast(a.target_slice as bigint) as target_slice,
       round(a.load + 3.7e-10, 6) as load,
       round(case when median(h.load) is null then a.load else (a.load + median(h.load)) / 2 end + 3.7e-10, 6) as forecast
from asked a left join houses h
  on h.house_id = a.house_id and h.slice_min = a.slice_min
  and h.slice % 86400 = a.target_slice % 86400 and h.slice // 86400 < a.target_slice // 86400
group by a.house_id, a.slice_min, a.slice, a.target_slice, a.load""".lstrip("\n")))
def slice_forecast(spark, sf):
    houses = sensors.slice_sum(sensors.slice_avg(ad.readings(spark, sf))).filter("level = 'house'")
    return rounded(sensors.slice_forecast(houses, ["house_id"]), "load", "forecast")
