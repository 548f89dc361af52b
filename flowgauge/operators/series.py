"""Labelled metric samples evaluated on a step grid.

Every evaluation first aggregates the raw samples to (series, bucket), map-side, where a
bucket is the largest span that divides both window and step. Only the buckets are then
spread over the steps whose window holds them. A series with a large share of the samples
therefore costs no more after the first partial aggregation than any other.

A window at step t is closed at both ends, ``[t - window, t]``. Bucket j holds the samples
in ``((j - 1) * g, j * g]``; a sample exactly on a bucket's end is also the closed left end
of the window that starts there, and is passed on separately.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import anchored
from flowgauge.operators.ordered import AUTO, ordered_scan, previous

MICROS = 1_000_000


def fingerprint(labels: Column) -> Column:
    """Canonical text of a label set, ``name=value`` by name."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def select_series(
    samples: DataFrame,
    metric: str | list[str],
    equals: dict[str, str] | None = None,
    matches: dict[str, str] | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Samples of a metric by label equality and anchored label regex.

    Returns (metric, series, *by, ts, us, value); ``by`` names labels wanted as columns.
    """
    metrics = [metric] if isinstance(metric, str) else metric
    kept = samples.filter(F.col("metric").isin(*metrics))
    for label, wanted in (equals or {}).items():
        kept = kept.filter(F.col("labels")[label] == wanted)
    for label, pattern in (matches or {}).items():
        kept = kept.filter(anchored(F.col("labels")[label], pattern))
    return kept.select(
        "metric", fingerprint(F.col("labels")).alias("series"),
        *[F.col("labels")[label].alias(label) for label in by],
        "ts", F.unix_micros(F.col("ts")).alias("us"), "value",
    )


class Grid:
    """Evaluation times ``start, start + step, ..., end`` (epoch seconds, multiples of step)
    with a trailing window."""

    def __init__(self, start: int, end: int, step: int, window: int):
        self.start, self.end, self.step, self.window = start, end, step, window
        self.span = gcd(step, window)
        self.per_window, self.per_step = window // self.span, step // self.span

    def clip(self, df: DataFrame) -> DataFrame:
        """Samples any window can hold; the filter on ``ts`` reaches the scan."""
        first, last = (F.timestamp_seconds(F.lit(s)) for s in (self.start - self.window, self.end))
        return df.filter(F.col("ts").between(first, last))

    def bucket(self) -> Column:
        return F.ceil(F.col("us") / (self.span * MICROS))

    def on_edge(self) -> Column:
        return F.col("us") % (self.span * MICROS) == 0

    def steps_of(self, bucket: Column) -> Column:
        """Step numbers whose window holds the whole bucket."""
        first = F.greatest(F.ceil(bucket / self.per_step), F.lit(-(-self.start // self.step)))
        last = F.least(
            F.floor((bucket + (self.per_window - 1)) / self.per_step), F.lit(self.end // self.step)
        )
        return F.when(first <= last, F.sequence(first, last)).otherwise(
            F.expr("cast(array() as array<bigint>)")
        )

    def step_at_edge(self, bucket: Column) -> Column:
        """Number of the step whose window starts exactly at the bucket's end, or null."""
        at = bucket + self.per_window
        number = F.floor(at / self.per_step)
        inside = (at % self.per_step == 0) & number.between(
            -(-self.start // self.step), self.end // self.step
        )
        return F.when(inside, number)

    def spread(self, buckets: DataFrame, whole: Column, edge: Column | None, has_edge: Column) -> DataFrame:
        """One row (``step`` and the fields of ``whole`` / ``edge``) per bucket and step."""
        rows = F.transform(
            self.steps_of(F.col("bucket")), lambda k: F.struct(k.alias("k"), whole.alias("v"))
        )
        if edge is not None:
            at = self.step_at_edge(F.col("bucket"))
            extra = F.filter(
                F.array(F.struct(at.alias("k"), edge.alias("v"))),
                lambda e: e["k"].isNotNull() & has_edge,
            )
            rows = F.concat(rows, extra)
        return buckets.withColumn("_e", F.explode(rows)).select(
            *[c for c in buckets.columns if c != "bucket" and not c.startswith("_")],
            (F.col("_e.k") * self.step).alias("step"), "_e.v.*",
        )


def grid_over(times: DataFrame, step: int, window: int, column: str = "ts") -> Grid:
    """The grid over all times of a table: from the last step at or before the earliest to the first at
    or after the latest. An empty table has the one step 0."""
    at = F.unix_micros(F.col(column).cast("timestamp"))
    low, high = (x or 0 for x in times.agg(F.min(at), F.max(at)).first())
    wide = step * MICROS
    return Grid(low // wide * step, -(-high // wide) * step, step, window)


def avg_over_time(selected: DataFrame, grid: Grid, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Mean of each series' samples in the trailing window."""
    edge = grid.on_edge()
    buckets = (
        grid.clip(selected).withColumn("bucket", grid.bucket()).groupBy(*keys, "bucket").agg(
            F.sum("value").alias("_s"), F.count("value").alias("_n"),
            F.sum(F.when(edge, F.col("value"))).alias("_es"), F.count_if(edge).alias("_en"),
        )
    )
    pair = lambda s, n: F.struct(F.col(s).alias("s"), F.col(n).alias("n"))
    return (
        grid.spread(buckets, pair("_s", "_n"), pair("_es", "_en"), F.col("_en") > 0)
        .groupBy(*keys, "step")
        .agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))
    )


def instant_vector(selected: DataFrame, grid: Grid, keys: tuple[str, ...] = ("series",)) -> DataFrame:
    """Latest sample of each series at each step, no older than the grid's window."""
    buckets = (
        grid.clip(selected).withColumn("bucket", grid.bucket()).groupBy(*keys, "bucket")
        .agg(F.max(F.struct("us", "value")).alias("_last"))
    )
    last = F.struct(F.col("_last.us").alias("us"), F.col("_last.value").alias("value"))
    on_edge = F.col("_last.us") % (grid.span * MICROS) == 0
    return (
        grid.spread(buckets, last, last, on_edge)
        .groupBy(*keys, "step")
        .agg(F.max(F.struct("us", "value"))["value"].alias("value"))
    )


def counter_rate(
    selected: DataFrame, grid: Grid, keys: tuple[str, ...] = ("series",), width: int | str | None = AUTO
) -> DataFrame:
    """Per-second rate of a counter: increase, corrected for resets, divided by the time
    between the first and the last sample in the window. Needs two samples.

    A step between two samples belongs to a window that holds both. Inside a bucket that
    is always so; the step that enters a bucket counts if its older end is in the window.
    """
    paired = ordered_scan(
        grid.clip(selected), list(keys), ["us", "value"],
        {"_pus": previous(F.col("us")), "_pv": previous(F.col("value"))},
        width=width, grain=3600 * MICROS,
    )
    gain = F.when(F.col("value") < F.col("_pv"), F.col("value")).otherwise(F.col("value") - F.col("_pv"))
    entering = F.ceil(F.col("_pus") / (grid.span * MICROS)) < grid.bucket()
    buckets = (
        paired.withColumn("bucket", grid.bucket()).withColumn("_gain", gain)
        .withColumn("_enters", entering)
        .groupBy(*keys, "bucket")
        .agg(
            F.sum(F.when(~F.col("_enters"), F.col("_gain"))).alias("_inner"),
            F.max(F.when(F.col("_enters"), F.col("_gain"))).alias("_entry"),
            F.max(F.when(F.col("_enters"), F.col("_pus"))).alias("_from"),
            F.min("us").alias("_first"), F.max("us").alias("_last"),
        )
    )
    whole = F.struct(*[F.col(f"_{n}").alias(n) for n in ("inner", "entry", "from", "first", "last")])
    spread = grid.spread(buckets, whole, None, F.lit(False))
    counts = F.coalesce(F.col("from") >= (F.col("step") - grid.window) * MICROS, F.lit(False))
    merged = spread.groupBy(*keys, "step").agg(
        F.sum(F.coalesce("inner", F.lit(0.0)) + F.when(counts, F.col("entry")).otherwise(0.0)).alias("_gain"),
        F.min(F.when(counts, F.col("from")).otherwise(F.col("first"))).alias("_first"),
        F.max("last").alias("_last"),
    )
    return merged.filter("_last > _first").select(
        *keys, "step", (F.col("_gain") / ((F.col("_last") - F.col("_first")) / MICROS)).alias("value")
    )


def sum_by(vector: DataFrame, *labels: str) -> DataFrame:
    return vector.groupBy(*labels, "step").agg(F.sum("value").alias("value"))


def avg_by(vector: DataFrame, *labels: str) -> DataFrame:
    """Mean over series, each counted once whatever its number of samples."""
    return vector.groupBy(*labels, "step").agg(F.avg("value").alias("value"))


def first_series(vector: DataFrame, *keys: str) -> DataFrame:
    """One series per step: the one with the lowest fingerprint."""
    return vector.groupBy(*keys, "step").agg(
        F.min("series").alias("series"), F.min_by("value", "series").alias("value")
    )
