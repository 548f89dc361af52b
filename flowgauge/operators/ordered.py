"""Ordered scans that do not need a whole key in one task.

A plain window sorts all rows of a key in one task. That is right while every key is
small, and it is what happens here when a probe shows so. When the largest key has more
than ``max_rows`` rows, its rows are cut into chunks of the leading order column and the
scan runs in two levels: a window inside each (key, chunk), and a window over one summary
row per chunk that carries the state of the earlier chunks. The summary is aggregated
map-side, so the only large shuffle is the one the plain window would have needed, now on
(key, chunk).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUP_ROWS = 2_000_000
#: Hashes of keys that a probe counts first.
BUCKETS = 65_536
AUTO = "auto"


class Step(NamedTuple):
    kind: str
    value: Column


def running_sum(value: Column) -> Step:
    return Step("sum", value)


def running_count() -> Step:
    return Step("sum", F.lit(1).cast("bigint"))


def running_min(value: Column) -> Step:
    return Step("min", value)


def running_max(value: Column) -> Step:
    return Step("max", value)


def last_known(value: Column) -> Step:
    """Latest non-null value up to and including the row."""
    return Step("last", value)


def previous(value: Column) -> Step:
    """Value of the row before; null on the first row of a key."""
    return Step("previous", value)


def chunk_width(
    df: DataFrame, keys: list[str], position: str, grain: int, max_rows: int = MAX_GROUP_ROWS
) -> int | None:
    """Chunk width on ``position``, or None when every key fits in one group.

    Rows are counted by a hash of the key first: where no hash has more rows than a group
    may, no key has, and the count takes the same memory for any number of keys. Otherwise
    one aggregation over (key, grain) with map-side combine; a single row reaches the
    driver. ``peak`` guards against bursts: the width shrinks until the fullest grain of
    the fullest key fits.
    """
    hashes = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    if (hashes.agg(F.max("_n")).first()[0] or 0) <= max_rows:
        return None
    grains = df.groupBy(*keys, F.floor(F.col(position) / grain).alias("_grain")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = grains.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max("_n").alias("_peak"))
    total, peak = totals.agg(F.max("_total"), F.max("_peak")).first()
    if total is None or total <= max_rows:
        return None
    if peak <= max_rows:
        return grain * max(1, max_rows // peak)
    return max(1, grain * max_rows // peak)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    steps: dict[str, Step],
    *,
    width: int | str | None = AUTO,
    grain: int = 3600,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add one column per step, scanning each key in ascending ``order``.

    ``order[0]`` must be numeric and the order total within a key. Rows with a null key are one
    key of their own, rows with a null position come first; both ways keep every row.
    ``width`` is the chunk width if known, None for one group per key, or ``"auto"``.
    """
    if width == AUTO:
        width = chunk_width(df, keys, order[0], grain, max_rows)
    if width is None:
        return _single_level(df, keys, order, steps)
    return _two_level(df, keys, order, steps, width)


def _window_column(step: Step, frame, ordered) -> Column:
    if step.kind == "sum":
        return F.sum(step.value).over(frame)
    if step.kind == "min":
        return F.min(step.value).over(frame)
    if step.kind == "max":
        return F.max(step.value).over(frame)
    if step.kind == "last":
        return F.last(step.value, ignorenulls=True).over(frame)
    return F.lag(step.value).over(ordered)


def _single_level(df, keys, order, steps):
    ordered = Window.partitionBy(*keys).orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "*", *[_window_column(s, frame, ordered).alias(name) for name, s in steps.items()]
    )


def _two_level(df, keys, order, steps, width):
    chunked = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(width)))
    group = [*keys, "_chunk"]
    place = F.struct(*order)

    summaries, carries, merged = [], [], []
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    neighbour = Window.partitionBy(*keys).orderBy("_chunk")
    for name, step in steps.items():
        whole, carry, local = f"_whole_{name}", f"_carry_{name}", F.col(f"_local_{name}")
        if step.kind == "sum":
            summaries.append(F.sum(step.value).alias(whole))
            carries.append(F.sum(whole).over(before).alias(carry))
            both = F.when(local.isNotNull() | F.col(carry).isNotNull(),
                          F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        elif step.kind == "min":
            summaries.append(F.min(step.value).alias(whole))
            carries.append(F.min(whole).over(before).alias(carry))
            both = F.least(local, carry)
        elif step.kind == "max":
            summaries.append(F.max(step.value).alias(whole))
            carries.append(F.max(whole).over(before).alias(carry))
            both = F.greatest(local, carry)
        elif step.kind == "last":
            known = F.when(step.value.isNotNull(), place)
            summaries.append(F.max_by(step.value, known).alias(whole))
            carries.append(F.last(whole, ignorenulls=True).over(before).alias(carry))
            both = F.coalesce(local, carry)
        else:
            # wrapped, so that a null value differs from "no row before"
            summaries.append(F.max_by(F.struct(step.value.alias("v")), place).alias(whole))
            carries.append(F.lag(whole).over(neighbour).alias(carry))
            both = F.coalesce(local, F.col(carry))["v"]
        merged.append(both.alias(name))

    carried = (
        chunked.groupBy(*group).agg(*summaries).select(*group, *carries)
    )
    ordered = Window.partitionBy(*group).orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, 0)
    locals_ = [
        _window_column(
            Step(s.kind, F.struct(s.value.alias("v"))) if s.kind == "previous" else s, frame, ordered
        ).alias(f"_local_{name}")
        for name, s in steps.items()
    ]
    return _with_carried(chunked.select("*", *locals_), carried, group).select(
        *[F.col(c) for c in df.columns], *merged
    )


def _with_carried(rows, carried, group):
    """Each row with the summary of the chunks before its own; null keys and positions are
    values like any other, and null positions come first."""
    named = carried.select(*[F.col(c).alias(f"_of_{c}") for c in group],
                           *[c for c in carried.columns if c not in group])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return rows.join(named, same)


def clamped_running_sum(
    df: DataFrame, keys: list[str], order: list[str], delta: Column, name: str, **scan
) -> DataFrame:
    """Running sum that never falls below zero, without a row-by-row loop:
    ``C - min(0, lowest C so far)`` for the unclamped running sum ``C``."""
    if scan.get("width", AUTO) == AUTO:
        scan["width"] = chunk_width(
            df, keys, order[0], scan.get("grain", 3600), scan.get("max_rows", MAX_GROUP_ROWS)
        )
    if scan["width"] is None:
        summed = ordered_scan(df, keys, order, {"_c": running_sum(delta)}, width=None)
        lowest = ordered_scan(summed, keys, order, {"_low": running_min(F.col("_c"))}, width=None)
    else:
        lowest = _two_level_sum_and_low(df, keys, order, delta, scan["width"])
    return lowest.withColumn(
        name, F.col("_c") - F.least(F.lit(0).cast("bigint"), F.col("_low"))
    ).drop("_c", "_low")


def _two_level_sum_and_low(df, keys, order, delta, width):
    """Running sum ``_c`` and its running minimum ``_low`` with one summary row per chunk:
    the chunk's total and the lowest point of its own running sum."""
    group = [*keys, "_chunk"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(width)))
        .withColumn("_delta", delta)
        .withColumn("_lc", F.sum("_delta").over(inside))
        .withColumn("_ll", F.min("_lc").over(inside))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy(*group).agg(F.sum("_delta").alias("_total"), F.min("_lc").alias("_dip"))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_base") + F.col("_dip")).over(before))
        .select(*group, "_base", "_floor")
    )
    return _with_carried(local, carried, group).select(
        *[F.col(c) for c in df.columns],
        (F.col("_base") + F.col("_lc")).alias("_c"),
        F.least("_floor", F.col("_base") + F.col("_ll")).alias("_low"),
    )


def trailing_window(
    df: DataFrame, keys: list[str], position: str, span: int, aggregates: dict[str, Column]
) -> DataFrame:
    """Aggregate over ``[position - span, position]`` for each row, closed at both ends.

    Rows are grouped by (key, span-wide chunk) and copied once into the following chunk,
    so a group never holds more than two spans of a key.
    """
    own = F.floor(F.col(position) / F.lit(span))
    copies = df.withColumn(
        "_copy", F.explode(F.array(F.lit(0), F.lit(1)))
    ).withColumn("_chunk", own + F.col("_copy"))
    window = (
        Window.partitionBy(*keys, "_chunk").orderBy(position).rangeBetween(-span, 0)
    )
    return (
        copies.select("*", *[agg.over(window).alias(name) for name, agg in aggregates.items()])
        .filter(F.col("_copy") == 0)
        .drop("_copy", "_chunk")
    )
