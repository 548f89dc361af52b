"""Joins of a large table with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.session import cut_lineage

BROADCAST_ROWS = 200_000
SALTS = 64


def attach(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the columns of ``small`` to ``big`` without shuffling a hot key into one task.

    ``small`` is written once and counted. Up to ``broadcast_rows`` rows it is broadcast.
    Beyond that every key of ``big`` is spread over salts, by a column that differs within a
    key, and ``small`` is repeated per salt.
    """
    small = cut_lineage(small)
    if small.count() <= broadcast_rows:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
