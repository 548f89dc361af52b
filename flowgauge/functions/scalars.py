"""Scalar expressions. All are built-in Spark expressions; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the multiplicative sequence behind `unit_value`: a prime modulus and a
# multiplier with good equidistribution.
UNIT_MODULUS = 2147483647
UNIT_MULTIPLIER = 1583458089

DECISION_DIGITS = 9


def stable(value: Column) -> Column:
    """Round a floating sum so that a rerun that adds in another order decides alike."""
    return F.round(value, DECISION_DIGITS)


def holds(condition: Column) -> Column:
    """A condition that is false, not null, when an operand is missing."""
    return F.coalesce(condition, F.lit(False))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight), null when the weights sum to 0."""
    return stable(F.try_divide(F.sum(value * weight), F.sum(weight)))


def anchored(column: Column, pattern: str) -> Column:
    """Regex match over the whole value; ``rlike`` alone would search inside it."""
    return column.rlike(f"^(?:{pattern})$")


def half_up(value: Column) -> Column:
    """Nearest integer with halves towards +infinity (-2.5 gives -2)."""
    return F.floor(value + F.lit(0.5))


def unit_value(key: Column, seed: int) -> Column:
    """Repeatable value in [0, 1) for an integer key."""
    mixed = F.pmod(F.pmod(key, F.lit(UNIT_MODULUS)) * F.lit(UNIT_MULTIPLIER) + F.lit(seed),
                   F.lit(UNIT_MODULUS))
    return mixed.cast("double") / F.lit(float(UNIT_MODULUS))


def jittered(value: Column, unit: Column, spread: float = 0.1) -> Column:
    """Value moved by up to +-spread, made positive, as text with three decimals."""
    moved = F.abs(value + value * (unit * F.lit(2 * spread) - F.lit(spread)))
    return F.format_string("%.3f", moved)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
