"""Named queries and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return register


def with_ctes(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


# Results are compared at six digits. The nudge moves exact halves, which engines round
# differently, off the boundary; the SQL texts add the same value.
NUDGE = 3.7e-10


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round floating results for comparison across engines."""
    return df.select(
        *[F.round(F.col(c) + F.lit(NUDGE), 6).alias(c) if c in columns else F.col(c) for c in df.columns]
    )
