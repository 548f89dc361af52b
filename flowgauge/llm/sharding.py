"""Sharding by rendezvous hashing of record keys over weighted shards.

Every shard draws a number from the key and its own name; the largest draw, scaled by the
shard's weight, takes the record. A further shard changes no draw of the others, so it only
takes the records that it wins itself. Law: ``key``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import written

LAW = "key"


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that takes ``key``; a null key is a key of its own."""
    if not any(weight > 0 for weight in weights):
        raise ValueError("no shard has a weight")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            low = F.xxhash64(F.lit(f"shard-{shard}"), key, key.isNull()).bitwiseAND(F.lit((1 << 53) - 1))
            score = F.lit(float(weight)) / -F.log((low + F.lit(0.5)) / F.lit(float(1 << 53)))
            draws.append(F.struct(score.alias("score"), F.lit(-shard).alias("back")))
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["back"]).cast("int")


def with_slots(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with a slot for each, gapless from 0 within ``group``.

    No task sees a whole group: rows are numbered within (group, task that made them), and
    tasks' counts are summed. The rows are written first, so that the numbers stay.
    """
    held = written(rows.withColumn("__task", F.spark_partition_id()), "slots")
    counts = held.groupBy(group, "__task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(group, "__task").orderBy(*order)
    numbered = held.withColumn("__n", F.row_number().over(within) - 1)
    joined = numbered.join(base, [group, "__task"])
    return joined.select(*rows.columns, (F.col("__n") + F.col("base")).cast("long").alias("slot"))


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, added: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the text's UTF-8 bytes plus 1; a null text has none. grown_shard is the shard after
    one more of weight ``added`` has come. Rows with the same doc_id, and those without one, share
    a shard; repeated rows have slots of their own. Other columns play no part.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.lit(LAW).alias("law"), shard_of(key, weights).alias("shard"), shard_of(key, [*weights, added]).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * 8) -> None:
    """Write every row, with all its columns, below the folder of its shard."""
    docs.withColumn("shard", shard_of(F.col("doc_id").cast("long"), weights)).write.partitionBy("shard").parquet(path)
