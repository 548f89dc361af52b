"""From raw documents to packed token sequences.

Each stage calls one operator, is written, and is read again as the next one's documents. All
but the last return the columns of the documents:

1. quality rules: documents that fail the base rules or lie far out are dropped;
2. toxicity: documents predicted toxic are dropped;
3. near-duplicates: of each group the document with the smallest doc_id stays;
4. secret scans: every span found is masked in the text, and n_chars follows;
5. packing: the last stage gives the pieces with their token ids, sequences and offsets.

Rows that repeat a doc_id are judged each by their own text in stages 1, 2 and 4; in stage 3
such rows are one document, of which one row stays, any of them. Rows without doc_id are never
near-duplicates. The first two stages keep further columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm import minhash, packing, quality, secrets, toxicity
from flowgauge.llm.common import few, table, written

ORACLE_SQL = None  # no SQL for the first two stages; tests/llm checks the stages, not yet every row by brute force
WIDTH = 5  # words of a shingle


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with column names of no meaning, so that an operator's own columns meet none of them."""
    names = {c: f"__column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _named(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = _renamed(docs)
    judged = quality.judged(plain, (names["lang"], names["source"]), names["text"], keep=True)
    return _named(judged.where("kept"), names)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights, bias = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    plain, names = _renamed(docs)
    return _named(toxicity.score(plain, weights, bias, names["text"], keep=True).where("score < 0.5"), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, WIDTH).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    key = F.col("doc_id").cast("long")
    left = docs.join(few(written(gone, "gone")), key == F.col("__id"), "left_anti")
    twice = docs.groupBy(key.alias("__id")).count().where("__id is not null and count > 1").select("__id")
    twice = few(written(twice, "repeated"))
    same = key == F.col("__id")
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
