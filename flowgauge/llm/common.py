"""Helpers shared by the operators: scratch tables, shared files, Arrow batches, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
ROW_ID = "__row"
#: Most keys that are broadcast (two longs each, so 32 MB at most); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


#: Most bytes of an Arrow batch on its way to Python, but for a single longer row.
BATCH_BYTES = 2_000_000
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Makes the session cut Arrow batches by bytes, so that the memory of a task that works on
    texts does not depend on how long they are. A smaller setting of the user's own stays."""
    own = spark.conf.get(BATCH_SETTING)
    if not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read with pruned columns,
    and safe from the loss of executors."""
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, limit: int = BROADCAST_KEYS, parts: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small, else marked as too large for it.
    ``parts`` is how many entries an array of a row holds; they count like rows."""
    held = F.count(F.lit(1)) if parts is None else F.count(F.lit(1)) + F.coalesce(F.sum(parts), F.lit(0))
    if df.agg(held).first()[0] <= limit:
        return F.broadcast(df)
    return df if parts is None else df.hint("merge")


def filesystem(uri: str):
    """The pyarrow filesystem and path of a shared location, for tasks that write files themselves."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class SharedFile:
    """A file that a task writes under a name of this attempt; ``keep`` gives it its own name in
    one step, so that a task that is run again or twice leaves one whole file."""

    def __init__(self, uri: str):
        self.uri = uri
        self.system, self.path = filesystem(uri)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.attempt, compression=None)

    def keep(self) -> str:
        self.out.close()
        self.system.move(self.attempt, self.path)
        return self.uri


def in_slices(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes; a longer text is a part of its own."""
    sizes = batch.column(text)
    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n) + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the smallest node that is reachable.

    Each round points every node to its smallest neighbour, follows the pointers to their ends
    and puts the ends in place of the nodes, so that the edges of a settled component are gone in
    the next round. A node that is an end without followers has a smaller neighbour one round
    later, so two rounds at least halve the nodes. Every round is a written table. Nulls link nothing.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    edges, maps = written(_apart(edges), "edges"), []
    while edges.limit(1).count():
        if len(maps) == rounds:
            raise RuntimeError("components did not settle")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        ends = _ends(written(near.select("node", F.least("node", "m").alias("component")), "labels"))
        maps.append(ends)
        edges = written(_apart(relabelled(relabelled(edges, "u", ends), "v", ends)), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    whole = maps.pop()
    while maps:
        whole = relabelled(maps.pop(), "component", whole)
    return written(whole, "components")


def _apart(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end first, without loops."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def relabelled(rows: DataFrame, column: str, label: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its component where ``label`` (node, component) has one."""
    to = label.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    found = rows.join(few(to), F.col(column) == F.col("__node"), "left")
    return found.withColumn(column, F.coalesce("__component", column)).drop("__node", "__component")


def _ends(label: DataFrame) -> DataFrame:
    """``label`` (node, component) with every chain of components followed to its end, by doubling."""
    while True:
        twice = relabelled(label.withColumn("was", F.col("component")), "component", label)
        twice = written(twice, "labels")
        if not twice.where("component <> was").limit(1).count():
            return label
        label = twice.drop("was")
