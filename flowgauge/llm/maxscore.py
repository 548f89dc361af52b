"""Exact best inner products by MaxScore over shards of integer vectors.

A dimension is a term; its postings are the vectors whose component has the sign of the
query's, as only those add to a score. A term's bound is the largest amount it can add within
the shard. By falling bound, the last terms whose bounds sum to less than the k-th best score
so far are non-essential: no vector found in them alone can get into the result, and a query
without essential terms passes the shard by. The essential terms of all queries of a block, and of
the others the larger ones, are scored by one product, which leaves out each query's last terms;
those are probed for a vector only while its score plus the bounds that are left reaches the threshold.

Vectors stay where they lie. A task cuts its own into shards, reads the queries from the shared
folder block by block for each, and carries every query's k best from shard to shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import filesystem, written
from flowgauge.session import dealt, scratch_path

SHARD, BLOCK, STEP = 32768, 128, 8
#: Most numbers of a shard or block, and of exact Python integers at once.
CELLS, WIDE = 1 << 21, 1 << 17
#: Most places (queries times k) that a task keeps.
PLACES = 1_000_000
#: Most pairs that are probed at once.
PAIRS = 1 << 17
#: Bounds of at most this part (one in so many) of the threshold are left to probes.
PART = 16
#: Sums of integers below are exact, in doubles and in single floats.
EXACT, SINGLE = float(1 << 53), float(1 << 24)
LONG = 2**63 - 1


class Best:
    """The k best (vec_id, score) so far for each query of a block, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.of, self.found, self.scores = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf, object)  # the k-th best score, and its vec_id
        self.last = np.full(len(ids), LONG)

    def add(self, of: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        of = np.concatenate([self.of, of.astype(np.int32)])
        found, scores = np.concatenate([self.found, found]), np.concatenate([self.scores, scores])
        falling = -scores if scores.dtype != object else -np.unique(scores, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((found, falling, of))
        of = of[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        order, of, place = order[place < self.k], of[place < self.k], place[place < self.k]
        self.of, self.found, self.scores = of, found[order], scores[order]
        full = place == self.k - 1
        self.least[of[full]], self.last[of[full]] = self.scores[full], self.found[full]


class Shard:
    """Vectors of one shard as rows, with the bounds of both signs of each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.high = np.maximum(rows.max(axis=0, initial=0), 0)
        self.low = np.maximum((-rows).max(axis=0, initial=0), 0)
        self.top, self.norm = _top(rows), _norm(rows)
        self.single = rows.astype(np.float32) if rows.dtype == float and self.norm < SINGLE else None

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Enters into ``best`` what of this shard is among the k best; a query's own id is left out."""
        width = min(queries.shape[1], self.rows.shape[1])
        queries, rows = queries[:, :width], self.rows[:, :width]
        if rows.dtype == float and queries.dtype == float and _top(queries) * self.top * width < EXACT:
            least = best.least.astype(float)
            # no sum of some of a score's parts is larger than the product of the norms
            if self.single is not None and self.norm * _norm(queries) < SINGLE:
                rows, queries = self.single[:, :width], queries.astype(np.float32)
        else:
            most = max(1, WIDE // max(width, len(queries)))
            if len(rows) > most or rows.dtype != object:
                for at in range(0, len(rows), most):
                    part = Shard(self.ids[at : at + most], _integers(self.rows[at : at + most]))
                    part.search(_integers(queries), best)
                return
            queries, least = _integers(queries), best.least
        kind = object if rows.dtype == object else float
        bound = np.where(queries > 0, queries * self.high[:width].astype(kind), -queries * self.low[:width].astype(kind))
        terms = np.argsort(-bound.astype(float), axis=1, kind="stable")
        bound = np.take_along_axis(bound, terms, 1)
        left = np.zeros((len(queries), width + 1), kind)  # bounds of this term and all after it
        left[:, :-1] = np.cumsum(bound[:, ::-1], axis=1)[:, ::-1]
        asked = np.flatnonzero(left[:, 0] >= least)  # the others have no essential term
        if not len(asked):
            return
        queries, terms, left, least = queries[asked], terms[asked], left[asked], least[asked]
        # the essential terms, and those after them until the bounds left are a small part of the threshold
        first = np.where(least > 0, (PART * left > least[:, None]).sum(axis=1), width).clip(0, width)
        rank = np.empty_like(terms)
        np.put_along_axis(rank, terms, np.arange(width)[None, :], 1)
        weights = np.where(rank < first[:, None], queries, queries.dtype.type(0) if kind is float else 0)
        used = np.flatnonzero((weights != 0).any(axis=0))
        scores = weights @ rows.T if 2 * len(used) > width else weights[:, used] @ rows[:, used].T
        need = least - left[np.arange(len(asked)), first]
        near = np.flatnonzero(scores >= need[:, None].astype(scores.dtype))
        terms = np.hstack([terms, np.full((len(asked), STEP), width)])  # no term, of weight 0
        queries = np.hstack([queries, np.zeros((len(asked), STEP), queries.dtype)])
        for at in range(0, len(near), PAIRS):
            of, row = np.divmod(near[at : at + PAIRS], len(rows))
            other = self.ids[row] != best.ids[asked[of]]
            of, row = of[other], row[other]
            score, done = scores[of, row], first[of]
            while len(of) and done.min() < width:
                now = terms[of[:, None], done[:, None].clip(0, width) + np.arange(STEP)]
                score = score + (queries[of[:, None], now] * rows[row[:, None], now.clip(0, width - 1)]).sum(axis=1)
                done = np.minimum(done + STEP, width)
                kept = score + left[of, done] >= least[of]
                of, row, score, done = of[kept], row[kept], score[kept], done[kept]
            score = score if kind is object else score.astype(np.int64)
            better = (score > best.least[asked[of]]) | (score == best.least[asked[of]]) & (self.ids[row] < best.last[asked[of]])
            if better.any():
                best.add(asked[of[better]], self.ids[row[better]], score[better])


def _top(rows: np.ndarray) -> float:
    return float(np.abs(rows).max(initial=0))


def _norm(rows: np.ndarray) -> float:
    """The largest length of a row, or slightly more."""
    rows = rows.astype(float)
    return 1.001 * float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _integers(rows: np.ndarray) -> np.ndarray:
    """Python's own integers, for sums that could pass 2**53."""
    return rows if rows.dtype == object else rows.astype(np.int64).astype(object)


def _matrices(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as rows, shorter ones filled with zeros; exact integers in doubles. Those with
    products that could pass 2**53 come apart, as Python's own integers. A query may have no id."""
    ids = np.concatenate([np.array(b.column(0).to_pylist(), object) if b.column(0).null_count
                          else b.column(0).to_numpy() for b in batches])
    flat = np.concatenate([b.column(1).flatten().to_numpy() for b in batches])
    lengths = np.concatenate([pc.list_value_length(b.column(1)).to_numpy() for b in batches])
    rows = np.zeros((len(ids), max(1, int(lengths.max(initial=0)))), np.int64)
    rows[np.arange(rows.shape[1])[None, :] < lengths[:, None]] = flat
    most = int((EXACT / rows.shape[1]) ** 0.5) - 1
    large = (rows > most).any(axis=1) | (rows < -most).any(axis=1)
    if not large.all():
        yield (ids[~large], rows[~large].astype(float)) if large.any() else (ids, rows.astype(float))
    if large.any():
        yield ids[large], rows[large].astype(object)


def _tables(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """``batches`` (vec_id, v) cut and put together to about ``size`` rows, then eight times as many up
    to ``most``, with at most ``CELLS`` numbers where short vectors are filled, but for a single longer one."""
    held, count, width = [], 0, 1
    for batch in batches:
        while batch.num_rows:
            wide = np.maximum.accumulate(np.maximum(pc.list_value_length(batch.column(1)).to_numpy(), width))
            rows = count + 1 + np.arange(batch.num_rows)
            fits = (rows <= size) & (rows * wide.astype(np.int64) <= CELLS) | (rows == 1)
            taken = batch.num_rows if fits.all() else int(fits.argmin())
            if taken:
                held.append(batch.slice(0, taken))
                count, width = count + taken, int(wide[taken - 1])
            batch = batch.slice(taken)
            if batch.num_rows:
                yield held
                held, count, width, size = [], 0, 1, min(8 * size, most)
    if held:
        yield held


def _asked(uri: str, part: int, parts: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries of every ``parts``-th file of a folder, block by block, always in the same order."""
    from pyarrow import fs

    system, path = filesystem(uri)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-"))
    for name in files[part::parts]:
        with system.open_input_file(name) as source:
            batches = pq.ParquetFile(source).iter_batches(block, columns=["vec_id", "v"], use_threads=False)
            for table in _tables(batches, block, block):
                yield from _matrices(table)


def sortable(score: int) -> str | None:
    """A text that sorts as ``score`` does among scores beyond a long on the same side; others need none."""
    return None if -LONG - 1 < score < LONG else f"{score + (1 << 255):064x}"


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) for every component, or the nearest long where that is
    none; rows without vec_id or vector, or with a component that is null or not finite, are left
    out, repeated rows count once."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return (rows.where("vec_id is not null and embedding is not null").where(fine)
            .select(F.col("vec_id").cast("long"), v.alias("v")).distinct())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of ``vectors``, all if there are fewer.

    Both have vec_id and v. A shorter vector has zeros at its end. Rows with the query's own id
    are no candidates. Scores beyond a long are ranked by their exact values and returned as the
    nearest long. Neither side is copied by Spark: tasks read the queries as files, one pass over
    the vectors for every ``PLACES`` of them, and return k rows a query.
    """
    vectors = written(vectors.select("vec_id", "v"), "vectors")
    vectors = dealt(vectors, vectors.count(), "vec_id", "v")
    queries = written(queries.select("vec_id", "v"), "queries")
    parts = max(1, -(-queries.count() * k // PLACES))
    path = scratch_path(queries.sparkSession, "asked")
    queries.repartition(parts).write.parquet(path)
    size, most, block = min(SHARD, max(64, 4 * k)), SHARD, BLOCK

    def searched(part: int) -> DataFrame:
        def run(batches):
            kept: list[Best] = []
            for table in _tables(batches, size, most):
                shards = [Shard(*m) for m in _matrices(table)]
                for n, (ids, wanted) in enumerate(_asked(path, part, parts, block)):
                    if n == len(kept):
                        kept.append(Best(ids, k))
                    for shard in shards:
                        shard.search(wanted, kept[n])
            for best in kept:
                exact = [sortable(s) for s in best.scores] if best.scores.dtype == object else pa.nulls(len(best.of), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best.ids[best.of], pa.int64()), pa.array(best.found), pa.array(best.scores.clip(-LONG - 1, LONG).astype(np.int64)),
                     pa.array(exact, pa.string())], ["query_id", "vec_id", "score", "exact"])

        return vectors.mapInArrow(run, "query_id long, vec_id long, score long, exact string")

    found = searched(0)
    for part in range(1, parts):
        found = found.unionByName(searched(part))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
