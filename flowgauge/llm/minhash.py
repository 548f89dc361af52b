"""Near-duplicates by b-bit MinHash.

Of each document's shingle set, k minima are taken. Bands of whole minima give candidates;
what is kept for comparing is the lowest b bits of each minimum, packed into longs. Two packed
signatures are compared by counting equal b-bit fields, and the count is corrected for the
fields that agree by chance (1 in 2**b). Candidates that pass are confirmed on full sets.

Equal sets are one class first. Members of a band bucket are not paired with each other:
each is paired with a member drawn as the bucket's centre, which is another one in every
bucket. Only what is then still outside a bucket's largest component is compared with all its
members, block by block inside tasks, so that no pairs become rows.

With 32 bands of 5 minima a pair of similarity 0.8 misses all bands with probability 3e-6,
and the estimate is at least 5 standard deviations above its limit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import components, few, in_slices, relabelled, written
from flowgauge.llm.words import as_bytes, mixed, shingles, word_hashes

BANDS, ROWS, BITS = 32, 5, 2
MINIMA = BANDS * ROWS
#: Longs of one bit plane: the minima's bits, then zeros.
PLANE = -(-MINIMA // 64)
#: How far below the wanted similarity an estimate may lie.
MARGIN = 0.2
_rng = np.random.default_rng(20240501)
FLIP = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]
ODD = (_rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def minima(distinct: np.ndarray) -> np.ndarray:
    """The k smallest images of a set of 64-bit hashes, 32 bits each."""
    low = np.full((MINIMA, 1), 2**32 - 1, np.uint32)
    short = (distinct >> np.uint64(32)).astype(np.uint32)[None, :]
    for at in range(0, short.shape[1], 512):
        np.minimum(low, ((short[:, at : at + 512] ^ FLIP) * ODD).min(axis=1, keepdims=True), out=low)
    return low[:, 0]


def packed(low: np.ndarray) -> np.ndarray:
    """The lowest bits of every minimum as planes of ``PLANE`` longs, one plane for each bit."""
    field = low ^ (low >> np.uint32(16))
    planes = np.zeros((BITS, PLANE * 64), np.uint8)
    for b in range(BITS):
        planes[b, :MINIMA] = (field >> np.uint32(b)) & np.uint32(1)
    return np.packbits(planes).view(np.int64)


def set_hash(distinct: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    spread = mixed(distinct ^ np.uint64(0x5851F42D4C957F2D))
    return int(spread.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(distinct).view(np.int64))


def _signatures(width: int):
    salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                hashes, bounds = word_hashes(as_bytes(part.column("text")), lower=True)
                out = ([], [], [], [], [])
                for i in range(part.num_rows):
                    own = shingles(hashes[bounds[i] : bounds[i + 1]], width)
                    a, b, bands, bits = 0, 0, None, None
                    if len(own):
                        a, b = set_hash(own)
                        low = minima(own)
                        bits = packed(low)
                        keys = salt.copy()
                        for row in low.reshape(BANDS, ROWS).T:
                            keys = mixed(keys + row)
                        bands = keys.view(np.int64)
                    for column, value in zip(out, (len(own), a, b, bands, bits)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]),
                     *(pa.array(c, pa.list_(pa.int64())) for c in out[3:])],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                hashes, bounds = word_hashes(as_bytes(part.column("text")), lower=True)
                own = [shingles(hashes[bounds[i] : bounds[i + 1]], width) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()),
                     pa.array([set_hash(s)[0] if len(s) else 0 for s in own], pa.int64()),
                     pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["id", "set_a", "members"])

    return run


def estimate(left, right):
    """Similarity from two packed signatures: equal fields, less those equal by chance."""
    differ = F.lit(0)
    for i in range(PLANE):
        apart = [left[b * PLANE + i].bitwiseXOR(right[b * PLANE + i]) for b in range(BITS)]
        differ = differ + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), apart))
    agree = F.lit(1.0) - differ / F.lit(float(MINIMA))
    return (agree - F.lit(2.0**-BITS)) / F.lit(1 - 2.0**-BITS)


def _sets_of(members: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, set_a, members): the full sets of bucket members, from a second reading of the texts."""
    ends = written(members.select("id", "set_a").distinct(), "minhash-ends")
    wanted = few(ends.select(F.col("id").alias("doc_id")).distinct())
    found = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(width), "id long, set_a long, members array<long>")
    return written(found.join(few(ends), ["id", "set_a"], "left_semi").dropDuplicates(["id", "set_a"]), "minhash-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, u_set, v, v_set) whose full sets are similar enough, as (u, v)."""

    def of(end: str) -> DataFrame:
        return sets.select(F.col("id").alias(end), F.col("set_a").alias(f"{end}_set"), F.col("members").alias(f"{end}_members"))

    both = pairs.join(of("u"), ["u", "u_set"]).join(of("v"), ["v", "v_set"])
    common = F.size(F.array_intersect("u_members", "v_members")).cast("long")
    union = F.size("u_members") + F.size("v_members") - F.col("common")
    return both.withColumn("common", common).where(F.col("common") * 100 >= union * percent).select("u", "v")


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands, bits) of every row; bands and bits are null
    without words."""
    return docs.select("doc_id", "text").mapInArrow(_signatures(width), SIGNATURE)


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id, set_a, bits, size) for the band buckets with more than one set; of buckets with
    the same members only one."""
    rows = classes.select("id", "set_a", F.explode("bands").alias("key"))
    kept = (rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "set_a")).alias("x"),
                                    F.bit_xor(F.xxhash64("set_a", "id")).alias("y"))
            .where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")))
    named = classes.select("id", "set_a", "bits", F.col("n_shingles").alias("size"))
    return rows.join(kept.select("key"), "key").join(named, ["id", "set_a"])


def _with_centres(rows: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket paired with the one drawn from those outside the main component,
    if their components differ and size and estimate allow the similarity; no pair twice."""
    drawn = F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "set_a", "bits", "size", "component"))
    centres = rows.where("component <> main").groupBy("key").agg(drawn.alias("c")).select("key", "c.*")
    left, right = rows.alias("left"), centres.alias("right")
    sizes = [F.col("left.size"), F.col("right.size")]
    near = (estimate(F.col("left.bits"), F.col("right.bits")) >= percent / 100 - MARGIN) & (
        F.least(*sizes) * 100 >= F.greatest(*sizes) * percent)
    both = left.join(right, (F.col("left.key") == F.col("right.key")) & (F.col("left.component") != F.col("right.component")) & near)
    u, v = F.struct("left.id", "left.set_a"), F.struct("right.id", "right.set_a")
    ends = both.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    return ends.select(F.col("a.id").alias("u"), F.col("a.set_a").alias("u_set"),
                       F.col("b.id").alias("v"), F.col("b.set_a").alias("v_set")).distinct()


def _verified(percent: int):
    """Links between the sets of two blocks that lie in different components, one for each set
    and component, found inside the task so that pairs are never rows."""

    def columns(rows: pa.Array):
        bits = rows.field("bits").flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
        sets = rows.field("members")
        return (*(rows.field(c).to_numpy() for c in ("id", "component")), bits, sets.flatten().to_numpy(),
                np.concatenate(([0], np.cumsum(pc.list_value_length(sets).to_numpy()))).astype(np.int64))

    least = (percent / 100 - MARGIN) * (1 - 2.0**-BITS) + 2.0**-BITS

    def run(batches):
        for batch in batches:
            links: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                ids, parts, bits, flat, at = columns(batch.column("inside")[i].values)
                size = np.diff(at)
                for u, part, own_bits, own, n in zip(*_ends(columns(batch.column("outside")[i].values))):
                    own = np.sort(own)
                    differ = np.bitwise_count(reduce(np.bitwise_or, np.hsplit(bits ^ own_bits, BITS))).sum(axis=1)
                    near = np.flatnonzero((parts != part) & (1 - differ / MINIMA >= least)
                                          & (np.minimum(size, n) * 100 >= np.maximum(size, n) * percent))
                    if not len(near):
                        continue
                    held = np.concatenate([flat[at[x] : at[x + 1]] for x in near])
                    spot = np.minimum(np.searchsorted(own, held), n - 1)
                    common = np.add.reduceat(own[spot] == held, np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
                    linked = near[common * 100 >= (size[near] + n - common) * percent]
                    _, one = np.unique(parts[linked], return_index=True)
                    links.update((int(u), int(ids[x])) for x in linked[one])
            ends = [list(c) for c in zip(*links)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ends], ["u", "v"])

    return run


def _ends(columns) -> tuple:
    """Per row: id, component, bits, set, and its size."""
    ids, parts, bits, flat, at = columns
    return ids, parts, bits, [flat[at[i] : at[i + 1]] for i in range(len(ids))], np.diff(at)


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the members outside a bucket's main component and all its members.

    Both sides are put into blocks of about ``BLOCK`` set members. Pairs of blocks are dealt out by the key
    and the block that is joined, so a large bucket is as many keys as it has blocks.
    """
    total = rows.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    full = rows.join(total, "key").join(sets, ["id", "set_a"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "set_a"), F.col("blocks")))
    row = F.struct("id", "component", "bits", "members")
    inside = full.groupBy("key", "block").agg(F.collect_list(row).alias("inside")).withColumnRenamed("block", "other")
    outside = full.where("component <> main").groupBy("key", "block", "blocks").agg(F.collect_list(row).alias("outside"))
    outside = outside.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return outside.join(inside, ["key", "other"]).select("outside", "inside").mapInArrow(_verified(percent), "u long, v long")


#: Rounds with centres before the rest is compared in blocks, pairs left for each member at which
#: that is done at once (as it is when a round does not halve them), and set members in a block.
ROUNDS, ENOUGH, BLOCK = 4, 16, 200_000


def _linked(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of every linked class, the same as by all links.

    In each round the members of a bucket carry the component that the links so far give them,
    and all are compared with one of those outside the bucket's largest component, drawn by
    a hash that differs by bucket. That leaves few components in a bucket. What is then outside
    the largest one is compared with all members of the bucket, in blocks. The links of a round
    join the components of the rounds before; links within one are not walked again.
    """
    members = written(_buckets(classes), "minhash-members")
    sets = _sets_of(members, docs, width)
    label, before = None, 0.0
    for step in range(1, ROUNDS + 2):
        if label is None:
            rows = members.withColumn("component", F.col("id"))
        else:
            rows = written(relabelled(members.withColumn("component", F.col("id")), "component", label), "minhash-labelled")
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("held"))
        main = (parts.groupBy("key").agg(F.max(F.struct("held", "component")).alias("main"), F.sum("held").alias("n"))
                .where("n > main.held").select("key", F.col("main.component").alias("main"), "n", (F.col("n") - F.col("main.held")).alias("out")))
        main = written(main, "minhash-main")
        work = main.agg(F.sum(F.col("out").cast("double") * F.col("n")), F.sum("n")).first()
        if not work[1]:
            break
        rows = written(rows.join(main.select("key", "main", "n"), "key"), "minhash-open")
        if step > 1 and (work[0] <= ENOUGH * work[1] or 2 * work[0] > before) or step > ROUNDS:
            label = _joined(label, written(_in_blocks(rows, sets, percent), "minhash-links"))
            break
        before = work[0]
        pairs = written(_with_centres(rows, percent), "minhash-pairs")
        label = _joined(label, written(_confirmed(pairs, sets, percent), "minhash-links"))
        members = rows.where("n > 2").drop("component", "main", "n")  # the centre was the other one of two
    return classes.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0) if label is None else label


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after the links (u, v) have joined components."""
    if label is None:
        return components(links)
    more = components(relabelled(relabelled(links, "u", label), "v", label))
    return written(relabelled(label, "component", more).unionByName(more.join(label.select("node"), "node", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    A-Z count as lower case. A set is the distinct runs of ``width`` words; fewer words are one
    run; without words, or with a null text, the set is empty and linked with nothing. Rows that
    repeat a doc_id are one document with the links of all its rows. A row without doc_id is a
    document of its own: component_id is null and kept is true. Other columns play no part.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    own = written(signatures(docs, width), "minhash")
    name = ["n_shingles", "set_a", "set_b"]
    filled = own.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        filled.groupBy(*name).agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"),
                                  F.any_value("bits").alias("bits")), "minhash-classes")
    copies = (filled.select("doc_id", *name).join(classes.select("id", *name), name)
              .where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v")))
    linked = _linked(classes, docs, width, percent).select(F.col("node").alias("u"), F.col("component").alias("v"))
    label = components(copies.unionByName(linked))
    joined = own.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("node"), "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
