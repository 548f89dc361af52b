"""Token ids in Arrow files of equal-length sequences.

The ids of a range of documents, in the order of doc_id, follow each other without gaps and are
cut into sequences of one length. A file is in Arrow's IPC file format: column ``ids`` is a
fixed-size list of unsigned integers, column ``mask`` a fixed-size list of booleans that are
false only in the padding of the last sequence. All record batches but the last hold the same
number of sequences, so sequence n is found without a search, and a memory-mapped file gives
it without a copy. A second file beside it lists the documents: doc_id and first token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import SharedFile, filesystem, in_slices, written
from flowgauge.llm.tokens import encoder
from flowgauge.session import scratch_path

LENGTH, GROUP = 2048, 256
END = 0
MANIFEST = "part int, ids_uri string, docs_uri string, n_docs long, n_tokens long"
MANIFEST_SCHEMA = pa.schema([("part", pa.int32()), ("ids_uri", pa.string()), ("docs_uri", pa.string()),
                             ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64())])


def sequence_schema(length: int, width) -> pa.Schema:
    return pa.schema([("ids", pa.list_(width, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Writes a stream of ids as equal-length sequences; holds one record batch at most."""

    def __init__(self, out, length: int = LENGTH, group: int = GROUP, width=None):
        self.length, self.group, self.width = length, group, width or pa.uint16()
        self.kind = self.width.to_pandas_dtype()
        self.file = pa.ipc.new_file(out, sequence_schema(length, self.width))
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * self.group:
            self._write(False)

    def _write(self, last: bool) -> None:
        block = self.length * self.group
        flat = np.concatenate([*self.held, np.zeros(0, self.kind)])
        while len(flat) >= block or last and len(flat):
            now, flat = flat[:block], flat[block:]
            rows = -(-len(now) // self.length)
            padded = np.zeros(rows * self.length, self.kind)
            padded[: len(now)] = now
            mask = np.arange(rows * self.length) < len(now)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (padded, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))
        self.held, self.n = [flat], len(flat)

    def close(self) -> None:
        self._write(True)
        self.file.close()


class SequenceReader:
    """Random access to the sequences of a file, and to runs of its tokens."""

    def __init__(self, uri: str, group: int = GROUP):
        system, path = filesystem(uri)
        local = type(system).__name__ == "LocalFileSystem"
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        self.length, self.group = self.file.schema.field("ids").type.list_size, group
        self.kept = (-1, None)

    def _batch(self, number: int) -> pa.RecordBatch:
        if self.kept[0] != number:
            self.kept = (number, self.file.get_batch(number))
        return self.kept[1]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of one sequence; the ids are a view of the file's memory."""
        batch, row = self._batch(number // self.group), number % self.group
        return tuple(batch.column(c)[row].values.to_numpy(zero_copy_only=c == 0) for c in (0, 1))

    def tokens(self, first: int, stop: int) -> Iterator[np.ndarray]:
        """The tokens of a range, batch by batch."""
        block = self.length * self.group
        while first < stop:
            number = first // block
            to = min(stop, (number + 1) * block)
            flat = self._batch(number).column(0).flatten().to_numpy()
            yield flat[first - number * block : to - number * block]
            first = to

    def n_tokens(self) -> int:
        """Tokens without the padding."""
        batches = self.file.num_record_batches
        if not batches:
            return 0
        last = self.file.get_batch(batches - 1).column(1).flatten()
        return (batches - 1) * self.length * self.group + last.true_count


def write_sequences(docs: DataFrame, path: str, folder: str | None = None, parts: int | None = None,
                    length: int = LENGTH) -> DataFrame:
    """Encode ``docs`` (doc_id, text, ...) and write the files; one manifest row per part.

    Every text is encoded whole, with id 0 after it; a null text is empty. Documents are dealt
    to parts by ranges of doc_id and lie in ascending order, null doc_ids first, rows with the
    same doc_id by their ids. No documents give no files. Other columns play no part.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sequences")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] if shares else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    wide = encoder(path).tokenizer.get_vocab_size() > 2**16
    kind, width = (np.uint32, pa.uint32()) if wide else (np.uint16, pa.uint16())

    def encode(batches):
        for batch in batches:
            for piece in in_slices(batch, "text"):
                ids = [
                    np.append(v, np.uint32(END)).astype(kind).tobytes()
                    for v in encoder(path).ids(piece.column("text"))
                ]
                keys = piece.column("doc_id")
                part = np.searchsorted(bounds, keys.fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), keys, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    def write(batches):
        part, files = None, None
        for batch in batches:
            for number, key, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if number != part:
                    if files:
                        yield files.done()
                    part, files = number, _Part(folder, number, width, length)
                files.add(key, np.frombuffer(ids, kind))
        if files:
            yield files.done()

    dealt = docs.mapInArrow(encode, "part int, doc_id long, ids binary").repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return written(ordered.mapInArrow(write, MANIFEST), "sequence-manifest")


class _Part:
    """The two files of a part, under the names of this attempt until they are whole."""

    def __init__(self, folder: str, number: int, width, length: int):
        self.number = number
        self.files = [SharedFile(f"{folder}/part-{number:06d}.{x}.arrow") for x in ("ids", "docs")]
        self.ids = SequenceWriter(self.files[0].out, length, width=width)
        self.docs = pa.ipc.new_file(self.files[1].out, DOCS)
        self.keys, self.firsts, self.n_docs, self.n_tokens = [], [], 0, 0

    def _flush(self) -> None:
        columns = [pa.array(self.keys, pa.int64()), pa.array(self.firsts, pa.int64())]
        self.docs.write_batch(pa.RecordBatch.from_arrays(columns, schema=DOCS))
        self.keys, self.firsts = [], []

    def add(self, key, ids: np.ndarray) -> None:
        if len(self.keys) >= 65536:
            self._flush()
        self.keys.append(key)
        self.firsts.append(self.n_tokens)
        self.ids.add(ids)
        self.n_docs += 1
        self.n_tokens += len(ids)

    def done(self) -> pa.RecordBatch:
        self._flush()
        self.docs.close()
        self.ids.close()
        uris = [file.keep() for file in self.files]
        row = {"part": self.number, "ids_uri": uris[0], "docs_uri": uris[1], "n_docs": self.n_docs, "n_tokens": self.n_tokens}
        return pa.RecordBatch.from_pylist([row], MANIFEST_SCHEMA)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts the
    ids of all documents before it, over all parts."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    spread = placed.repartition(max(1, manifest.count()))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = SequenceReader(row["ids_uri"])
                system, path = filesystem(row["docs_uri"])
                with system.open_input_file(path) as source:
                    docs = pa.ipc.open_file(source)
                    total = reader.n_tokens()
                    for i in range(docs.num_record_batches):
                        keys, firsts = docs.get_batch(i).columns
                        last = i + 1 == docs.num_record_batches
                        following = total if last else docs.get_batch(i + 1).column(1)[0].as_py()
                        begin = firsts.to_numpy()
                        stops = np.append(begin[1:], following)
                        crcs = []
                        for first, stop in zip(begin, stops):
                            crc = 0
                            for ids in reader.tokens(int(first), int(stop)):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(begin + row["base"]), pa.array(stops - begin), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
