"""WARC archives of pages, and their capture index by external merge.

Every task writes its pages as records, each a gzip member of its own, and keeps an entry per
record: URL key, timestamp, page, archive, offset. Entries leave the task as sorted runs of
bounded length. The runs' entries are dealt to ranges of the key, and in each range a tree of
losers merges the k runs. Range after range this is one globally ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import SharedFile, few, filesystem, in_slices, written
from flowgauge.session import scratch_path

RUN, RANGE, ARCHIVE = 20_000, 50_000, 1 << 28
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
ENTRY = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()),
                   ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string()), ("nth", pa.int32())])
ENTRY_SQL = "urlkey string, timestamp string, page_id long, archive string, offset long, length long, run string, nth int"
ORDER = ("urlkey", "timestamp", "page_id", "archive", "offset")
RECORD_SQL = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "target_uri string, archive string, offset long")


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, lower-case and without scheme, port 80 or 443,
    leading www and fragment; of what is no URL, the text itself."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{host}{port}){parts.path or '/'}{query}".lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, date: str, revisit: bool, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only, with the length of the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c if c > " " else "%20" for c in url or "")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    text = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + text.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(source, size: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member of a stream; holds one member at a time."""
    offset, rest = 0, source.read(size)
    while rest:
        unpack, out, taken = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest:
                raise EOFError("the archive ends within a record")
            out.append(unpack.decompress(rest))
            taken += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data or (b"" if unpack.eof else source.read(size))
        yield offset, b"".join(out)
        offset += taken
        rest = rest or source.read(size)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of a record by lower-case name, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def fetch(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry."""
    system, path = filesystem(uri)
    with system.open_input_file(path) as source:
        return parsed(zlib.decompress(source.read_at(length, offset), 31))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next entry costs
    one match for each level on the way from its run to the top."""

    def __init__(self, runs: Iterable[Iterable], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads = [self._next(i) for i in range(len(self.runs))] or [None]
        self.losers = [0] * self.k
        self.losers[0] = self._play(1)

    def _next(self, run: int):
        for row in self.runs[run] if self.runs else ():
            return self.key(row), run, row
        return None

    def _better(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[:2] < y[:2]

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._better(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[2]
            run = self.losers[0]
            self.heads[run] = self._next(run)
            node = (run + self.k) // 2
            while node:
                if self._better(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.losers[0] = run


def _key(row: dict) -> tuple:
    return tuple((row[c] is not None, row[c]) for c in ORDER)


def with_first(pages: DataFrame) -> DataFrame:
    """``pages`` with ``first``, the smallest page_id of those with the same payload."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html",
                         F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("size"))
    same = (pages.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
            .where("n > 1").drop("n"))
    joined = pages.join(few(written(same, "payloads")), ["sha1", "size"], "left")
    return joined.select("page_id", "url", "html", F.coalesce("first", "page_id").alias("first"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html, ...) and return the entries, as written sorted runs.

    A null html is the empty payload. Of equal payloads that with the smallest page_id is a
    response, the others revisit it; rows that repeat that page_id are responses too, and so
    are rows without page_id if none of the same payload has one. The date is page_id seconds
    after 2024-01-01, as pages carry none. Other columns play no part.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        task = TaskContext.get().partitionId()
        archive, number, at, entries, runs = None, 0, 0, [], 0

        def sorted_run():
            nonlocal entries, runs
            entries.sort(key=_key)
            for nth, entry in enumerate(entries):
                entry |= {"run": f"{task}-{runs}", "nth": nth}
            batch = pa.RecordBatch.from_pylist(entries, ENTRY)
            entries, runs = [], runs + 1
            return batch

        for batch in batches:
            for part in in_slices(batch, "html"):
                for row in part.to_pylist():
                    if archive is None:
                        archive, at = SharedFile(f"{folder}/part-{task:06d}-{number:04d}.warc.gz"), 0
                    date = EPOCH + timedelta(seconds=(row["page_id"] or 0) % (1 << 31))
                    revisit = row["first"] is not None and row["first"] != row["page_id"]
                    raw = record(row["page_id"], row["url"], (row["html"] or "").encode(), date.strftime("%Y-%m-%dT%H:%M:%SZ"),
                                 revisit, row["first"])
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = pack.compress(raw) + pack.flush()
                    archive.out.write(packed)
                    entries.append({"urlkey": url_key(row["url"]), "timestamp": date.strftime("%Y%m%d%H%M%S"),
                                    "page_id": row["page_id"], "archive": archive.uri, "offset": at, "length": len(packed)})
                    at += len(packed)
                    if len(entries) >= RUN:
                        yield sorted_run()
                    if at >= ARCHIVE:
                        archive.keep()
                        archive, number = None, number + 1
        if archive is not None:
            archive.keep()
        if entries:
            yield sorted_run()

    return written(with_first(pages).mapInArrow(run, ENTRY_SQL), "capture-runs")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries of sorted runs in one global order: columns ``range`` and ``place`` within it."""
    ranges = max(1, -(-runs.count() // RANGE))

    def merge(batches):
        held: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["run"], []).append(row)
        number, out = TaskContext.get().partitionId(), []
        schema = pa.schema([*ENTRY, ("range", pa.int32()), ("place", pa.int64())])
        for place, row in enumerate(LoserTree(held.values(), _key)):
            out.append(row | {"range": number, "place": place})
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    dealt = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("run", "nth")
    return written(dealt.mapInArrow(merge, ENTRY_SQL + ", range int, place long"), "capture-index")


def read_archives(entries: DataFrame) -> DataFrame:
    """What the archives named by ``entries`` hold, read from the files from end to end."""
    archives = written(entries.select("archive").distinct(), "archives")

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()),
                            ("archive", pa.string()), ("offset", pa.int64())])

        def page(urn: str | None):
            name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
            return int(name) if name.lstrip("-").isdigit() else None

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = filesystem(uri)
                rows = []
                with system.open_input_stream(path, compression=None) as source:
                    for offset, raw in members(source):
                        fields, block = parsed(raw)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size, digest = len(payload), base32_sha1(payload)
                        if fields["warc-type"] == "revisit":
                            size = int(head.decode().lower().split("content-length:")[1].split()[0])
                            digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        rows.append({"page_id": page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest,
                                     "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")),
                                     "target_uri": fields["warc-target-uri"], "archive": uri, "offset": offset})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.repartition(max(1, archives.count())).mapInArrow(run, RECORD_SQL)


def captures(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Every page as its archives give it back, with its place in the capture histories."""
    index = merge_runs(write_archives(pages, folder))
    placed = index.select("archive", "offset", "urlkey", "timestamp", "range", "place")
    # By sorting: a side below the broadcast threshold when it runs would still grow with the pages.
    return read_archives(index).join(placed.hint("merge"), ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "range", "place")
