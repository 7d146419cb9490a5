"""WARC archives as chunked record tables: rows (archive, record, chunk, data, digest), a record's chunks joined being its WARC bytes.

A payload is never held as a whole by the writer or the reader: chunks are slices of it, and each carries the SHA-256 of the payload up
to its end. Joined in the order (record, chunk), an archive's rows are a valid WARC file; export() and load() stream such files.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

CHUNK = 1 << 16
LEAST = 100  # payloads of fewer bytes are never revisits
SALTED, SALTS = 10_000, 1_000  # a payload's pages are dealt to a task each so many, to so many at most
REVISITS = 200_000  # revisits up to this number (a hundred bytes each) are broadcast to the pages; beyond it they are joined
HEAVY = 100_000  # payloads that so many pages share are few; beyond this number they are joined, not broadcast
KIND = "archive int, record long, chunk int, data binary, digest string"
_NAMES = ["archive", "record", "chunk", "data", "digest"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]


def plan_records(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Digests are grouped without their payloads, with a partial count in each task; then only revisits, as pairs of page and digest, meet the
    pages again, by both, so that a payload that very many pages share doesn't bring them all to one task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    narrow = rows.where(F.col("payload_bytes") >= LEAST).select("payload_digest", "page_id")
    firsts = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).where("many > 1")
    salts = F.ceil(F.col("many") / SALTED).cast("int")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.least(salts, F.lit(SALTS)) - 1))).select("payload_digest", "first", "salt", F.least(salts, F.lit(SALTS)).alias("salts"))
    heavy = firsts.where("salts > 1").select("payload_digest", "salts").distinct().withColumnsRenamed({"payload_digest": "d", "salts": "of"})
    dealt = narrow.join(F.broadcast(heavy) if heavy.count() <= HEAVY else heavy, F.col("payload_digest") == F.col("d"), "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("of", F.lit(1))).cast("int"))
    again = dealt.join(firsts.drop("salts"), ["payload_digest", "salt"]).where("page_id <> first").select("page_id", "payload_digest", "first").distinct()
    again = small((scratch or Scratch(pages.sparkSession, "warc")).save(again, "again"), REVISITS)  # so few that no payload is shuffled for them
    return rows.join(again, ["page_id", "payload_digest"], "left").withColumnRenamed("first", "refers_to")


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _heads(page, url, size, digest, refers):
    """The header of a record and of the HTTP message in it."""
    http = b"" if refers is not None else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    urn = lambda p: f"<urn:page:{'' if p is None else p}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    lines.append(f"Content-Length: {len(http) + (size if refers is None else 0)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def _written(batches):
    part, record = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 40
    rows, held = [], 0
    for batch in batches:
        cols = [batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]
        for i in range(batch.num_rows):
            page, url, html, size, digest, refers = (c[i] for c in cols)
            page, url, size, digest, refers = (c.as_py() for c in (page, url, size, digest, refers))
            head = _heads(page, url, size, digest, refers)
            body = memoryview(html.as_buffer()) if refers is None else memoryview(b"")
            sha = hashlib.sha256()
            cuts = range(0, max(1, len(body)), CHUNK)
            for k, at in enumerate(cuts):
                piece = body[at : at + CHUNK]
                sha.update(piece)
                last = at + CHUNK >= len(body)
                data = (head if not k else b"") + bytes(piece) + (b"\r\n\r\n" if last else b"")
                rows.append((part, record, k, data, sha.hexdigest()))
                held += len(data)
                if held > 4 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            record += 1
    yield _rows(rows)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, _TYPES)], names=_NAMES)


def write_archives(records: DataFrame, scratch: Scratch) -> DataFrame:
    """The archives' chunk table, one archive per task, written in the shared folder."""
    return scratch.save(records.mapInArrow(_written, KIND), "archives")


class _Reader:
    """One record, fed with its chunks."""

    def __init__(self):
        self.head, self.fields, self.left, self.sha, self.size, self.wait_http = b"", None, 0, hashlib.sha256(), 0, False

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8", "surrogatepass").split("\r\n")
            self.fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
            self.left = int(self.fields["content-length"])
            self.wait_http = self.left > 0
            data, self.head = self.head[end + 4 :], b""
        data = data[: self.left] if len(data) > self.left else data
        self.left -= len(data)
        if self.wait_http:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            data, self.head, self.wait_http = self.head[end + 4 :], b"", False
        self.sha.update(data)
        self.size += len(data)

    def row(self):
        f = self.fields or {}
        page = lambda k: int(v[10:-1]) if len(v := f.get(k, "<urn:page:>")) > 11 else None
        if f.get("warc-type") == "response":
            if f"sha256:{self.sha.hexdigest()}" != f["warc-payload-digest"] or self.left:
                raise ValueError(f"damaged record {f['warc-record-id']}")
            return page("warc-record-id"), f.get("warc-target-uri"), self.size, self.sha.hexdigest(), "response", None
        return page("warc-record-id"), f.get("warc-target-uri"), int(f["x-payload-length"]), f["warc-payload-digest"][7:], "revisit", page("warc-refers-to")


def _read(batches):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    out, key, reader = [], None, None
    table = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)
    for batch in batches:
        archive, record = batch.column("archive").to_pylist(), batch.column("record").to_pylist()
        data = batch.column("data")
        for i, now in enumerate(zip(archive, record)):
            if now != key:
                if reader:
                    out.append(reader.row())
                key, reader = now, _Reader()
            reader.feed(data[i].as_py())
        if len(out) > 10_000:
            yield table()
            out = []
    if reader:
        out.append(reader.row())
    yield table()


def read_archives(chunks: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) per record; responses' digests are computed from what was
    stored, and a record whose bytes don't have the digest it names is an error. A record's chunks meet in one task as a stream."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return chunks.repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk").mapInArrow(_read, kind)


def export(chunks: DataFrame, folder: str) -> DataFrame:
    """Write archives as files <folder>/<archive>.warc, which all executors must reach; rows (file, bytes)."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, size = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], names=["file", "bytes"])
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data")):
                if name != f"{archive:06d}.warc":
                    if out:
                        out.close()
                        yield done()
                    name, size = f"{archive:06d}.warc", 0
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(data.as_buffer())
                size += len(data.as_buffer())
        if out:
            out.close()
            yield done()

    return chunks.repartition("archive").sortWithinPartitions("archive", "record", "chunk").mapInArrow(run, "file string, bytes long")


def load(files: DataFrame, folder: str) -> DataFrame:
    """Read files (file) of a folder back as a chunk table, streaming: no file and no record is held whole."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                archive, record = int(file.partition(".")[0]), 0
                with store.open_input_stream(f"{root}/{file}") as f:
                    held = f.read(CHUNK)
                    while held:
                        while (end := held.find(b"\r\n\r\n")) < 0 and (more := f.read(CHUNK)):
                            held += more
                        length = next(int(x.split(b":")[1]) for x in held[:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        left, k = end + 4 + length + 4, 0
                        while left:
                            held = held or f.read(CHUNK)
                            piece, held = held[:left], held[left:]
                            left -= len(piece)
                            yield _rows([(archive, record, k, piece, None)])
                            k += 1
                        record += 1
                        held = held or f.read(CHUNK)

    return files.repartition("file").mapInArrow(run, KIND)


def round_trip(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Archive pages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per row.

    A null html is an empty payload; a null url leaves its field out; white space in urls is percent-encoded. Of equal payloads of at
    least 100 bytes all but those of the smallest page_id are revisits; repeated rows of that page are all responses, and rows with a
    null page_id are responses. An empty table gives no rows. Other columns aren't read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, scratch), scratch)).drop("url")
