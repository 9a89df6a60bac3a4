"""WARC archives as a Spark data source: one gzip member per record, read back sequentially.

Writing: each task compresses its rows into files of bounded size in the target folder, under names no other
attempt uses; only when the job commits does the driver list the files of the successful attempts in a
manifest. Reading: one task per listed file streams it in small blocks, inflates one member after another,
frames records by Content-Length and holds every payload against its SHA-1 digest. Neither side keeps more
than one record's headers, one block of input and (for writing) one Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import filled, work_dir

#: Payloads under this many bytes are always stored.
REVISIT_BYTES = 1000
BLOCK = 1 << 18
MAX_HEADER = 1 << 20
END = b"\r\n\r\n"
READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + END) + z.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def page_record(row: dict, date: str) -> bytes:
    """A page as a response record or, where refers_to is set, as a revisit of that page's record."""
    digest, refers = row["payload_digest"], row["refers_to"]
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [("WARC-Record-ID", record_id(row["page_id"], digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")]
    if row["url"] is not None:
        headers.append(("WARC-Target-URI", " ".join(row["url"].split())))
    if row["page_id"] is not None:
        headers.append(("X-Page-ID", str(row["page_id"])))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if refers is None:
        return record("response", headers, http + row["payload"])
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-ID", str(refers))]
    return record("revisit", headers, http)


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    out = {"": first}
    for line in lines:
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line[:80]!r}")
        out[k.strip().lower()] = v.strip()
    return out


def inflated(stream) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether a gzip member ends with them), one bounded block at a time."""
    z, data, begun = zlib.decompressobj(31), b"", False
    while True:
        fresh = not data
        data = data or stream.read(BLOCK)
        if fresh and not data:
            break
        out = z.decompress(data, BLOCK)
        begun = True
        if z.eof:
            data, z, begun = z.unused_data, zlib.decompressobj(31), False
            yield out, True
        else:
            data = z.unconsumed_tail
            yield out, False
    if begun:  # what the decompressor still holds
        out = z.flush()
        if not z.eof:
            raise ValueError("the archive ends within a record")
        yield out, True


class _Member:
    """Reads within one gzip member."""

    def __init__(self, blocks: Iterator[tuple[bytes, bool]], first: tuple[bytes, bool]):
        self.blocks, (self.buffer, self.ended) = blocks, first

    def more(self) -> bool:
        if self.ended:
            return False
        data, self.ended = next(self.blocks, (None, None))
        if data is None:
            raise ValueError("the archive ends within a record")
        self.buffer += data
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > MAX_HEADER or not self.more():
                raise ValueError("a record's headers have no end")
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            out, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(out)
            yield out


def records(stream, payloads: bool = False) -> Iterator[dict]:
    """The page records of one archive, in order, each held against its digest."""
    blocks = inflated(stream)
    for first in blocks:
        if first == (b"", False):
            continue
        m = _Member(blocks, first)
        head = _fields(m.until(END))
        if not head[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {head['']!r}")
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind in ("response", "revisit"):
            http = m.until(END)
            sha1, n, kept = hashlib.sha1(), 0, []
            for part in m.take(left - len(http) - len(END)):
                sha1.update(part)
                n += len(part)
                if payloads:
                    kept.append(part)
            size = int(_fields(http)["content-length"])
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            if kind == "response" and (n != size or sha1.hexdigest() != digest):
                raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
            number = lambda k: int(head[k]) if k in head else None
            yield {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"), "record_type": kind, "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": digest} | ({"payload": b"".join(kept)} if payloads else {})
        else:
            for _ in m.take(left):
                pass
        if b"".join(m.take(len(END))) != END:
            raise ValueError("a record doesn't end where its Content-Length says")
        while m.more():
            pass
        if m.buffer:
            raise ValueError("bytes after a record's end in its gzip member")


class _Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.limit = int(options.get("maxfilebytes", 1 << 28))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                    if out is None:
                        store.create_dir(root, recursive=True)
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        out.write(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"software: touchline\r\n"))
                    out.write(data := page_record(row, self.date))
                    size += len(data)
                    if size >= self.limit:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Files(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.names)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for name in m.names if m else []:
                store.delete_file(f"{root}/{name}")


class _Archive(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names, self.path = schema.fieldNames(), options["path"]
        self.payloads = "payload" in self.names

    def partitions(self) -> list[InputPartition]:
        store, root = _store(self.path)
        found = []
        for x in store.get_file_info(pafs.FileSelector(root)):
            if x.base_name.startswith("_files-"):
                with store.open_input_stream(x.path, compression=None) as f:
                    found += json.loads(f.read())
        return [_Archive(x) for x in sorted(found)]

    def read(self, partition: _Archive | None) -> Iterator[tuple]:
        if partition is None:
            return
        store, root = _store(self.path)
        with store.open_input_stream(f"{root}/{partition.name}", compression=None, buffer_size=BLOCK) as f:
            for x in records(f, self.payloads):
                yield tuple(x[k] for k in self.names)


class WarcSource(DataSource):
    """spark.read / df.write .format("warc"): options path, date, maxFileBytes (writing), payload=true (reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA + (", payload binary" if self.options.get("payload") == "true" else "")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Each page with its payload, digest and the page it refers to (null: stored in full).

    Of pages with equal payloads of at least revisit_bytes, that with the largest id is stored; rows that repeat
    that id with that payload are stored too. A null html is an empty payload; a null id never wins, and a
    group of null ids alone is stored in full. Other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), filled(F.col(html_col)).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # grouped by size and digest, joined by digest alone: both sides are dealt out for the join, and Spark can split a huge group
    groups = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_bytes", "payload_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(groups.select(F.col("payload_digest").alias("_digest"), "_last"), F.col("payload_digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, **columns) -> None:
    """Writes a record per row into archives below path; see decided() for which are revisits."""
    pages.sparkSession.dataSource.register(WarcSource)
    decided(pages, **columns).write.format("warc").mode("append").option("path", path).save()


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records below path, digests verified; an unreadable or false record fails the job."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes pages into new archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **columns)
    return read_warc(spark, path)
