"""WARC archives: pages written as records, one gzip member each, and a sequential reader.

Writing: of pages with equal payloads of at least ``least`` bytes, the one with the largest id is the response
and the others are revisits that refer to it; smaller ones are all responses. Groups are found by SHA-1 and
length, aggregated before the shuffle; the join back is of two plain tables, so Spark splits a hot payload.

Reading: each archive is read from its start in chunks. Each gzip member is decompressed incrementally; the
record's headers give its length, the block is framed by it, and the digests of block and payload are verified.

Defined cases: a null page is an empty payload; a null url is an empty target; a null id stays null, and its
page never is what others refer to; repeated rows with the largest id are responses all; an empty table gives
no archive and an empty result; other columns are ignored; a damaged or cut archive is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._store import filesystem, materialise, new_path, publish

_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record as a gzip member. A revisit's block holds the HTTP header alone, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if key is None else key}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Date: {date}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source, rest: bytes):
        self.source, self.rest, self.held = source, rest, bytearray()
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        """Decompress some more; False at the member's end."""
        while not self.unzip.eof:
            data = self.unzip.unconsumed_tail or self.rest or self.source.read(_CHUNK)
            if not self.unzip.unconsumed_tail:
                self.rest = b""
            if not data:
                raise ValueError("the archive ends within a record")
            got = self.unzip.decompress(data, _CHUNK)
            if self.unzip.eof:
                self.rest = self.unzip.unused_data
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record's header doesn't end")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def finish(self) -> bytes:
        """The compressed bytes after this member."""
        if self.take(4) != b"\r\n\r\n" or self.held or self.more():
            raise ValueError("a record is longer than its Content-Length")
        return self.rest


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in text.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_records(source) -> Iterator[dict]:
    """All records of an archive, an object with ``read(n)``: type, id, uri, date, refers_to, payload (None for
    a revisit), payload_bytes, payload_digest (hex)."""
    rest = source.read(_CHUNK)
    while rest:
        member = _Member(source, rest)
        version, _, head = member.until(b"\r\n\r\n").partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = _headers(head)
        block = member.take(int(h["content-length"]))
        rest = member.finish() or source.read(_CHUNK)
        if "warc-block-digest" in h and _sha1(block) != h["warc-block-digest"]:
            raise ValueError(f"the block of {h.get('warc-record-id')} doesn't have its digest")
        kind, payload, size = h.get("warc-type"), block, len(block)
        if h.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            size = len(payload) if kind != "revisit" else int(_headers(http).get("content-length", 0))
        if kind != "revisit" and "warc-payload-digest" in h and _sha1(payload) != h["warc-payload-digest"]:
            raise ValueError(f"the payload of {h.get('warc-record-id')} doesn't have its digest")
        digest = h.get("warc-payload-digest", _sha1(payload)).partition(":")[2]
        yield {
            "record_type": kind, "record_id": h.get("warc-record-id", "").strip("<>"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "refers_to_id": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
            "payload": None if kind == "revisit" else payload, "payload_bytes": size, "payload_digest": base64.b32decode(digest).hex(),
        }


def write_archives(pages: DataFrame, path: str | None = None, least: int = 1000, archive_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page; returns one row per archive: path, n_records."""
    spark = pages.sparkSession
    folder = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    shared = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL")
    shared = materialise(shared.select("digest", F.col("size").alias("of_size"), "response"), "responses")
    same = (rows["digest"] == shared["digest"]) & (rows["size"] == shared["of_size"])
    decided = rows.join(shared, same, "left").select("key", "url", "payload", F.col("response"), (F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            name, own = f"{folder}/part-{part:06d}-{number:06d}.warc.gz", held
            publish(name, lambda out: [out.write(x) for x in own])
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_pylist([{"path": name, "n_records": len(own)}], pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

        for b in batches:
            for i in range(b.num_rows):
                key, url, data, response, revisit = (c[i].as_py() for c in b.columns)
                held.append(record_bytes(key, url, data, response, revisit, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialise(decided.mapInArrow(write, "path string, n_records long"), "archives")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``folder``, read as a stream where pyarrow opens the store, else by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    try:
        filesystem(folder)
        files = files.select("path")
    except Exception:  # a store that only Spark opens
        files = files.select("path", "content")
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None) -> int | None:
        return int(name.removeprefix(_ID)) if name and name.startswith(_ID) and name != _ID else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if b.num_columns > 1:
                    source = io.BytesIO(b.column(1)[i].as_py())
                else:
                    fs_, name = filesystem(b.column(0)[i].as_py())
                    source = fs_.open_input_stream(name, compression=None)
                held, size = [], 0
                for r in read_records(source):
                    held.append({"page_id": number(r["record_id"]), "uri": r["uri"], "record_type": r["record_type"], "payload": r["payload"] if payloads else None, "payload_bytes": r["payload_bytes"], "payload_digest": r["payload_digest"], "refers_to": number(r["refers_to_id"])})
                    size += r["payload_bytes"]
                    if len(held) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(read, "page_id long, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def warc_round_trip(pages: DataFrame, payloads: bool = True, **options) -> DataFrame:
    """Write the pages' archives and read them back."""
    spark = pages.sparkSession
    folder = options.pop("path", None) or new_path(spark, "warc")
    if not write_archives(pages, path=folder, **options).take(1):
        return spark.createDataFrame([], "page_id long, uri string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
    return read_archives(spark, folder, payloads)
