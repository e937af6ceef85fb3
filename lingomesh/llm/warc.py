"""WARC: web archives packed as ZIP files, written per task and read by byte ranges.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one
gzip member per WARC record), ``indexes/index.cdxj`` (one line per record with its place in the
WARC member) and ``datapackage.json``.  The reader never extracts: it reads the end of the file,
the ZIP64 locator and end record if there are any, the central directory, then the index member,
and then one byte range per record.  File systems are opened by URI through Arrow, so any store
that the cluster's tasks can reach will do; an archive is written under a name of its own attempt
and only names that finished tasks report are read, so lost and repeated tasks do no harm.

Records: of pages with equal payloads (``min_revisit`` bytes or more) the smallest id is a
``response``, the others are ``revisit`` records that name it; smaller payloads are all responses.

Edge cases: null payload is empty; a null url becomes an empty target URI; rows with a null id are
left out (a record needs a name); rows that repeat an id and its payload give a response each if
the id is the smallest of its group.  Extra columns are ignored.

Scale: a task writes archives of at most ``ARCHIVE_BYTES`` of payload, streams records one by one
and reads one archive at a time.  Grouping equal payloads works on 20-byte digests; the payloads
are shuffled once, by id, so a payload that many pages share crowds no task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import checkpointed

ARCHIVE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int               # offset of the local header


class BadArchive(ValueError):
    pass


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def read_range(f, start: int, n: int) -> bytes:
    f.seek(start)
    data = f.read(n)
    if len(data) != n:
        raise BadArchive(f"{n} bytes wanted at {start}, {len(data)} there")
    return bytes(data)


def central_directory(f, size: int) -> list[Member]:
    """Members of a ZIP file by range reads of its end and its (ZIP64) central directory."""
    tail_size = min(size, 22 + 65535 + 20)
    tail = read_range(f, size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20: at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)             # the signature may also stand in a comment
    if at < 0:
        raise BadArchive("no end of central directory")
    entries, n_bytes, start = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or n_bytes == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if at < 20 or tail[at - 20: at - 16] != b"PK\x06\x07":
            raise BadArchive("no ZIP64 locator")
        end64 = read_range(f, struct.unpack_from("<Q", tail, at - 12)[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise BadArchive("no ZIP64 end of central directory")
        entries, n_bytes, start = struct.unpack_from("<QQQ", end64, 32)
    raw = read_range(f, start, n_bytes)
    out, p = [], 0
    for _ in range(entries):
        if raw[p: p + 4] != b"PK\x01\x02":
            raise BadArchive("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46: p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = raw[p + 46 + n_name: p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:                                # ZIP64 values, in this order, only where the field is full
                wide, w = extra[e + 4: e + 4 + n], 0
                values = []
                for field in (full, packed, header):
                    if field == 0xFFFFFFFF:
                        values.append(struct.unpack_from("<Q", wide, w)[0])
                        w += 8
                    else:
                        values.append(field)
                full, packed, header = values
            e += 4 + n
        out.append(Member(name, method, full, packed, header))
        p += 46 + n_name + n_extra + n_note
    return out


def member_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != 0:
        raise BadArchive(f"{m.name} is not stored")
    head = read_range(f, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise BadArchive(f"no local header of {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, first: int | None) -> bytes:
    """A response record, or a revisit record of page ``first``, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if first is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(body)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names lower-cased) and payload of one record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadArchive("no WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(warc["content-length"])
    block = rest[:n]
    if len(block) != n or digest(block) != warc["warc-block-digest"].removeprefix("sha1:"):
        raise BadArchive("broken block")
    status, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in status.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


class Writer:
    """One archive: records are streamed into the WARC member, the index follows."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.path, self.index, self.at, self.payload = path, [], 0, 0
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Sink(self.out), 1 << 20), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int, url: str, payload: bytes, first: int | None) -> None:
        packed = record(page_id, url, payload, first)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.payload += len(payload)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self.index))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        buffered = self.zip.fp
        self.zip.close()
        buffered.flush()
        self.out.close()
        return self.path, len(self.index)


class _Sink(io.RawIOBase):
    def __init__(self, out):
        self.out = out

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        return len(data)


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        writer, done = None, []
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("id", "url", "html", "first"))):
                if writer is None:
                    writer = Writer(store, f"{base}/{uuid.uuid4().hex}.wacz")
                writer.add(page_id.as_py(), url.as_py() or "", (html.as_py() or "").encode(), first.as_py())
                if writer.payload >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[1]}" for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                                         names=["archive", "records"])
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            store, path = open_store(uri)
            with store.open_input_file(path) as f:
                members = {m.name: m for m in central_directory(f, f.size())}
                data = member_start(f, members[DATA])
                index = read_range(f, member_start(f, members[INDEX]), members[INDEX].size)
                rows = []
                for line in index.splitlines():
                    entry = json.loads(line)
                    warc, http, payload = parse(read_range(f, data + entry["offset"], entry["length"]))
                    kind = warc["warc-type"]
                    said = warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != said or len(payload) != int(http["content-length"])):
                        raise BadArchive(f"broken payload in {uri}")
                    refers = warc.get("warc-refers-to")
                    rows.append((int(warc["warc-record-id"][10:-1]), warc["warc-target-uri"], int(http["content-length"]), said, kind,
                                 int(refers[10:-1]) if refers else None, payload if kind == "response" else None))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder, as a URI that tasks can open."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``folder``; ``archive, records`` of those that count."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html")).where("id IS NOT NULL")
    body = F.coalesce("html", F.lit(""))
    marks = checkpointed(p.select("id", F.sha1(body.cast("binary")).alias("sha")).where(F.octet_length(body) >= min_revisit))
    firsts = marks.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    again = marks.join(firsts, "sha").where("id > first").select("id", F.col("sha").alias("again_sha"), "first").distinct()
    named = p.withColumn("sha", F.sha1(body.cast("binary"))).join(again, "id", "left")
    named = named.select("id", "url", "html", F.when(F.col("sha") == F.col("again_sha"), F.col("first")).alias("first"))
    return checkpointed(named.mapInArrow(_write(folder, archive_bytes), "archive string, records long"))


def read(archives: DataFrame) -> DataFrame:
    """Every record of the archives (column ``archive``: URIs); the payload of a response."""
    n = max(archives.count(), 1)
    return archives.select("archive").repartition(n).mapInArrow(_read, READ_SCHEMA)
