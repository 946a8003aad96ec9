"""WARC archives packed in ZIP files, read by range and never extracted.

A package is a ZIP whose members ``archive/*.warc.gz`` are stored, not deflated, so that a record has
a place in the package itself. Reading starts at the package's end: the end record, the ZIP64 locator
and end record where sizes or counts need them, the central directory, and each wanted member's local
header. Members below ``indexes/`` say where records are (CDXJ: a line with the record's key, its time and
a JSON object, in the keys' order); a package without an index is walked record by record. Ranges that touch are read at once, up to a bound.

Packages are written by tasks into the shared folder, each attempt under its own name; only those
whose task ended are listed in the table of packages, so a lost executor leaves nothing that counts.
Defined results:
* null payload: an empty one; null or repeated ids: kept, and read back as they were written
* of equal payloads the record of the smallest id is the response, and so is a row that repeats that id and payload; where all ids are null, all are
* empty table: no packages, no records; columns beside the named ones are not touched
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batches_of, scratch, written

#: Compressed bytes at which a task begins its next package.
PACKAGE_BYTES = 32 << 20
#: Bytes of one read over neighbouring records.
READ_BYTES = 4 << 20
#: Such reads that a task makes, and tasks at most.
RUNS_A_TASK, MOST_TASKS = 4, 100_000
#: Pages in an Arrow batch.
BATCH = 256
DATE = "2024-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"

# Fixed values of the ZIP format: signatures and sizes of its records.
END, END64, LOCATOR64, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
END_SIZE, LOCATOR64_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", text)


def surt(uri: str) -> str:
    """An index key: the host's names from the right, then the path and the query, in lower case."""
    try:
        x = urlsplit(uri)
        host, port = x.hostname, x.port
    except ValueError:
        host = None
    if not host:
        return uri.lower()
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){(x.path or '/')}{f'?{x.query}' if x.query else ''}".lower()


def index_line(uri: str, kind: str, payload_digest: str, offset: int, length: int, filename: str) -> str:
    fields = {"url": uri, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{payload_digest}", "length": str(length), "offset": str(offset), "filename": filename}
    return f"{surt(uri)} {re.sub('[^0-9]', '', DATE)} {json.dumps(fields)}\n"


def record(record_id: str, kind: str, uri: str, payload: bytes, sha1: str, refers: str | None) -> bytes:
    """One response or revisit record; a revisit holds the response's HTTP headers without the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers in lower case, its HTTP headers and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    block = rest[: int(named["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    http = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:]))
    return {"headers": named, "http": http, "payload": body}


class Package:
    """A ZIP file's directory, from ranged reads: ``read(at, size)`` gives bytes, ``size`` is the file's."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m["name"]: m for m in self._directory()}

    def _directory(self) -> Iterator[dict]:
        tail_size = min(self.size, END_SIZE + FULL16 + LOCATOR64_SIZE)
        tail = self.read(self.size - tail_size, tail_size)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if FULL16 == count or FULL32 in (length, start):
            signature, _, where = struct.unpack_from("<IIQ", tail, at - LOCATOR64_SIZE) if at >= LOCATOR64_SIZE else (0, 0, 0)
            if signature == LOCATOR64:
                end = self.read(where, END64_SIZE)
                if struct.unpack_from("<I", end)[0] != END64:
                    raise ValueError("no ZIP64 end record where its locator points")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        data, at = self.read(start, length), 0
        for _ in range(count):
            signature, _, _, flags, method, _, _, crc, packed, plain, n, extra, comment, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if signature != CENTRAL:
                raise ValueError("broken ZIP directory")
            name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields = data[at + CENTRAL_SIZE + n : at + CENTRAL_SIZE + n + extra]
            plain, packed, offset = self._wide(fields, plain, packed, offset)
            yield {"name": name, "method": method, "crc": crc, "packed": packed, "size": plain, "offset": offset}
            at += CENTRAL_SIZE + n + extra + comment

    @staticmethod
    def _wide(fields: bytes, *values: int) -> list[int]:
        """Values that fill their 32 bits are in the ZIP64 extra field, in order."""
        out, at = list(values), 0
        while at + 4 <= len(fields):
            kind, n = struct.unpack_from("<HH", fields, at)
            if kind == EXTRA64:
                inner = at + 4
                for k, v in enumerate(out):
                    if v == FULL32:
                        out[k] = struct.unpack_from("<Q", fields, inner)[0]
                        inner += 8
            at += 4 + n
        return out

    def start(self, name: str) -> int:
        """Where a member's bytes begin, from its local header."""
        m = self.members[name]
        head = self.read(m["offset"], LOCAL_SIZE)
        signature, n, extra = struct.unpack_from("<I", head)[0], *struct.unpack_from("<HH", head, 26)
        if signature != LOCAL:
            raise ValueError("no local header where the directory points")
        return m["offset"] + LOCAL_SIZE + n + extra

    def member(self, name: str) -> bytes:
        m = self.members[name]
        data = self.read(self.start(name), m["packed"])
        data = zlib.decompress(data, -15) if m["method"] == 8 else data
        if zlib.crc32(data) != m["crc"]:
            raise ValueError(f"{name}: wrong checksum")
        return data

    def records(self) -> Iterator[tuple[int, int]]:
        """Place and length in the package of every record: by the indexes, or by walking archives that none names."""
        named = set()
        for name in sorted(self.members):
            if name.startswith("indexes/"):
                bases: dict[str, int] = {}
                found = []
                for line in self.member(name).decode().split("\n"):
                    at = line.find("{")
                    if at < 0:
                        continue
                    x = json.loads(line[at:])
                    # members are named by path, or by the last part of it
                    where = x["filename"] if x["filename"] in self.members else f"archive/{x['filename']}"
                    if where not in bases:
                        bases[where] = self.start(where)
                    found.append((bases[where] + int(x["offset"]), int(x["length"])))
                yield from sorted(found)
                named |= set(bases)
        for name in sorted(self.members):
            m = self.members[name]
            if name.startswith("archive/") and name not in named and m["packed"]:
                if m["method"] != 0:
                    raise ValueError(f"{name} is not stored, so its records have no place")
                yield from self._walk(self.start(name), m["packed"])

    def _walk(self, at: int, size: int) -> Iterator[tuple[int, int]]:
        end = at + size
        while at < end:
            begin, unpack = at, zlib.decompressobj(31)
            while not unpack.eof:
                chunk = self.read(at, min(1 << 16, end - at))
                if not chunk:
                    raise ValueError("cut-off record")
                unpack.decompress(chunk)
                at += len(chunk) - len(unpack.unused_data)
            yield begin, at - begin


def opened(path: str) -> tuple[Package, object]:
    store, inner = open_store(path)
    f = store.open_input_file(inner)

    def read(at: int, size: int) -> bytes:
        return f.read_at(size, at)

    return Package(read, f.size()), f


def _packages(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` has id, uri, payload, first and sha1. Writes the packages; returns path, n_records and bytes of each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(root)
        store.create_dir(inner, recursive=True)

        def put() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{inner}/{name}") as out:
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
                    z.writestr("archive/data.warc.gz", archive.getvalue())
                    z.writestr("indexes/index.cdxj", "".join(sorted(index)), zipfile.ZIP_DEFLATED)
                    z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": "data.warc.gz", "path": "archive/data.warc.gz", "bytes": archive.tell()}]}))
                out.write(sink.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "n_records": pa.array([len(index)], pa.int64()), "bytes": pa.array([sink.tell()], pa.int64())})

        archive, index = io.BytesIO(), []
        for b in batches:
            for i, uri, payload, first, sha1 in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own = "" if i is None else str(i)
                kind = "response" if first is None or i == first else "revisit"
                target = _uri(uri or ID_PREFIX + own)
                data = record(ID_PREFIX + own, kind, target, (payload or "").encode(), sha1, None if kind == "response" else f"{ID_PREFIX}{first}")
                packed, at = gzip.compress(data, 6, mtime=0), archive.tell()
                archive.write(packed)
                index.append(index_line(target, kind, sha1, at, len(packed), "data.warc.gz"))
                if archive.tell() >= PACKAGE_BYTES:
                    yield put()
                    archive, index = io.BytesIO(), []
        if index:
            yield put()

    return rows.mapInArrow(of, "path string, n_records long, bytes long")


def write_packages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """One record for each row; payloads of ``least`` bytes or more that are equal become one response and its revisits. Returns the table of packages.

    The first of equal payloads is a minimum by digest, combined before the shuffle; the join back is
    a plain equi-join whose hot digests Spark can split.
    """
    spark = pages.sparkSession
    text = F.col(payload_col).cast("string")

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), text.alias("payload"))
    named = rows.withColumn("sha1", F.sha1(F.coalesce(F.col("payload"), F.lit("")).cast("binary")))
    big = F.coalesce(F.octet_length("payload"), F.lit(0)) >= least
    first = named.filter(big).groupBy("sha1").agg(F.min("id").alias("first"))
    both = named.withColumn("_big", big).join(first, "sha1", "left").withColumn("first", F.when(F.col("_big"), F.col("first")))
    root = scratch(spark, "warc")
    with batches_of(spark, BATCH):
        coded = both.select("id", "uri", "payload", "sha1", "first")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = [base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(names, pa.string())], ["id", "uri", "payload", "first", "sha1"])

        named32 = coded.mapInArrow(of, "id long, uri string, payload string, first long, sha1 string")
        return written(_packages(named32, root), "warc-packages")


RECORD = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """``packages`` has path. A row for each record of each package, its payload checked against its digest.

    Directories and indexes are read first; the places found are dealt out in runs of a bounded size, so
    that a large package is many tasks' work.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                package, f = opened(path)
                runs: list[list] = []
                for at, n in package.records():
                    if runs and runs[-1][0] + runs[-1][1] == at and runs[-1][1] + n <= READ_BYTES:
                        runs[-1][1] += n
                        runs[-1][2].append(n)
                    else:
                        runs.append([at, n, [n]])
                f.close()
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(runs), pa.string()), "at": pa.array([r[0] for r in runs], pa.int64()), "lengths": pa.array([r[2] for r in runs], pa.list_(pa.int64()))})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at, lengths in zip(*[c.to_pylist() for c in b.columns], strict=True):
                store, inner = open_store(path)
                with store.open_input_file(inner) as f:
                    data, out, k = memoryview(f.read_at(sum(lengths), at)), [], 0
                for n in lengths:
                    r = parse(gzip.decompress(data[k : k + n]))
                    k += n
                    h, kind = r["headers"], r["headers"]["warc-type"]
                    named = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response" and named and digest(r["payload"]) != named:
                        raise ValueError(f"{path}: the payload of {h['warc-record-id']} is not what its digest says")
                    size = len(r["payload"]) if kind == "response" else int(r["http"].get("content-length", 0))
                    out.append((h["warc-record-id"].strip("<>"), kind, h.get("warc-target-uri"), h.get("warc-refers-to", "").strip("<>") or None, named, size, r["payload"]))
                cells = list(zip(*out, strict=True))
                types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    with batches_of(spark, 8):
        names = packages.select("path")
        found = written(names.repartition(max(1, names.count()), "path").mapInArrow(places, "path string, at long, lengths array<long>"), "warc-places")
    # places are small and what they stand for is not, so their number says how many tasks there are
    tasks = min(max(1, -(-found.count() // RUNS_A_TASK)), MOST_TASKS)
    return found.repartition(tasks, "path", "at").mapInArrow(records, RECORD)


def page_of(record_id):
    """The id that a record was written under, null for a null id."""
    return F.nullif(F.substring(record_id, len(ID_PREFIX) + 1, 40), F.lit("")).cast("long")
