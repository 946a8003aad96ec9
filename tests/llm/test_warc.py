"""WARC packages: round trips, directories of both sizes, and the rule for equal payloads."""

import json
import base64
import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections import Counter

import pytest

from kvlake.llm import queries, warc


def want(rows, least=0):
    """(id, payload) rows to the agreed columns, by brute force."""
    data = [(i, (p or "").encode()) for i, p in rows]
    out = Counter()
    for i, p in data:
        ids = [j for j, q in data if q == p and j is not None]
        first = min(ids) if ids and len(p) >= least else None
        revisit = first is not None and i != first
        out[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    return out


def digests(df):
    return Counter(tuple(r) for r in df.collect())


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    assert digests(queries.op1_warc(spark, sf_dir)) == want(list(zip(pages.page_id, pages.html, strict=True)))


ODD = [(5, "same"), (2, "same"), (9, "same"), (2, "same"), (7, None), (3, ""), (None, "same"), (None, "x"), (None, "x"), (11, "é" * 100_000), (12, "a\r\n\r\nb"), (13, "é" * 100_000)]


@pytest.mark.parametrize("least, size", [(0, 32 << 20), (5, 100)])
def test_odd_inputs(spark, monkeypatch, least, size):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", size)
    monkeypatch.setattr(warc, "READ_BYTES", size)
    df = spark.createDataFrame([(i, "http://h/a b\r\nX: y" if i == 5 else None, p, "z") for i, p in ODD], "page_id long, url string, html string, payload string")
    packages = warc.write_packages(df, least=least)
    r = warc.read_packages(spark, packages)
    got = r.select(warc.page_of(r.record_id), "payload_bytes", "payload_digest", "record_type", warc.page_of(r.refers_to))
    assert digests(got) == want(ODD, least)
    assert {bytes(x.payload) for x in r.collect() if x.record_type == "response"} == {(p or "").encode() for _, p in ODD}
    assert {x.uri for x in r.collect()} >= {"http://h/a%20b%0D%0AX:%20y", "urn:x-page:2"}
    empty = warc.write_packages(df.limit(0))
    assert empty.count() == 0 and warc.read_packages(spark, empty).count() == 0


def package(data):
    return warc.Package(lambda at, n: data[at : at + n], len(data))


def wide_zip(name, body):
    """A ZIP whose sizes, place and count are all in ZIP64 records, with a comment that holds an end record's signature."""
    n = name.encode()
    crc = zlib.crc32(body)
    local = struct.pack("<IHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, crc, warc.FULL32, warc.FULL32, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    central = struct.pack("<IHHHHHHIIIHHHHHII", warc.CENTRAL, 45, 45, 0, 0, 0, 0, crc, warc.FULL32, warc.FULL32, len(n), 36, 0, 0, 0, 0, warc.FULL32) + n + struct.pack("<HHI", 0xCAFE, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    start = len(local) + len(body)
    end64 = struct.pack("<IQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 1, 1, len(central), start)
    comment = struct.pack("<I", warc.END) + b"x" * 30
    return local + body + central + end64 + struct.pack("<IIQI", warc.LOCATOR64, 0, start + len(central), 1) + struct.pack("<IHHHHIIH", warc.END, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, len(comment)) + comment


def test_index_lines():
    assert warc.surt("https://Www.Example.com:8080/A/b?x=1") == "com,example,www:8080)/a/b?x=1" and warc.surt("http://a.b") == "b,a)/" and warc.surt("urn:x-page:5") == "urn:x-page:5" and warc.surt("http://[") == "http://["
    key, when, rest = warc.index_line("http://a.b/c d".replace(" ", "%20"), "revisit", "ABC", 5, 7, "data.warc.gz").split(" ", 2)
    assert (key, when) == ("b,a)/c%20d", "20240101000000") and json.loads(rest)["offset"] == "5" and json.loads(rest)["mime"] == "warc/revisit"


def test_zip64_directory():
    records = [gzip.compress(warc.record(f"urn:x-page:{i}", "response", "u", b"p%d" % i, "s", None)) for i in range(3)]
    data = wide_zip("archive/data.warc.gz", b"".join(records))
    p = package(data)
    assert p.members["archive/data.warc.gz"]["size"] == sum(map(len, records))
    found = [warc.parse(gzip.decompress(data[a : a + n]))["payload"] for a, n in p.records()]
    assert found == [b"p0", b"p1", b"p2"]


def test_plain_directory_and_broken_files():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("indexes/é.cdxj", "")
        z.writestr("archive/empty.warc.gz", b"")
        z.writestr("note", "x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    p = package(sink.getvalue())
    assert list(p.records()) == [] and p.member("note") == b"x" * 1000 and "indexes/é.cdxj" in p.members
    with pytest.raises(ValueError):
        package(b"not a zip file")
