"""Pictures: codecs, planted copies with recall and precision, candidates against brute force, and odd inputs."""

import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from kvlake.llm import media, media_samples, pictures, queries

from .test_near_duplicates import least

SF = "/root/testdata/sf0.1"


def png(x, kind=0, colour=0):
    step = x.shape[2] if x.ndim == 3 else 1
    rows, above = [], np.zeros(x.shape[1] * step, np.int64)
    for line in x.reshape(len(x), -1).astype(np.int64):
        left = np.concatenate([np.zeros(step, np.int64), line[:-step]])
        corner = np.concatenate([np.zeros(step, np.int64), above[:-step]])
        p = np.array([a if abs(b - c) <= abs(a - c) and abs(b - c) <= abs(a + b - 2 * c) else b if abs(a - c) <= abs(a + b - 2 * c) else c for a, b, c in zip(left, above, corner, strict=True)])
        minus = [0, left, above, (left + above) // 2, p][kind]
        rows.append(bytes([kind]) + ((line - minus) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_codecs():
    x = np.random.default_rng(1).integers(0, 256, (7, 5), np.uint8)
    assert (pictures.decode(pictures.pgm(x)) == x).all()
    for kind in range(5):
        assert (pictures.decode(png(x, kind)) == x).all()
    rgb = np.repeat(x[..., None], 3, 2)
    assert (pictures.decode(png(rgb, 4, 2)) == x).all()
    assert (pictures.decode(b"P6 5 7 255\n" + rgb.tobytes()) == x).all()
    for bad in (None, b"", b"GIF89a", b"P5\n9 9\n255\nxx", png(x)[:40], b"\x89PNG\r\n\x1a\n"):
        assert pictures.decode(bad) is None


def test_turned_and_strangers():
    x = media_samples.scene(77, 160)
    h = np.arange(160) - 79.5
    a = np.deg2rad(25)
    ys, xs = np.cos(a) * h[:, None] + np.sin(a) * h[None, :] + 79.5, -np.sin(a) * h[:, None] + np.cos(a) * h[None, :] + 79.5
    turned = x[np.clip(np.rint(ys), 0, 159).astype(int), np.clip(np.rint(xs), 0, 159).astype(int)]
    one, two, other = (pictures.describe(p[None])[0] for p in (x, turned, media_samples.scene(78, 160)))
    assert pictures.agreeing(one, two) >= pictures.AGREE > pictures.agreeing(one, other)
    assert pictures.agreeing(one, pictures.unpack(pictures.pack(*one))) > 10


def test_planted_copies(spark):
    got = queries.op8_media(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and (got.kept == (got.vec_id == got.component_id)).all()
    got["family"] = got.vec_id.map(media_samples.family)
    assert got.groupby("component_id").family.nunique().max() == 1
    pairs = got.groupby("family").size().map(lambda n: n * (n - 1)).sum()
    found = got.groupby(["family", "component_id"]).size().map(lambda n: n * (n - 1)).sum()
    assert found / pairs > 0.95
    small = got[got.family > 0]
    pairs = small.groupby("family").size().map(lambda n: n * (n - 1)).sum()
    assert small.groupby(["family", "component_id"]).size().map(lambda n: n * (n - 1)).sum() / pairs > 0.9


def test_recall_against_all_pairs(spark):
    """Linked pairs that end in one component, against comparing all; and no component that all pairs would not make."""
    ids = [*range(0, 24), *range(400, 480)]
    packed = {i: pictures.pack(*pictures.describe(media_samples.picture(i)[None])[0]) for i in ids}
    pairs = [(i, j) for i in ids for j in ids if i < j and pictures.linked(packed[i], packed[j])]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, pictures.pgm(media_samples.picture(i))) for i in ids], "id long, media binary")
    got = {r.id: r.component_id for r in media.copies(df).collect()}
    assert sum(got[i] == got[j] for i, j in pairs) / len(pairs) > 0.95
    assert all(find(i) == find(c) for i, c in got.items())


def test_odd_inputs(spark):
    x, y = media_samples.scene(5), media_samples.scene(6)
    tiny, flat = np.zeros((3, 4), np.uint8), np.full((50, 50), 9, np.uint8)
    big = pictures.resized(media_samples.scene(7), 500, 700).astype(np.uint8)
    rows = [(1, pictures.pgm(x)), (2, None), (2, None), (3, b""), (4, b"junk"), (5, b"junk"), (None, pictures.pgm(x)), (None, pictures.pgm(y)), (7, pictures.pgm(tiny)), (8, pictures.pgm(tiny)), (9, pictures.pgm(flat)), (9, pictures.pgm(flat)), (10, png(big)), (11, pictures.pgm(x[5:, 9:]))]
    df = spark.createDataFrame([(i, m, "x") for i, m in rows], "id long, media binary, component_id string")
    got = Counter((r.id, r.component_id, r.kept) for r in media.copies(df).collect())
    assert got == Counter([(1, 1, True), (2, 2, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (None, 1, True), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True), (9, 9, True), (10, 10, True), (11, 1, False)])
    assert media.copies(df.limit(0)).count() == 0


def test_headers_end():
    """Headers that never end, and files that unpack to more than they say, are refused at once."""
    began = time.perf_counter()
    for bad in (b"P5" + b" " * 100_000 + b"x", b"P5" + b" #" * 50_000, b"P5 #a\n" * 20_000, b"P5 " + b"9" * 100_000, b"P6 99999 99999 255 ", b"P51 1 255 x"):
        assert pictures.decode(bad) is None
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    bomb = lambda w, h: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 200_000_000, 1))
    assert pictures.decode(bomb(1 << 31, 1 << 31)) is None and pictures.decode(bomb(9, 9)).shape == (9, 9)
    assert time.perf_counter() - began < 5
    x = np.arange(35, dtype=np.uint8).reshape(7, 5)
    assert (pictures.decode(b"P5\n# by\n 5 # wide\n7\t255\n" + x.tobytes()) == x).all()


def test_all_pairs_where_asked_for(spark):
    """The exact mode has the components that comparing all pairs has."""
    ids = [*range(0, 8), *range(400, 436)]
    packed = [pictures.pack(*pictures.describe(media_samples.picture(i)[None])[0]) for i in ids]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(packed)], "node long, corners binary")
    edges = [(r.u, r.v) for r in media.links(df, exact=True).collect()]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if pictures.linked(packed[i], packed[j])]
    assert least(len(ids), edges) == least(len(ids), pairs) and all(pictures.linked(packed[u], packed[v]) for u, v in edges)


@pytest.mark.parametrize("part", [1 / 2, 0.42])
def test_crops_of_large_pictures(part):
    found = 0
    for seed in range(6):
        x = media_samples.scene(900 + seed, 768)
        k = int(768 * part)
        a, b = 40 * seed, 300 - 40 * seed
        whole, cropped = (pictures.pack(*pictures.describe(p[None])[0]) for p in (x, x[a : a + k, b : b + k]))
        found += pictures.linked(whole, cropped)
    assert found >= 5


@pytest.mark.parametrize("n", [0, 3])
def test_keys_of_few(n):
    assert len(pictures.keys(np.zeros((n, 4), np.uint64))) == (pictures.TABLES if n else 0)


def test_linked_pairs_in_buckets_led_by_strangers(spark):
    """Forty pictures share every descriptor, and so every bucket; only twos of them have the corners in the same places."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, (12, 4), np.uint64)
    places = [rng.uniform(0, 90, 12) + 1j * rng.uniform(0, 90, 12) for _ in range(20)]
    packed = [pictures.pack(places[i // 2], words) for i in range(40)]
    truth = {(i, j) for i in range(40) for j in range(i + 1, 40) if pictures.linked(packed[i], packed[j])}
    assert truth == {(i, i + 1) for i in range(0, 40, 2)}
    df = spark.createDataFrame(list(enumerate(packed)), "node long, corners binary")
    assert {(min(r), max(r)) for r in media.links(df).collect()} == truth


def test_votes_counted_in_parts(monkeypatch):
    """Many small parts find what one finds, and a component's own pairs are not made."""
    packed = [pictures.pack(*pictures.describe(media_samples.picture(i)[None])[0]) for i in range(4, 20)]
    tile, root = np.zeros(16, np.int64), np.arange(16)
    whole = media._forest(tile, root, packed)
    monkeypatch.setattr(media, "EVENTS", 1)
    assert media._forest(tile, root, packed) == whole and len(whole) > 8
    assert media._forest(tile, root * 0, packed) == []


def test_files_that_are_not_read(spark):
    """Equal bytes of a media file are one component, whether or not its format is read."""
    jpeg, film = b"\xff\xd8\xff\xe0" + b"a" * 50, b"\0\0\0\x18ftypmp42" + b"b" * 50
    rows = [(1, jpeg), (2, jpeg), (3, jpeg + b"c"), (4, film), (5, film), (6, b"GIF89a" + b"d"), (7, b"GIF89a" + b"e"), (None, jpeg)]
    got = Counter((r.id, r.component_id, r.kept) for r in media.copies(spark.createDataFrame(rows, "id long, media binary")).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (None, 1, True)])
