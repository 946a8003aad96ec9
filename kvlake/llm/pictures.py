"""Pictures: decoding of PNM and PNG, and local descriptors with their geometric comparison, in numpy.

A picture's corners are found on several scales. Around each, intensity tests on pairs of points turned
by the patch's own direction give 256 bits. Two pictures match where enough descriptors are close and
one shift, turn and scale carries most of their corners onto each other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np

#: Longer sides are reduced to this before anything else, and pictures of more pixels are not read.
MOST_SIDE, MOST_PIXELS = 384, 1 << 28
#: Scales between levels, and corners kept on each by a picture of the base side squared; a larger one keeps more, by the root of its area, on as many more levels as it is larger.
STEP, CORNERS, BASE_SIDE = 1.25, (14, 10, 8, 6, 5), 96
BORDER, RADIUS, TURNS = 10, 7, 30
BITS = 256
#: Tables of so many bits; a shared key makes two descriptors candidates.
TABLES, KEY_BITS = 6, 96
#: Differing bits of close descriptors, pixels that a corner may miss its place by, corners that must agree.
CLOSE, MISS, AGREE = 48, 2.5, 9

_rng = np.random.default_rng(2024)
_PAIRS = np.clip(_rng.normal(0, 3.6, (BITS, 2, 2)), -6.5, 6.5)
_KEYS = np.stack([_rng.choice(BITS, KEY_BITS, replace=False) for _ in range(TABLES)])
#: A key is a sum of its bits' weights, which tell all tables' keys apart.
_WEIGHTS = _rng.integers(0, 2**64, (TABLES, KEY_BITS + 1), np.uint64)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PNM or a PNG of 8 bits without interlace; None for anything else."""
    if not data:
        return None
    try:
        return _pnm(data) if data[:2] in (b"P5", b"P6") else _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else None
    except (ValueError, struct.error, zlib.error, IndexError):
        return None


#: How files of media begin, read or not; others at a later place.
_BEGINS = (b"\xff\xd8\xff", b"GIF8", b"\x89PNG\r\n\x1a\n", b"BM", b"II*\0", b"MM\0*", b"OggS", b"fLaC", b"ID3", b"\x1aE\xdf\xa3", b"\xff\x0a", b"\0\0\x01\0", *(b"P%d" % k for k in range(1, 8)))
_LATER = ((b"RIFF", 0), (b"ftyp", 4), (b"JXL ", 4))


def file_digest(data: bytes | None) -> bytes | None:
    """Of the bytes of a media file that decode() does not read; None for what does not begin like one. It equals no picture's digest."""
    if not data or not (data.startswith(_BEGINS) or any(data[at : at + 4] == x for x, at in _LATER)):
        return None
    return b"file" + hashlib.sha256(data).digest()


def _grey(x: np.ndarray) -> np.ndarray:
    return x[..., 0] if x.shape[-1] < 3 else np.round(x[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)).astype(np.uint8)


def _pnm(data: bytes) -> np.ndarray:
    """Three numbers after the kind, between blanks and comments, then one blank and the pixels."""
    at, numbers = 2, []
    while len(numbers) < 3:
        begin = at
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:
                at = data.find(b"\n", at)
                if at < 0:
                    raise ValueError("a header without its end")
            at += 1
        end = at
        while end < len(data) and end - at < 10 and data[end : end + 1].isdigit():
            end += 1
        if at == begin or end == at:
            raise ValueError("not a PNM header")
        numbers.append(int(data[at:end]))
        at = end
    w, h, most = numbers
    n = 1 if data[:2] == b"P5" else 3
    if most != 255 or not data[at : at + 1].isspace() or w * h > MOST_PIXELS:
        raise ValueError("not a PNM of 8 bits")
    return _grey(np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape(h, w, n))


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6) or head[0] * head[1] > MOST_PIXELS:
        raise ValueError("not a plain PNG of 8 bits")
    w, h, step = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    size = h * (w * step + 1)
    # no more is unpacked than the header asks for
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), size), np.uint8)[:size].reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(w, step), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = np.array(_unfiltered(int(kind), line.tolist(), above.tolist(), step), np.uint8)
        out[y] = above = line
    x = out.reshape(h, w, step)
    return _grey(palette[x[..., 0]] if palette is not None and head[3] == 3 else x)


def _unfiltered(kind: int, line: list[int], above: list[int], step: int) -> list[int]:
    """A line of averages (3) or of the Paeth predictor (4), whose pixels need the one before them."""
    for x, b in enumerate(above):
        a, c = (line[x - step], above[x - step]) if x >= step else (0, 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if p <= q and p <= r else b if q <= r else c
        line[x] = (line[x] + guess) & 255
    return line


def pgm(x: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + np.ascontiguousarray(x, np.uint8).tobytes()


def digest(x: np.ndarray) -> bytes:
    return hashlib.sha256(struct.pack("<II", *x.shape) + np.ascontiguousarray(x).tobytes()).digest()


@lru_cache(maxsize=256)
def _reducer(old: int, new: int) -> np.ndarray:
    """Rows of weights that resample a side; a triangle as wide as the reduction."""
    wide = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(old)[None, :] - centre[:, None]) / wide)
    return (w / w.sum(1, keepdims=True)).astype(np.float32)


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return _reducer(x.shape[-2], h) @ x.astype(np.float32) @ _reducer(x.shape[-1], w).T


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r + 1; at the edges over what is there, repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        p = np.pad(x, pad, mode="edge")
        n = x.shape[axis]
        x = sum(p.take(range(k, k + n), axis) for k in range(2 * r + 1))
    return x


@lru_cache(maxsize=1)
def _turned() -> np.ndarray:
    """The test points' offsets for each direction: (turn, bit, point, y and x)."""
    a = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], -1), np.stack([-np.sin(a), np.cos(a)], -1)], -2)
    return np.rint(np.einsum("tij,bpj->tbpi", turn, _PAIRS)).astype(np.int64)


_DISC = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])


def describe(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of pictures of one shape: for each its corners (complex places, at the reduced scale where a side is longer than MOST_SIDE) and descriptors (rows of four 64-bit words)."""
    n, height, width = stack.shape
    if max(height, width) > MOST_SIDE:
        k = MOST_SIDE / max(height, width)
        small = resized(stack, max(1, round(height * k)), max(1, round(width * k)))
        return describe(small)
    base = stack.astype(np.float32)
    owner, place, words = [], [], []
    more = max(1.0, (height * width) ** 0.5 / BASE_SIDE)
    for level, most in enumerate(CORNERS + CORNERS[-1:] * int(np.log(more) / np.log(STEP))):
        h, w = round(height / STEP**level), round(width / STEP**level)
        if min(h, w) <= 2 * BORDER + 2:
            break
        x = base if level == 0 else resized(base, h, w)
        smooth = _box(x, 1) / 9
        gy, gx = np.zeros_like(x), np.zeros_like(x)
        gy[:, 1:-1], gx[:, :, 1:-1] = smooth[:, 2:] - smooth[:, :-2], smooth[:, :, 2:] - smooth[:, :, :-2]
        yy, xx, xy = _box(gy * gy, 2), _box(gx * gx, 2), _box(gx * gy, 2)
        r = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        top = r.copy()
        for dy, dx in ((1, 0), (0, 1), (1, 1), (1, -1)):
            for s in (1, -1):
                np.maximum(top, np.roll(r, (s * dy, s * dx), (1, 2)), out=top)
        inner = np.zeros((h, w), bool)
        inner[BORDER:-BORDER, BORDER:-BORDER] = True
        score = np.where((r >= top) & inner & (r > 1e4), r, -1.0).reshape(n, -1)
        most = min(round(most * more), score.shape[1])
        chosen = np.argpartition(-score, most - 1, axis=1)[:, :most]
        who, at = np.nonzero(np.take_along_axis(score, chosen, 1) > 0)
        flat = chosen[who, at]
        if not len(flat):
            continue
        patch = x.reshape(n, -1)[who[:, None], flat[:, None] + (_DISC[:, 0] * w + _DISC[:, 1])[None, :]]
        angle = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        offsets = _turned()[turn]
        soft = _box(x, 2).reshape(n, -1)
        values = soft[who[:, None, None], flat[:, None, None] + offsets[..., 0] * w + offsets[..., 1]]
        bits = values[..., 0] < values[..., 1]
        owner.append(who)
        place.append(((flat % w + 0.5) * (width / w) - 0.5) + 1j * ((flat // w + 0.5) * (height / h) - 0.5))
        words.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
    if not owner:
        return [(np.zeros(0, complex), np.zeros((0, 4), np.uint64))] * n
    owner, place, words = np.concatenate(owner), np.concatenate(place), np.concatenate(words)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(n + 1))
    return [(place[order[a:b]], words[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def keys(words: np.ndarray) -> np.ndarray:
    """The descriptors' keys in all tables, distinct."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
    found = [bits[:, k].astype(np.uint64) @ w[1:] + w[0] for k, w in zip(_KEYS, _WEIGHTS, strict=True)]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *found])).view(np.int64)


#: Bytes of a corner: two coordinates in eighths of a pixel and its descriptor.
PACKED = 4 + BITS // 8


def pack(places: np.ndarray, words: np.ndarray) -> bytes:
    xy = np.clip(np.rint(np.stack([places.real, places.imag], 1) * 8), -32768, 32767)
    return xy.astype("<i2").tobytes() + np.ascontiguousarray(words, "<u8").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // PACKED
    if not n:
        return np.zeros(0, complex), np.zeros((0, 4), np.uint64)
    p = np.frombuffer(data, "<i2", 2 * n).reshape(n, 2) / 8
    return p[:, 0] + 1j * p[:, 1], np.frombuffer(data, "<u8", 4 * n, 4 * n).reshape(n, 4)


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Corners of two pictures that the best shift, turn and scale brings together; close descriptors that are each other's nearest count as pairs."""
    (pa, wa), (pb, wb) = a, b
    if len(pa) < AGREE or len(pb) < AGREE:
        return 0
    apart = np.bitwise_count(wa[:, None, :] ^ wb[None, :, :]).sum(2, dtype=np.int32)
    near = apart.argmin(1)
    i = np.flatnonzero((apart[np.arange(len(pa)), near] <= CLOSE) & (apart.argmin(0)[near] == np.arange(len(pa))))
    if len(i) < AGREE:
        return 0
    z, w = pa[i], pb[near[i]]
    s, t = np.triu_indices(len(i), 1)
    far = np.abs(z[t] - z[s]) > 8
    s, t = s[far], t[far]
    if not len(s):
        return 0
    scale = (w[t] - w[s]) / (z[t] - z[s])
    size = np.abs(scale)
    fine = (size > 0.4) & (size < 2.5)
    scale, size, s = scale[fine], size[fine], s[fine]
    if not len(s):
        return 0
    miss = np.abs(scale[:, None] * z[None, :] + (w[s] - scale * z[s])[:, None] - w[None, :])
    hits = miss <= MISS * np.maximum(1, size)[:, None]
    best = hits[hits.sum(1).argmax()]
    # corners that stand at one place on several scales count once
    return len(np.unique(np.rint(z[best] / 3)))


def linked(x: bytes, y: bytes) -> bool:
    """Of two pictures' packed corners, whichever comes first: enough of them agree."""
    return agreeing(*map(unpack, sorted((x, y)))) >= AGREE
