"""A column of pictures for tables that have none: each id has a picture, and ids of a family have edits of one.

Four ids in a row are a family, and every fifth family shows one and the same picture, so that a fifth
of all rows is one group of copies. The first of a family is the picture itself, the others are cut,
recoloured with noise, or made smaller under a caption.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pictures

SIDE = 96


def family(i: int) -> int:
    f = i // 4
    return 0 if f % 5 == 0 else f


def scene(seed: int, side: int = SIDE) -> np.ndarray:
    rng = np.random.default_rng([11, seed])
    y, x = np.mgrid[:side, :side]
    out = 90 + 60 * np.sin(x / rng.uniform(15, 40) + rng.uniform(0, 6)) * np.cos(y / rng.uniform(15, 40))
    for _ in range(26):
        cy, cx, ry, rx = rng.uniform(0, side, 2).tolist() + rng.uniform(3, side / 5, 2).tolist()
        inside = (np.abs(y - cy) < ry) & (np.abs(x - cx) < rx) if rng.random() < 0.7 else ((y - cy) / ry) ** 2 + ((x - cx) / rx) ** 2 < 1
        out[inside] = rng.uniform(0, 255)
    for cells, depth in ((side // 10, 30), (side // 4, 22)):  # surfaces of real things are never flat
        out += depth * pictures.resized(rng.normal(size=(cells, cells)), side, side)
    return np.clip(out, 0, 255).astype(np.uint8)


def picture(i: int, pixels: np.ndarray | None = None) -> np.ndarray:
    x, rng = scene(family(i)) if pixels is None else pixels, np.random.default_rng([12, i])
    if i % 4 == 1:
        a, b, c, d = (rng.integers(0, SIDE // 6, 4)).tolist()
        return x[a : SIDE - b, c : SIDE - d]
    if i % 4 == 2:
        return np.clip(x * rng.uniform(0.7, 1.1) + rng.uniform(-10, 20) + rng.normal(0, 3, x.shape), 0, 255).astype(np.uint8)
    if i % 4 == 3:
        small = pictures.resized(x, side := int(SIDE * rng.uniform(0.78, 0.95)), side)
        small[-10:] = 235
        return np.clip(small, 0, 255).astype(np.uint8)
    return x


def media_of(table: DataFrame, id_col: str) -> DataFrame:
    """id and media: a picture for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for k in range(0, len(ids), 256):
                part = ids[k : k + 256]
                scenes = {f: scene(f) for f in {family(i) for i in part if i is not None}}
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([None if i is None else pictures.pgm(picture(i, scenes[family(i)])) for i in part], pa.binary())], ["id", "media"])

    return table.select(F.col(id_col).cast("long")).mapInArrow(of, "id long, media binary")
