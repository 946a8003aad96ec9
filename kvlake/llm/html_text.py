"""The main text of web pages: a linear-chain conditional random field over leaf blocks.

A block's features are the tags and names above it and the shape of its text; neighbours speak through
the transitions. The field is trained on labelled pages by the gradient of its likelihood, in numpy on
the driver, and pages are decoded by Viterbi where they are read. Tasks carry a few thousand weights.
Only what a browser doesn't show as text is left out beforehand (code, embedded media, form fields'
choices, elements marked as hidden); the field decides on the rest.
Defined results:
* null or empty html: an empty text; a page without article blocks: an empty text
* repeated rows and null ids come back as they are; empty table: no rows; other columns are not touched
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_samples
from .html_blocks import KIND_OF, Block, blocks
from .shared import batches_of

#: Labelled pages that the field is trained on, and steps at most.
PAGES, ROUNDS = 1500, 120
DECAY = 0.02
#: A feature that fewer pages have gets no weight.
LEAST_PAGES = 4
BATCH = 256


def _band(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def shape(page: list[Block]) -> list[set[str]]:
    """Of each block the features of its own: its text's shape, its place and its nearest elements."""
    out, total = [], len(page)
    for k, b in enumerate(page):
        n, node = len(b.text), b.node
        f = {"p" + x for x in node.own}
        f.update((f"path={b.path},{node.named}", f"near={node.near}", f"near={node.near},{b.path}"))
        f.update((f"named={node.named}", f"named={node.named},{node.in_main}"))
        link = _band(b.linked / n, 0.01, 0.3, 0.6, 0.95)
        stops = sum(map(b.text.count, ".?!。"))
        f.add(f"len={(size := _band(n, 4, 15, 40, 90, 200, 500))}")
        f.add(f"link={link}")
        f.add(f"stops={_band(stops, 1, 2, 4)}")
        f.add(f"shape={size},{min(stops, 2)},{min(link, 3)}")
        f.add(f"end={b.text[-1] in '.?!:”»。'}")
        f.add(f"mark={b.text[0] in '©'}")
        f.add(f"place={_band(k / total, 0.1, 0.3, 0.7, 0.9)}")
        f.add("bias")
        if k == total - 1:
            f.add("last")
        out.append(f)
    return out


def features(page: list[Block]) -> list[set[str]]:
    """Of each block, by name: its own, and those of all elements above."""
    return [f | b.above for f, b in zip(shape(page), page, strict=True)]


class Field:
    """Two states, 1 for the article's blocks. ``weights`` speak for state 1, ``moves[i, j]`` for state j after i."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, moves: np.ndarray):
        self.weights, self.start, self.moves = weights, start, moves

    def labels(self, page: list[Block]) -> list[int]:
        if not page:
            return []
        get = lambda x: self.weights.get(x, 0.0)
        # what stands above is added up along the elements, which blocks share
        emit = [sum(map(get, f)) + b.node.weight(get) for f, b in zip(shape(page), page, strict=True)]
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = float(self.start[0]), float(self.start[1]) + emit[0]
        back = []
        for e in emit[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((a < b, c < d))
            s0, s1 = max(a, b), max(c, d) + e
        out = [int(s1 > s0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return "\n\n".join(b.text for b, y in zip(found, self.labels(found), strict=True) if y)


def aligned(page: list[Block], truth: list[str]) -> list[int]:
    """Labels of a page's blocks, when the article's blocks are known by text and in order."""
    out, k = [], 0
    for b in page:
        hit = k < len(truth) and b.text == truth[k]
        out.append(int(hit))
        k += hit
    return out


def train(labelled: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS) -> Field:
    """The least of the mean negative log-likelihood with an L2 penalty, by L-BFGS; all pages are one padded batch."""
    # the longest first, so that the pages which reach a place are the first ones
    labelled = sorted((x for x in labelled if x[0]), key=lambda x: -len(x[0]))
    rows = [features(p) for p, _ in labelled]
    seen: dict[str, int] = {}
    for page in rows:
        for x in set().union(*page):
            seen[x] = seen.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= LEAST_PAGES))}
    n, longest = len(rows), max(map(len, rows), default=1)
    there = np.zeros((longest, n), bool)
    y = np.zeros((longest, n), np.int64)
    # blocks of equal features are one row of the feature matrix
    distinct: dict[tuple, int] = {}
    which = np.zeros((longest, n), np.int64)
    for i, (page, (_, labels)) in enumerate(zip(rows, labelled, strict=True)):
        there[: len(page), i], y[: len(page), i] = True, labels
        for t, f in enumerate(page):
            which[t, i] = distinct.setdefault(tuple(sorted(index[x] for x in f if x in index)), len(distinct))
    count = np.array([len(f) for f in distinct] or [0])
    cell = np.repeat(np.arange(len(count)), count)
    col = np.array([c for f in distinct for c in f], np.int64)
    pairs, active = there[1:], there.sum(1)
    truth = (2 * y[:-1] + y[1:])[pairs]

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, start, moves = theta[: len(index)], theta[-6:-4], theta[-4:].reshape(2, 2)
        score = np.bincount(cell, w[col], minlength=len(count))[which]
        ahead, behind = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        ahead[0] = start + np.stack([np.zeros(n), score[0]], -1)
        for t in range(1, longest):
            m = active[t]
            ahead[t, m:] = ahead[t - 1, m:]
            for s in (0, 1):
                ahead[t, :m, s] = np.logaddexp(ahead[t - 1, :m, 0] + moves[0, s], ahead[t - 1, :m, 1] + moves[1, s]) + s * score[t, :m]
        whole = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
        for t in range(longest - 2, -1, -1):
            m = active[t + 1]
            zero, one = behind[t + 1, :m, 0], score[t + 1, :m] + behind[t + 1, :m, 1]
            for s in (0, 1):
                behind[t, :m, s] = np.logaddexp(zero + moves[s, 0], one + moves[s, 1])
        node = np.exp(ahead + behind - whole[None, :, None]) * there[..., None]
        emit = np.stack([np.zeros_like(score), score], -1)
        edge = np.exp(ahead[:-1, :, :, None] + moves + (emit + behind)[1:, :, None, :] - whole[None, :, None, None]) * pairs[..., None, None]
        g = np.zeros_like(theta)
        off = np.bincount(which.ravel(), ((node[..., 1] - y) * there).ravel(), minlength=len(count))
        g[: len(index)] = np.bincount(col, off[cell], minlength=len(index))
        g[-6:-4] = node[0].sum(0) - np.bincount(y[0], minlength=2)
        g[-4:] = edge.sum((0, 1)).ravel() - np.bincount(truth, minlength=4)
        said = (y * there * score).sum() + start[y[0]].sum() + moves.ravel()[truth].sum()
        return float((whole.sum() - said) / n + DECAY / n / 2 * (theta @ theta)), g / n + DECAY / n * theta

    theta = least(loss, np.zeros(len(index) + 6), rounds) if n else np.zeros(6)
    return Field(dict(zip(index, theta.tolist(), strict=False)), theta[-6:-4], theta[-4:].reshape(2, 2))


def least(f, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Where a smooth convex function is least: limited-memory quasi-Newton steps, each shortened until it goes down enough. ``f`` gives value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, weights = g.copy(), []
        for s, d, r in reversed(past):
            weights.append(r * (s @ step))
            step -= weights[-1] * d
        if past:
            s, d, r = past[-1]
            step *= 1 / (r * (d @ d))
        for (s, d, r), a in zip(past, reversed(weights), strict=True):
            step += (a - r * (d @ step)) * s
        slope, size = g @ step, 1.0 if past else 1 / max(1.0, float(np.abs(g).sum()))
        while (trial := f(x - size * step))[0] > value - 1e-4 * size * slope and size > 1e-10:
            size /= 2
        if size <= 1e-10:
            break
        new, d = x - size * step, trial[1] - g
        if (size * step) @ -d > 1e-12:
            past = [*past[-(memory - 1) :], (-size * step, d, 1 / float((-size * step) @ d))]
        done = abs(value - trial[0]) <= 1e-7 * max(1.0, abs(value))
        x, (value, g) = new, trial
        if done:
            break
    return x


def labelled_pages(seeds: range, names: dict[str, list[str]] = html_samples.NAMES, main: list[str] = html_samples.MAIN, kind_of: dict[str, str] = KIND_OF) -> list[tuple[list[Block], list[int]]]:
    """Made-up pages whose parts have ``names``, read with the kinds that ``kind_of`` knows."""
    out = []
    for s in seeds:
        page, truth = html_samples.page(s, names, main)
        found = blocks(page, kind_of)
        out.append((found, aligned(found, truth)))
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages(range(PAGES)))


def main_text(pages: DataFrame, field: Field | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text for each row."""
    field = field or default_field()
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.start, field.moves))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Field(*sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f.text(x.as_py()) for x in b.column(2)], pa.string())], ["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    with batches_of(pages.sparkSession, BATCH):
        return pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(of, f"id {kind}, url string, text string")
