"""BPE encoding and decoding through a table of distinct words.

Texts are split by the tokenizer's own pattern into words, which never merge with each other. Texts
stay in blocks of bounded size: a block keeps its distinct words and, for each text, the places of
its words among them. Words of all blocks are dealt into parts by their hash, a part's distinct words
are encoded once each, and the ids go back to the blocks that asked. A block then lays its words'
ids out by position; its distinct ids meet the id-to-piece table in a hash join, and the pieces are laid
out the same way.

Only distinct words cross the network, as a row for each block and part; parts have an upper bound, so
rows grow with the input. A part is read block by block and holds its distinct words alone. Places are
written once, in a table bucketed by block, so that the join back moves the words' ids alone. The
id-to-piece table has as many rows as the vocabulary (tens of thousands), which bounds what is
broadcast. Defined results:
* null text: no ids, an empty text; ids of rows are carried as they are, null or repeated
* the strings of special tokens in a text become those tokens, as the tokenizers library has it
* empty table: no rows; columns of the input beside the named ones are not touched
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches_of, free, give_back, lean, named_table, own, plan_bytes, scratch, written

# Fixed value: the pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in a block.
BLOCK_CHARS = 12 << 20
#: Bytes of words in a part, all blocks' words counted, until there are MOST_PARTS of them.
PART_BYTES, MOST_PARTS = 8 << 20, 2048
#: Words whose ids a task keeps at once; beyond it a word may be encoded again.
KEPT_WORDS = 1 << 20
#: Rows of a part that are looked up together.
ROWS = 64
#: Texts in an Arrow batch.
BATCH = 256
#: Bytes of input for each bucket of the table of places.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 50_000


@lru_cache(maxsize=2)
def _tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def specials(spec: str) -> list[str]:
    return [a["content"] for a in json.loads(spec).get("added_tokens", []) if a.get("special")]


def splitter(spec: str):
    """Text to its words; special tokens' strings are words of their own, the longest first."""
    marks = sorted(specials(spec), key=len, reverse=True)
    words = regex.compile(PATTERN).findall
    if not marks:
        return words
    cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")")

    def of(text: str) -> list[str]:
        if not any(m in text for m in marks):
            return words(text)
        out = []
        for k, piece in enumerate(cut.split(text)):
            out += [piece] if k % 2 else words(piece)
        return out

    return of


def pieces_of(spec: str) -> list[bytes]:
    """The bytes of each id: a byte-level vocabulary writes bytes that are not printable as later characters."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(other)}
    model = json.loads(spec)
    names = {i: w for w, i in model["model"]["vocab"].items()} | {a["id"]: a["content"] for a in model.get("added_tokens", [])}
    raw = lambda w: bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode()
    return [raw(names[i]) if i in names else b"" for i in range(max(names) + 1)]


def piece_table(spark: SparkSession, spec: str) -> DataFrame:
    """id and piece (binary): a row for each id of the vocabulary."""
    return spark.createDataFrame(list(enumerate(map(bytearray, pieces_of(spec)))), "token int, piece binary")


#: Words are ordered by their hash's cell; a part is a range of cells.
CELLS = 1 << 16
_PLACES = T.StructType([T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), *[T.StructField(c, T.BinaryType()) for c in ("cells", "order", "lengths", "places")], T.StructField("word_bytes", T.LongType())])


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte plane, compressed: of small numbers the high planes vanish."""
    planes, packer = np.ascontiguousarray(x, "<i4").view(np.uint8).reshape(-1, 4), zlib.compressobj(1)
    return b"".join([*(packer.compress(np.ascontiguousarray(planes[:, k])) for k in range(4)), packer.flush()])


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _blocks(docs: DataFrame, spec: str) -> DataFrame:
    """``docs`` has id and text. A row for each block: its ids, its words by cell, texts' lengths in words and the words' places.

    Places count words as they first came, so that frequent words have small numbers; ``order`` has the
    place of each listed word.
    """
    schema = T.StructType([*_PLACES.fields, T.StructField("ids", T.ArrayType(docs.schema["id"].dataType))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n_block = splitter(spec), TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            """Empties ``known`` as soon as it is read: its words are most of a task's memory."""
            words, word_bytes = pa.array(list(known), pa.string()), sum(map(len, known))
            cells = np.fromiter((zlib.crc32(w.encode()) & (CELLS - 1) for w in known), np.int32, len(known))
            known.clear()
            order = np.argsort(cells, kind="stable")
            words = words.take(pa.array(order))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            packed = [pa.array([_pack(x)], pa.binary()) for x in (cells[order], order, np.array(lengths, np.int32), np.concatenate([np.zeros(0, np.int32), *places]))]
            arrays = [pa.array([n_block], pa.int64()), listed(words), *packed, pa.array([word_bytes], pa.int64()), listed(pa.concat_arrays(ids))]
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

        known, ids, lengths, places, size = {}, [], [], [], 0
        for b in batches:
            ids.append(b.column(0))
            for t in b.column(1):
                text = t.as_py() or ""
                w = split(text)
                for x in w:
                    if x not in known:
                        known[x] = len(known)
                places.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
                lengths.append(len(w))
                size += len(text)
            if size >= BLOCK_CHARS:
                yield block()
                known, ids, lengths, places, size = {}, [], [], [], 0
                n_block += 1
                give_back()
        if ids:
            yield block()

    return docs.mapInArrow(lean(of), schema)


def _asked(table: DataFrame, parts: int) -> DataFrame:
    """Each block's words by part: (part, block, sizes, words), both packed; a block's parts are in the order of its words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, cells in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = words.values
                part = _unpack(cells).astype(np.int64) * parts // CELLS
                cuts = np.searchsorted(part, np.arange(parts + 1))
                ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
                data = memoryview(words.buffers()[2] or b"")
                rows = [(p, _pack(np.diff(ends[x : y + 1])), zlib.compress(data[ends[x] : ends[y]], 1)) for p, x, y in zip(range(parts), cuts[:-1], cuts[1:], strict=True) if x < y]
                cells_out = [pa.array([p for p, *_ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([s for _, s, _ in rows], pa.binary()), pa.array([w for *_, w in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells_out, ["part", "block", "sizes", "words"])

    return table.select("block", "words", "cells").mapInArrow(lean(of), "part int, block long, sizes binary, words binary")


def _strings(sizes: np.ndarray, data: bytes) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


class _Coded:
    """The ids of the distinct words of a part, one word after another."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.count, self.start, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for e in ids for i in e), np.int32, int(count.sum()))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], flat, np.zeros(self.used, np.int32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
            self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used += len(flat)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def _answer(asked: DataFrame, spec: str) -> DataFrame:
    """A part's distinct words are encoded once each; every block gets its words' ids, in its own order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, at = _Coded(_tokenizer(spec)), None
        for b in batches:
            parts = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in ((k, min(k + ROWS, y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True) for k in range(x, y, ROWS)):
                if at != parts[lo] or len(coded.place) > KEPT_WORDS:
                    coded.clear()
                    at = parts[lo]
                lists = [_strings(_unpack(s), zlib.decompress(w)) for s, w in zip(b.column(2).slice(lo, hi - lo).to_pylist(), b.column(3).slice(lo, hi - lo).to_pylist(), strict=True)]
                named = pa.concat_arrays(lists).dictionary_encode()
                own = coded.places(named.dictionary.to_pylist())[named.indices.to_numpy()]
                ends = np.cumsum([0, *map(len, lists)])
                rows = [own[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                counts = [_pack(coded.count[w]) for w in rows]
                tokens = [_pack(coded.flat[_runs(coded.start[w], coded.count[w])]) for w in rows]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo), pa.array(counts, pa.binary()), pa.array(tokens, pa.binary())], ["block", "part", "counts", "tokens"])

    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(lean(of), "block long, part int, counts binary, tokens binary")


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each run, one run after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def encode_decode(docs: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens (the text's ids in order) and decoded (the text of those ids) for each row. ``spec`` is a tokenizer file's JSON."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    size = plan_bytes(docs)
    # rows that are not from files have no known size
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if size >= 1 << 60 else min(max(8, math.ceil(size / BUCKET_BYTES)), MOST_BUCKETS)
    name = named_table(f"kvlake_places_{uuid.uuid4().hex}")
    with batches_of(spark, BATCH):
        blocks = _blocks(rows, spec)
        blocks.write.bucketBy(buckets, "block").option("path", scratch(spark, "bpe-places")).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    size = table.agg(F.coalesce(F.sum("word_bytes"), F.lit(0)).alias("b")).first().b
    parts = min(max(8, math.ceil(size / PART_BYTES)), MOST_PARTS)
    with batches_of(spark, 1):
        asked = written(_asked(table, parts), "bpe-asked", "uncompressed")
    answers = _answer(asked, spec)
    pieces = pieces_of(spec)
    sent = spark.sparkContext.broadcast(pa.table({"token": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}))
    schema = T.StructType([T.StructField("id", kind), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def lay(t: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        for ids, *packed in zip(*[t.column(c) for c in ("ids", "order", "lengths", "places")], strict=True):
            order, lengths, places = (_unpack(x.as_py()) for x in packed)
            words = words.sort_by("part")
            join = lambda name: np.concatenate([np.zeros(0, np.int32), *map(_unpack, words.column(name).to_pylist())])
            got, flat = join("counts").astype(np.int64), join("tokens")
            count, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            count[order], start[order] = got, np.cumsum(got) - got
            # the id-to-piece join of the block's distinct ids
            distinct, at_id = np.unique(flat, return_inverse=True)
            joined = pa.table({"token": pa.array(distinct, pa.int32())}).join(sent.value, "token", join_type="inner", use_threads=False).sort_by("token")
            pieces = joined.column("piece").to_pylist()
            named, text_of = at_id.tolist(), [b""] * len(order)
            for w, (a, n) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
                text_of[w] = pieces[named[a]] if n == 1 else b"".join(map(pieces.__getitem__, named[a : a + n]))
            ends = np.cumsum(lengths)
            for lo in range(0, len(lengths), BATCH):
                hi = min(lo + BATCH, len(lengths))
                first = ends[lo] - lengths[lo]
                part = places[first : ends[hi - 1]]
                tokens = flat[_runs(start[part], count[part])]
                offsets = np.concatenate([[0], np.cumsum(count[part])])[np.concatenate([[0], ends[lo:hi] - first])]
                texts, at_word = [], part.tolist()
                for k in range(lo, hi):
                    a = ends[k] - lengths[k] - first
                    texts.append(b"".join(map(text_of.__getitem__, at_word[a : a + lengths[k]])).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([ids.values[lo:hi], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32())), pa.array(texts, pa.string())], ["id", "tokens", "decoded"])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        done = list(lay(left, right))
        give_back()
        return pa.Table.from_batches(done) if done else pa.table({f.name: pa.array([], left.column("ids").type.value_type if f.name == "id" else pa.list_(pa.int32()) if f.name == "tokens" else pa.string()) for f in schema.fields})

    placed = spark.table(name).select("block", "ids", "order", "lengths", "places").groupBy("block")
    return placed.cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def decode(encoded: DataFrame, spec: str, *, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """The rows with decoded, which replaces a column of that name: ids through a join with the id-to-piece table, laid out by position again. Unknown ids are nothing. Other columns are kept, whatever their names."""
    spark = encoded.sparkSession
    (row,) = free(encoded, "_row")
    rows = written(encoded.withColumn(row, F.monotonically_increasing_id()), "bpe-decode")
    at = rows.select(F.col(row).alias("_row"), F.posexplode(tokens_col).alias("_pos", "token"))
    found = at.join(F.broadcast(piece_table(spark, spec)), "token")
    text = F.array_sort(F.collect_list(F.struct("_pos", F.hex("piece").alias("p"))))
    decoded, match = free(rows, "_text", "_match")
    joined = found.groupBy(F.col("_row").alias(match)).agg(F.decode(F.unhex(F.array_join(F.transform(text, lambda x: x["p"]), "")), "UTF-8").alias(decoded))
    return rows.join(joined, F.col(row) == F.col(match), "left").select(*own(encoded, "decoded"), F.coalesce(decoded, F.lit("")).alias("decoded"))
