"""Column expressions of the data model; all built-in, so they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MAX_RECORD_BYTES, NEVER, OVERFLOW, SHARDS, TOMBSTONED, TYPE_TAGS


def expired(expiry: Column, now) -> Column:
    """Alive at the expiry second itself; 0 never expires."""
    return (expiry != 0) & (F.lit(now) > expiry)


def tombstoned(state: Column) -> Column:
    return state == TOMBSTONED


def live(expiry: Column, state: Column, now) -> Column:
    return (state == 0) & ~expired(expiry, now)


def expiry_of(ttl: Column, now) -> Column:
    return F.when(ttl > 0, F.lit(now) + ttl).otherwise(F.lit(NEVER)).cast("long")


def ttl_left(expiry: Column, state: Column, now) -> Column:
    """Whole seconds to the expiry; 0 for what is missing or dead."""
    return F.when(live(expiry, state, now), expiry - F.lit(now)).otherwise(F.lit(0)).cast("long")


def read_code(found: Column, expiry: Column, state: Column, now, *, merged: bool = False) -> Column:
    """1000, 5001 or 5002; with ``merged`` (the log-structured engine) a dead record is just not found."""
    dead = F.lit(5001) if merged else F.lit(5002)
    return F.when(~found | F.coalesce(tombstoned(state), F.lit(True)), F.lit(5001)).when(expired(expiry, now), dead).otherwise(F.lit(1000)).cast("int")


def too_big(value: Column, limit: int = MAX_RECORD_BYTES) -> Column:
    """Only text has a limit, in bytes."""
    return F.octet_length(value) > limit


# Memory model: scalars by width, text 16 + bytes, arrays 24 + elements, maps 48 + keys and values.
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8}


def size_of(value: Column, kind: T.DataType) -> Column:
    if type(kind) in _WIDTH:
        return F.lit(_WIDTH[type(kind)]).cast("long")
    if isinstance(kind, T.StringType):
        return (F.octet_length(value) + 16).cast("long")
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.transform(value, lambda x: size_of(x, kind.elementType)), F.lit(24).cast("long"), lambda a, x: a + x)
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: size_of(e["key"], kind.keyType) + size_of(e["value"], kind.valueType))
        return F.aggregate(pairs, F.lit(48).cast("long"), lambda a, x: a + x)
    raise ValueError(f"unsupported type: {kind.simpleString()}")


def entry_size(key: Column, value: Column, kind: T.DataType) -> Column:
    """A record in a memory table: the key's bytes, 16 for expiry and state, and the value."""
    return (F.octet_length(key) + 16 + size_of(value, kind)).cast("long")


def block_entry_size(key: Column, encoded: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(encoded) + 16).cast("long")


def overflown(used: Column, allowed: Column) -> Column:
    return used > allowed * OVERFLOW


def type_tag(kind: T.DataType) -> int:
    if isinstance(kind, T.NullType):
        return TYPE_TAGS["nil"]
    if isinstance(kind, T.BooleanType):
        return TYPE_TAGS["bool"]
    if isinstance(kind, T.IntegralType):
        return TYPE_TAGS["int"]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return TYPE_TAGS["float"]
    if isinstance(kind, T.StringType):
        return TYPE_TAGS["string"]
    if isinstance(kind, T.ArrayType):
        return TYPE_TAGS["slice"]
    return TYPE_TAGS["map"] if isinstance(kind, T.MapType) else TYPE_TAGS["raw"]


def type_tag_of(value: Column, kind: T.DataType) -> Column:
    return F.when(value.isNull(), F.lit(TYPE_TAGS["nil"])).otherwise(F.lit(type_tag(kind))).cast("int")


def writeable(kind: T.DataType) -> bool:
    """Null, scalars and arrays of scalars; maps, structs and dates are not values."""
    scalar = lambda k: isinstance(k, (T.NullType, T.BooleanType, T.StringType, T.IntegralType, T.FloatType, T.DoubleType))
    return scalar(kind) or (isinstance(kind, T.ArrayType) and (scalar(kind.elementType) or isinstance(kind.elementType, T.VariantType)))


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_number(kind: T.DataType) -> bool:
    return is_integer(kind) or is_float(kind)


def is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def index_in(items: Column, value: Column) -> Column:
    """Place from 0, or -1."""
    return (F.array_position(items, value) - 1).cast("int")


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def pack(first: Column, second: Column) -> Column:
    """Two signed 32-bit numbers in one 64-bit number."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(second.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_first(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def unpack_second(packed: Column) -> Column:
    low = packed.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def fnv1a32(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a number from 0."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.substring(F.hex(F.encode(key, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.octet_length(key) > 0, codes).otherwise(F.array().cast("array<long>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")) % F.lit(4294967296))


def fnv1a64(key: Column) -> Column:
    """FNV-1a over the UTF-8 bytes in 64 bits, as a signed long.

    The hash is kept as two halves, so that no product passes 64 bits: the prime is 2^40 + 435, which
    moves the low half up by 8 bits into the high one and adds 435 times both.
    """
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.substring(F.hex(F.encode(key, "UTF-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    codes = F.when(F.octet_length(key) > 0, codes).otherwise(F.array().cast("array<long>"))
    low32 = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        product = low * 435
        high = (h["high"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(low32)
        return F.struct(high.alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    return F.aggregate(codes, start, step, lambda h: F.shiftleft(h["high"], 32).bitwiseOR(h["low"]))


def block_id(first: Column, last: Column) -> Column:
    """A block's name in a cache: the hash of its bounds."""
    return fnv1a64(F.concat(first, last))


def record_json(value: Column, lat: Column, expiry: Column, state: Column) -> Column:
    """A record as a JSON object."""
    return F.to_json(F.struct(value.alias("value"), lat.alias("lat"), expiry.alias("expiry"), state.alias("state")))


def record_of(text: Column, kind: T.DataType) -> Column:
    """The record that a JSON object holds; null for anything else."""
    return F.from_json(text, f"value {kind.simpleString()}, lat long, expiry long, state tinyint")


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    return (fnv1a32(key) % shards).cast("int")


def seconds_since(then: Column, now) -> Column:
    return F.lit(now) - then


def readable(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss")


def checksum(data: Column) -> Column:
    return F.crc32(data)


def bloom_size(keys: float, rate: float) -> tuple[int, int]:
    """Bits and hash functions for so many keys at a rate of false positives."""
    bits = -keys * math.log(rate) / math.log(2) ** 2
    return math.ceil(bits), math.ceil(math.log(2) * bits / keys)


def bloom_hashes(bits: int, rate: float) -> int:
    """Hash functions of a filter of given bits; a rate outside (0, 1) counts as 0.01."""
    rate = rate if 0 < rate < 1 else 0.01
    return max(1, math.ceil(-math.log(rate) / math.log(2)))


def gossip_fanout(nodes: int) -> int:
    return 3 if nodes <= 9 else math.ceil(2 * math.sqrt(nodes))
