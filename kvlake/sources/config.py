"""Settings from TOML, checked; what is missing or out of range takes its default."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from ..model import BLOCK_BYTES, MAX_RECORD_BYTES, RUNS_PER_LEVEL


@dataclass(frozen=True)
class Settings:
    engine: str = "MEMORY"
    max_record_bytes: int = MAX_RECORD_BYTES
    memory_limit: int = 1 << 30
    snapshot_seconds: int = 10
    bloom_records: int = 1_000_000
    bloom_rate: float = 0.01
    block_bytes: int = BLOCK_BYTES
    write_buffer_bytes: int = 64 << 20
    log_flush_seconds: int = 5
    expiry_seconds: int = 5
    eviction: str = "NONE"
    runs_per_level: int = RUNS_PER_LEVEL


_ALLOWED = {"engine": {"MEMORY", "LSM"}, "eviction": {"NONE", "LRU"}}


def settings(text: str) -> Settings:
    """The [storage] table of a TOML document, its keys those of ``Settings``."""
    given = tomllib.loads(text).get("storage", {})
    out = {}
    for f in fields(Settings):
        v = given.get(f.name, f.default)
        v = v.upper() if isinstance(v, str) else v
        right = type(v) is type(f.default) and (v in _ALLOWED[f.name] if f.name in _ALLOWED else v > 0)
        out[f.name] = v if right and (f.name != "bloom_rate" or v < 1) else f.default
    return Settings(**out)
