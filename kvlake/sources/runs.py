"""Sorted runs: Parquet files by key with a manifest, their flush, lookup and levelled compaction.

A run's pages are its blocks, their key ranges (the column index) the sparse index and Parquet's own
Bloom filter, sized by the keys that a row group has, the membership test; so a lookup by key reads few
pages of few row groups. A run's folder is never rewritten:
a compaction writes a new folder, then a new manifest names it in the old ones' place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import live
from ..model import BLOCK_BYTES, LEVELS, MANIFEST_SCHEMA, RUNS_PER_LEVEL
from ..operators.maintenance import run_metadata
from ..operators.resolve import newest
from . import files

#: Bytes of a row group, the rate of false positives of its Bloom filter, and that filter's bytes at most.
GROUP_BYTES, BLOOM_RATE, BLOOM_BYTES = 128 << 20, 0.01, 4 << 20


class RunStore:
    """Runs below ``root``: ``run=<id>`` folders and ``manifest-<version>`` tables, the newest of which counts.

    Records have key, value, expiry and state. A larger run id is a newer run. One writer at a time: a
    folder that no manifest names is what a failed write left, and the next write replaces it.
    """

    def __init__(self, spark: SparkSession, root: str, *, block_bytes: int = BLOCK_BYTES, codec: str = "lz4_raw"):
        self.spark, self.root, self.block_bytes, self.codec = spark, root.rstrip("/"), block_bytes, codec

    def _versions(self) -> list[int]:
        return files.versions(self.spark, self.root, "manifest")

    def manifest(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/manifest-{versions[-1]}")

    def _put_manifest(self, rows: list) -> None:
        last = (self._versions() or [0])[-1]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{self.root}/manifest-{last + 1}")

    def _writer(self, sorted_: DataFrame):
        writer = sorted_.write.option("compression", self.codec).option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", self.block_bytes)
        return writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", BLOOM_BYTES).option("parquet.bloom.filter.fpp#key", BLOOM_RATE)

    def _write(self, run_id: int, records: DataFrame) -> None:
        self._writer(records.repartitionByRange("key").sortWithinPartitions("key")).mode("overwrite").parquet(f"{self.root}/run={run_id}")

    def _folders(self) -> list[int]:
        fs, p = files._fs(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[4:]) for n in names if n.startswith("run="))

    def read(self, run_id: int) -> DataFrame:
        return files.reader(self.spark).parquet(f"{self.root}/run={run_id}")

    def flush(self, records: DataFrame, now: int, level: int = 0) -> int:
        """Writes the records as the newest run of a level; returns its id."""
        known = self.manifest().collect()
        run_id = max([0, *(r.run_id for r in known)]) + 1
        self._write(run_id, records)
        meta = run_metadata(self.read(run_id).withColumn("run_id", F.lit(run_id)))
        new = [(r.run_id, level, r.first_key, r.last_key, r.num_records, r.bytes, now) for r in meta.collect()]
        self._put_manifest([tuple(r) for r in known] + new)
        return run_id

    def load(self, records: DataFrame, now: int, level: int = 0) -> list[int]:
        """Writes records that come with run_id, a run for each id, in one pass over them; returns the ids.

        Ids have to be above those of the runs in the store; a null or lower one fails the write.
        """
        known = self.manifest().collect()
        last = max([0, *(r.run_id for r in known)])
        for r in set(self._folders()) - {r.run_id for r in known}:
            files.delete(self.spark, f"{self.root}/run={r}")
        new = F.when(F.col("run_id") > last, F.col("run_id")).otherwise(F.raise_error(F.lit(f"run_id has to be above {last}")).cast("long"))
        rows = records.withColumn("run", new).drop("run_id").repartitionByRange("run", "key").sortWithinPartitions("run", "key")
        self._writer(rows).partitionBy("run").mode("append").parquet(self.root)
        ids = [r for r in self._folders() if r > last]
        if ids:
            meta = run_metadata(self.versions(ids)).collect()
            self._put_manifest([tuple(r) for r in known] + [(r.run_id, level, r.first_key, r.last_key, r.num_records, r.bytes, now) for r in meta])
        return ids

    def versions(self, runs: list[int] | None = None) -> DataFrame:
        """All records of the runs with run_id: one scan, however many runs there are."""
        chosen = [r.run_id for r in self.manifest().select("run_id").collect()] if runs is None else runs
        if not chosen:
            return self.spark.createDataFrame([], "key string, value string, expiry long, state tinyint, run_id long")
        rows = files.reader(self.spark).option("basePath", self.root).parquet(*[f"{self.root}/run={r}" for r in chosen])
        return rows.withColumn("run_id", F.col("run").cast("long")).drop("run")

    def get(self, key: str, now: int) -> DataFrame:
        """The newest version of a key, if it is live: runs whose range holds it, then their filters."""
        may = self.manifest().filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("run_id").collect()
        return newest(self.versions([r.run_id for r in may]).filter(F.col("key") == key), ["run_id"]).filter(live(F.col("expiry"), F.col("state"), now))

    def state(self, now: int) -> DataFrame:
        return newest(self.versions(), ["run_id"]).filter(live(F.col("expiry"), F.col("state"), now))

    def compact(self, level: int, now: int, threshold: int = RUNS_PER_LEVEL) -> int | None:
        """Merges a level's runs with the next level's runs that their keys meet; returns the new run's id.

        The dead are dropped only where no older version can lie below: at the deepest level in use.
        """
        known = self.manifest().collect()
        own = [r for r in known if r.level == level]
        if len(own) < threshold or level + 1 >= LEVELS:
            return None
        low, high = min(r.first_key for r in own), max(r.last_key for r in own)
        met = [r for r in known if r.level == level + 1 and not (r.last_key < low or r.first_key > high)]
        used = {r.run_id for r in own + met}
        # a deeper level is older whatever its runs' ids are
        ranks = F.create_map(*[x for r in own + met for x in (F.lit(r.run_id).cast("long"), F.struct(F.lit(-r.level), F.lit(r.run_id).cast("long")))])
        merged = newest(self.versions(sorted(used)).withColumn("_rank", ranks[F.col("run_id")]), ["_rank"]).drop("_rank", "run_id")
        if not any(r.level > level + 1 for r in known):
            merged = merged.filter(live(F.col("expiry"), F.col("state"), now))
        run_id = max(r.run_id for r in known) + 1
        self._write(run_id, merged)
        meta = run_metadata(self.read(run_id).withColumn("run_id", F.lit(run_id))).collect()
        self._put_manifest([tuple(r) for r in known if r.run_id not in used] + [(r.run_id, level + 1, r.first_key, r.last_key, r.num_records, r.bytes, now) for r in meta])
        return run_id

    def clean(self) -> None:
        """Removes manifests but the newest, and runs that it does not name. Not while others read."""
        versions, keep = self._versions(), {r.run_id for r in self.manifest().collect()}
        for v in versions[:-1]:
            files.delete(self.spark, f"{self.root}/manifest-{v}")
        for r in self._folders():
            if r not in keep:
                files.delete(self.spark, f"{self.root}/run={r}")
