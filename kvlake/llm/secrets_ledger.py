"""Secret scans over an incremental ledger of blobs.

A blob is a text under its SHA-256. The ledger has a row for each blob and rule version that was
scanned, and the findings of each. A scan content-addresses every historical version it is given,
drops the pairs that the ledger has, scans the rest once each, appends, and joins the findings back
to all paths that ever held the blob.

Built-in functions only. Matches come with their places: the pieces between matches (a split by the
same pattern) and the matches alternate, so running lengths in code points are the spans. Patterns
match as stated and what fails a length test is dropped afterwards, so that a failing match still
consumes its text. Defined results:
* null text: an empty blob without findings; null paths are kept; repeated rows come back repeated
* empty table: no rows; a scan carries no columns of the input beside path and text, masking carries all, whatever their names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, own, scratch

#: kind, rank for ties, pattern (letters' case as written in it), group with a least length.
RULES = (
    ("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", 2, r"([0-9a-f]+)", 1, 24),
)
RULE_VERSION = "base-1"

SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
LEDGER = "blob string, rule_version string"
FINDINGS = f"blob string, rule_version string, spans array<{SPAN}>"


#: Values of a list that running() adds up in one go.
PIECE = 512


def _with(value: Column, f) -> Column:
    """f(value), with the value found once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, merge) -> Column:
    """For each of a list's whole numbers the merge of those before it, from 0. ``merge`` is associative, and 0 changes nothing.

    A fold that appends to its result copies it at every step, so it runs over pieces, then over the
    pieces' totals: the work grows with the list times PIECE, not with its square.
    """
    none = F.expr("cast(array() as array<int>)")

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(merge(a["at"], x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(xs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / PIECE).cast("int"))
        pieces = F.transform(cuts, lambda k: fold(F.slice(xs, k * PIECE + 1, F.lit(PIECE))))
        shifted = lambda ps: F.zip_with(ps, fold(F.transform(ps, lambda p: p["at"]))["out"], lambda p, base: F.transform(p["out"], lambda v: merge(base, v).cast("int")))
        return F.flatten(_with(pieces, shifted))

    return _with(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, kind, stop) in code points."""
    if kind == "hex":
        # the runs that fail are no longer than `least`, and a run is never part of another: asking for the length finds the same runs
        pattern = "([0-9a-f]{%d,})" % least
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x))
    hits = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    tested = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    # a split has one piece more than there are matches
    gaps = sizes(F.split(text, pattern, -1))
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), tested.alias("test"))

    def placed(xs: Column) -> Column:
        ahead = running(F.transform(xs, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        spans = F.zip_with(xs, ahead, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["gap"] + x["hit"]).alias("stop"), x["test"].alias("test")))
        kept = F.filter(spans, lambda s: s["test"] >= least)
        return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "stop")])).cast(f"array<{SPAN}>")

    named = F.transform(parts, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), x["test"].alias("test")))
    return F.when(text.rlike(pattern), _with(named, placed)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def scan(blobs: DataFrame, rules=RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """``blobs`` has blob and text; a row for each with all spans by start, then rule."""
    parts = [_spans(F.col("text"), *r) for r in rules]
    spans = F.array_sort(F.concat(*parts))
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), spans.alias("spans"))


class BlobLedger:
    """Tables ``scanned`` and ``findings`` below a path that all executors share; runs append to both."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        """Findings are written first, so a pair counts as scanned only when its findings are there; a run that ended between the two scans again."""
        return self._read("scanned", LEDGER).distinct()

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).dropDuplicates(["blob", "rule_version"])

    def scan(self, versions: DataFrame, rules=RULES, rule_version: str = RULE_VERSION, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """Scans what is unseen and returns (path, blob, spans) for every given version.

        Rows that share blob and path become one where they are read, and the rest is dealt out once,
        by (blob, path), which no hot blob can fill; of a blob's paths the least keeps its text. Only
        these are scanned, so each blob is scanned once.
        """
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
        v = versions.select(F.col(path_col).alias("path"), path.alias("_key"), F.sha2(text, 256).alias("blob"), text.alias("text"))
        chosen = v.groupBy("blob").agg(F.min("_key").alias("_key"))
        chosen = chosen.join(self.scanned().filter(F.col("rule_version") == rule_version), "blob", "left_anti")
        todo = v.groupBy("blob", "_key").agg(F.first("text").alias("text")).join(chosen.hint("shuffle_hash"), ["blob", "_key"])
        scan(todo, rules, rule_version).write.mode("append").parquet(f"{self.path}/findings")
        new = self._read("findings", FINDINGS).filter(F.col("rule_version") == rule_version).select("blob", "rule_version")
        new.join(self.scanned(), ["blob", "rule_version"], "left_anti").distinct().write.mode("append").parquet(f"{self.path}/scanned")
        hits = self.findings().filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
        out = v.select("path", "blob").join(hits, "blob", "left")
        return out.withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as array<{SPAN}>)")))


def fresh_ledger(spark: SparkSession) -> BlobLedger:
    return BlobLedger(spark, scratch(spark, "secret-ledger"))


def masked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", ledger: BlobLedger | None = None) -> DataFrame:
    """The documents with each secret replaced; overlapping spans are replaced as one. Columns as before, whatever their names."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ledger = ledger or fresh_ledger(spark)
    ledger.scan(docs, path_col=id_col, text_col=text_col)
    sha, blob, spans = free(docs, "_sha", "_blob", "_spans")
    hits = ledger.findings().filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(sha, F.sha2(text, 256)).join(hits, F.col(sha) == F.col(blob), "left")
    body = F.col(text_col)

    def cleaned(xs: Column) -> Column:
        # what stands before a span and after all spans that begin earlier, and a mask unless the span lies on one of them
        seen = running(F.transform(xs, lambda s: s["stop"]), F.greatest)
        part = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(body, at + 1, s["start"] - at), F.lit(mask))).otherwise(F.lit(""))
        last = F.array_max(F.transform(xs, lambda s: s["stop"]))
        return F.concat(F.array_join(F.zip_with(xs, seen, part), ""), F.substring(body, last + 1, F.length(body)))

    clean = F.when(F.col(spans).isNull(), body).otherwise(_with(F.col(spans), cleaned))
    return joined.select(*[clean.alias(c) if c == text_col else x for c, x in zip(docs.columns, own(docs), strict=True)])
