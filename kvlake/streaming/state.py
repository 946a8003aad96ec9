"""Keyed state over streams: continuous upsert with expiry, micro-batch runs, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..model import NEVER, SENTINEL

OUT = "key string, seq long, op string, code int, data long, live boolean, num long, txt string, expiry long"


STATE = "live boolean, num long, txt string, expiry long"
_NONE = (False, None, None, NEVER)


def command(record: tuple, op: str, ts: int, given: int | None, text: str | None, ttl: int) -> tuple[tuple, int, int]:
    """One command on a record (live, num, txt, expiry): the record that follows, the code and the data."""
    alive, num, txt, expiry = record
    ends = ts + ttl if ttl > 0 else NEVER
    if op == "SET":
        return (True, given, text, ends), 1001, 1
    if op == "DELETE":
        return _NONE, 1002, 1
    arithmetic = op in ("INCR", "DECR", "APPEND")
    if not alive or ts > expiry:
        return _NONE, 5001, SENTINEL if arithmetic else 0
    kept = expiry if expiry > ts else NEVER
    if op in ("INCR", "DECR") and num is not None:
        moved = num + (given if op == "INCR" else -given)
        return (True, moved, None, kept), 1001, moved
    if op == "APPEND" and txt is not None:
        return (True, None, txt + text, kept), 1001, len((txt + text).encode())
    if arithmetic:
        return record, 5004, SENTINEL
    if op == "EXPIRE":
        return (True, num, txt, ends), 1001, 1
    return record, 1000, expiry - ts if op == "TTL" else 1


def keyed_responses(log: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """``log``, a stream with the change log's columns, to a stream of responses: a row for each command.

    The state is one record a key; commands of a key and batch go by seq. Expiry is by the commands'
    own time, so that a replay gives the same rows; ``keep_ms`` (processing time) only bounds how long
    an idle key's state is kept.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        record = tuple(state.get) if state.exists else _NONE
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            given, ttl = None if pd.isna(r.num) else int(r.num), 0 if pd.isna(r.ttl) else int(r.ttl)
            record, code, data = command(record, r.op, int(r.ts), given, r.txt, ttl)
            out.append((key[0], r.seq, r.op, code, data, *record))
        state.update(record)
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "op", "code", "data", "live", "num", "txt", "expiry"]).astype({"num": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return log.groupBy("key").applyInPandasWithState(fold, OUT, STATE, "update", timeout)


#: Attempts at writing a run before a stream's batch fails.
ATTEMPTS = 3


def flush_to_runs(log: DataFrame, store, now_of, checkpoint: str):
    """A stream of records (key, value, expiry, state, seq) to sorted runs: each micro-batch's newest versions are a run.

    A write that fails is tried anew, over what it left; a batch that fails for good stays in the
    stream's checkpoint and comes again when the query is started again.
    """
    from ..operators.resolve import newest

    def put(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        for attempt in range(ATTEMPTS):
            try:
                store.flush(newest(batch, ["seq"]).drop("seq"), now_of())
                return
            except Exception:
                if attempt + 1 == ATTEMPTS:
                    raise

    return log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def supervised(start, restarts: int = 3):
    """Runs a stream to its end and starts it again when it dies, from its checkpoint. ``start()`` starts the query; the last failure is raised."""
    for attempt in range(restarts + 1):
        q = start()
        try:
            q.awaitTermination()
            return q
        except Exception:
            if attempt == restarts:
                raise


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "0 seconds", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling or sliding counts and sums of value in event time; ``time`` without a zone reads as UTC."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return e.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("stop"), *by, "n", "total")


def session_counts(events: DataFrame, gap: str, late: str = "0 seconds", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    return e.groupBy(F.session_window("_t", gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), *by, "n")
