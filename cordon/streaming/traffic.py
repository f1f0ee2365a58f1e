"""Traffic and release streams."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import GENESIS, budget_fold
from ..operators.scan import ROWS_PER_TASK, cut, scan
from ..session import shared_folder


def concurrency(intervals: DataFrame, key: str = "scope", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Most intervals (start, end) of a key that are open at once; an end comes before a start at the same time. Keys of more than rows_per_task marks are split."""
    mark = lambda c, d: intervals.select(key, F.col(c).alias("at"), F.lit(d).cast("long").alias("d"))
    marks = cut(mark("start", 1).unionByName(mark("end", -1)), key, "at", rows_per_task)
    return scan(marks, ["at", "d"], {"n": ("sum", F.col("d"))}, inclusive=True).done().groupBy(key).agg(F.max("n").alias("most_open"))


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _due(waiting: list, state: GroupState, delay: str | None) -> tuple[list, list]:
    """The waiting rows [ts_us, ...] that the watermark has passed, in order (all without a `delay`), and the rest."""
    waiting = sorted(waiting)
    ready = [x for x in waiting if x[0] <= state.getCurrentWatermarkMs() * 1000] if delay else waiting
    return ready, waiting[len(ready) :]


def _wait(waiting: list, state: GroupState) -> None:
    """Call the group again once the watermark has passed its first waiting row."""
    if waiting:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, waiting[0][0] // 1000))


def _timed(stream: DataFrame, delay: str | None) -> tuple[DataFrame, str]:
    if not delay:
        return stream, GroupStateTimeout.NoTimeout
    return stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay), GroupStateTimeout.EventTimeTimeout


def budget_stream(stream: DataFrame, maximum: int, window_s: int, delay: str | None = None) -> DataFrame:
    """Rolling release budget by scope over a stream of record_id, scope, ts_us, protected; decisions are those of the batch fold.

    The state of a scope is the list of the releases inside the window, `maximum` numbers at most, and of the rows that wait.
    Rows of a scope are taken in the order of (ts_us, record_id), as `chain_stream` does with and without a `delay`.
    """
    window_us = window_s * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = (json.loads(state.get[0]), json.loads(state.get[1])) if state.exists else ([], [])
        for x in frames:
            waiting += [[int(t), int(k), bool(p)] for t, k, p in zip(x.ts_us, x.record_id, x.protected, strict=True)]
        ready, waiting = _due(waiting, state, delay)
        fold = budget_fold(maximum, window_us)()
        for t in kept:
            fold({"ts_us": t, "protected": True})
        out = [fold({"ts_us": t, "protected": p}) for t, _, p in ready]
        kept += [t for (t, _, p), o in zip(ready, out, strict=True) if o["allowed"] and p]
        kept = [t for t in kept if t > ready[-1][0] - window_us][-maximum:] if ready else kept
        state.update((json.dumps(kept), json.dumps(waiting)))
        _wait(waiting, state)
        yield pd.DataFrame({"record_id": [k for _, k, _ in ready], "scope": key[0], "allowed": [o["allowed"] for o in out], "rule": [o["rule"] for o in out]})

    timed, limit = _timed(stream, delay)
    return timed.groupBy("scope").applyInPandasWithState(step, "record_id long, scope long, allowed boolean, rule string", "kept string, waiting string", "append", limit)


def replays(uses: DataFrame, ttl_s: int) -> DataFrame:
    """Adds status to uses (event_id, capability, ts, issued): REPLAY after the first use, EXPIRED after ttl_s, else OK."""
    n = F.row_number().over(Window.partitionBy("capability").orderBy("ts", "event_id"))
    late = F.col("ts") > F.col("issued") + F.make_dt_interval(secs=F.lit(ttl_s))
    return uses.withColumn("status", F.when(n > 1, "REPLAY").when(late, "EXPIRED").otherwise("OK"))


def lifecycle_stream(transitions: DataFrame) -> DataFrame:
    """record_id, n_moves, state after each micro-batch's transitions (record_id, transition_id, state), in update mode; an illegal sequence is INVALID.

    Moves count in the order of their transition_id, in whatever micro-batch they come. No legal sequence has more than two moves, so the state of a record
    is their number, the first and the last, kept by built-in aggregates. The row of most moves is a record's latest.
    """
    move = F.struct("transition_id", "state")
    per = transitions.groupBy("record_id").agg(F.count("*").alias("n_moves"), F.min(move).alias("first"), F.max(move).alias("last"))
    legal = (F.col("first.state") == "PENDING") & ((F.col("n_moves") == 1) | ((F.col("n_moves") == 2) & F.col("last.state").isin("RELEASED", "ABORTED")))
    return per.select("record_id", "n_moves", F.when(legal, F.col("last.state")).otherwise("INVALID").alias("state"))


lifecycle_stream.mode = "update"


def chain_stream(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Hash chain by scope over a stream of record_id, scope, ts_us, payload; the state is the last number and digest.

    Rows of a scope are taken in the order of (ts_us, record_id): within a micro-batch, or, with a `delay`, across micro-batches.
    Then rows wait in the state until the watermark has passed them, what is later than it is dropped, and the last rows
    are written once later ones of any scope move the watermark on.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, waiting = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (0, GENESIS, [])
        for x in frames:
            waiting += [[int(t), int(k), p] for t, k, p in zip(x.ts_us, x.record_id, x.payload, strict=True)]
        ready, waiting = _due(waiting, state, delay)
        out = []
        for _, record_id, payload in ready:
            n, before, last = n + 1, last, hashlib.sha256(f"{last}|{payload}".encode()).hexdigest()
            out.append((record_id, n, before, last))
        state.update((n, last, json.dumps(waiting)))
        _wait(waiting, state)
        yield pd.DataFrame(out, columns=["record_id", "sequence", "previous_sha256", "content_sha256"])

    timed, limit = _timed(stream, delay)
    return timed.groupBy("scope").applyInPandasWithState(step, "record_id long, sequence long, previous_sha256 string, content_sha256 string", "n long, last string, waiting string", "append", limit)


def fresh_stream(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events of a stream with the static snapshots of their key that hold at their time."""
    s = snapshots.withColumnRenamed("key", "own")
    return events.join(s, (F.col("key") == F.col("own")) & (F.col("observed_at") <= F.col("ts")) & (F.col("ts") < F.col("expires_at"))).drop("own")


def asof_streams(events: DataFrame, snapshots: DataFrame, horizon: str, delay: str) -> DataFrame:
    """event_id, key, ts, snapshot_id, fresh: each event of a stream with the newest snapshot of its key in another stream, whichever comes first.

    events: event_id, key, ts. snapshots: key, observed_at, expires_at, snapshot_id. Only snapshots observed at the event or up to `horizon`
    (the longest validity) before it count, so both sides leave the state once the slower of the two watermarks has passed; an
    event is written then, once, and without a snapshot if none has come. Of snapshots observed at one time the largest id counts. Rows
    later than `delay` behind the watermark, and rows without a time or key, are no part of it (an event without a key is never fresh).
    """
    e = events.select("event_id", "key", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    s = snapshots.select(F.col("key").alias("own"), F.col("observed_at").cast("timestamp").alias("observed_at"), F.col("expires_at").cast("timestamp").alias("expires_at"), "snapshot_id").withWatermark("observed_at", delay)
    near = F.expr(f"key = own AND observed_at <= ts AND observed_at >= ts - INTERVAL {horizon}")
    newest = F.max(F.when(F.col("own").isNotNull(), F.struct("observed_at", "snapshot_id", "expires_at")))
    out = e.join(s, near, "left_outer").groupBy("ts", "event_id", "key").agg(newest.alias("n"))
    fresh = F.coalesce(F.col("ts") < F.col("n.expires_at"), F.lit(False))
    return out.select("event_id", "key", "ts", F.col("n.snapshot_id").alias("snapshot_id"), fresh.alias("fresh"))


def drain(transform: Callable[[DataFrame], DataFrame], like: DataFrame, path: str, files_a_batch: int = 1000, mode: str | None = None) -> DataFrame:
    """Run a stream over the files that are at `path` now, to its end, and return what it wrote. mode: the output mode (default: the transform's `mode`, else append)."""
    spark = like.sparkSession
    base, mode = shared_folder(spark), mode or getattr(transform, "mode", "append")
    out = transform(spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path))
    sink = out.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        sink.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")
    # files take appended rows only; a batch that runs again replaces its folder
    sink.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/{n}")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out/*")
