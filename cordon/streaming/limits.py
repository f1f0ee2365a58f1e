"""Limits over streams with keyed state, timers and the RocksDB store.

Rows of a scope wait in a list state until the watermark has passed them and are then taken in the
order of (ts_us, record_id), so decisions are those of the batch folds, whatever the micro-batches.
What is later than the watermark is dropped by Spark. Scopes are dealt to `parts` groups by hash, and
limits keep the state of a group together: a call to the store and a timer cost far more than a row.
A timer brings the group back for its next waiting row, and once more when its last time stamp leaves
the window. Time stamps that have left it are removed whenever the group is called, so idle scopes leave the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import budget_fold, rate_fold

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, which list states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


PARTS = 256  # groups of scopes; a checkpoint holds good for one number only


class _Window(StatefulProcessor):
    """Runs an ordered fold over the rows of a group of scopes, each scope with a fold of its own. State: time stamps inside the
    window, and rows that wait for the watermark. Both are lists of columns, so a call to the store moves many scopes' rows."""

    def __init__(self, make: Callable[[], Callable[[dict], dict]], leaves: Callable[[dict, bool], bool], flag: str, window_us: int, most: int, columns: list[str]):
        self.make, self.leaves, self.flag, self.window_us, self.most, self.columns = make, leaves, flag, window_us, most, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "scope array<long>, ts_us array<long>")
        self.waiting = handle.getListState("waiting", "ts_us array<long>, record_id array<long>, flag array<boolean>, scope array<long>")

    def _call_at(self, ts_us: int) -> None:
        self.handle.registerTimer(-(-ts_us // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for x in rows:
            if len(x):
                scope = [k if known else None for k, known in zip(x.scope.tolist(), x.has_scope.tolist(), strict=True)]
                self.waiting.appendValue((x.ts_us.astype("int64").tolist(), x.record_id.astype("int64").tolist(), x.flag.astype(bool).tolist(), scope))
                low = int(x.ts_us.min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._call_at(first)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later, kept = [], [], {}
        for columns in self.waiting.get() if self.waiting.exists() else []:
            for x in zip(*columns, strict=True):
                (ready if x[0] <= passed else later).append(x)
        for scopes, times in self.kept.get() if self.kept.exists() else []:
            for scope, t in zip(scopes, times, strict=True):
                kept.setdefault(scope, []).append(t)
        ready.sort(key=lambda x: x[:3])
        folds, out = {}, []
        for t, record, flag, scope in ready:
            fold = folds.get(scope)
            if fold is None:
                fold = folds[scope] = self.make()
                for before in kept.get(scope, []):
                    fold({"ts_us": before, self.flag: True})
            told = fold({"ts_us": t, self.flag: flag})
            out.append((record, scope, *(told[c] for c in self.columns)))
            if self.leaves(told, flag):
                kept.setdefault(scope, []).append(t)
        # a time stamp is of use until a window after it, for rows that may still come after the watermark
        stay = [(scope, t) for scope, times in kept.items() for t in [t for t in times if t > passed - self.window_us][-self.most :]]
        for state, values in ((self.kept, stay), (self.waiting, later)):
            if values:
                state.put([tuple(map(list, zip(*values, strict=True)))])
            elif state.exists():
                state.clear()
        if later:
            self._call_at(min(later, key=lambda x: x[0])[0])
        elif stay:
            self._call_at(max(t for _, t in stay) + self.window_us)
        if out:
            yield self._frame(out)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        names = ["record_id", "scope", *self.columns]
        return pd.DataFrame({n: pd.array(c, "Int64") if n == "scope" else c for n, c in zip(names, map(list, zip(*out, strict=True)), strict=True)})


def _limited(stream: DataFrame, processor: _Window, schema: str, delay: str, parts: int) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    timed = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    # a null among whole numbers would make them floats in pandas
    dealt = timed.withColumns({"part": F.pmod(F.xxhash64("scope"), F.lit(parts)), "has_scope": F.col("scope").isNotNull(), "scope": F.coalesce("scope", F.lit(0))})
    return dealt.groupBy("part").transformWithStateInPandas(processor, f"record_id long, scope long, {schema}", "append", "EventTime")


def rate_stream(stream: DataFrame, limit: int, window_s: int, delay: str, parts: int = PARTS) -> DataFrame:
    """Sliding-window rate limit over a stream of record_id, scope, ts_us: record_id, scope, admitted, retry_after_s, as `folds.rate_fold` decides.

    The state of a scope is `limit` time stamps at most and the rows within `delay` of the newest.
    """
    window = window_s * 1_000_000
    make = rate_fold(limit, window)
    processor = _Window(make, lambda told, _: told["admitted"], "counted", window, limit, ["admitted", "retry_after_s"])
    return _limited(stream.withColumn("flag", F.lit(True)), processor, "admitted boolean, retry_after_s double", delay, parts)


def throttle_stream(stream: DataFrame, limit: int, window_s: int, delay: str, parts: int = PARTS) -> DataFrame:
    """Failure throttle over a stream of record_id, scope, ts_us, failed: only failures leave a time stamp, in a full window all are refused."""
    window = window_s * 1_000_000
    make = rate_fold(limit, window, counted="failed")
    processor = _Window(make, lambda told, failed: told["admitted"] and failed, "failed", window, limit, ["admitted", "retry_after_s"])
    return _limited(stream.withColumnRenamed("failed", "flag"), processor, "admitted boolean, retry_after_s double", delay, parts)


def budget_stream(stream: DataFrame, maximum: int, window_s: int, delay: str, parts: int = PARTS) -> DataFrame:
    """Rolling release budget over a stream of record_id, scope, ts_us, protected: record_id, scope, allowed, rule, as `folds.budget_fold` decides."""
    window = window_s * 1_000_000
    make = budget_fold(maximum, window)
    processor = _Window(make, lambda told, protected: told["allowed"] and protected, "protected", window, maximum, ["allowed", "rule"])
    return _limited(stream.withColumnRenamed("protected", "flag"), processor, "allowed boolean, rule string", delay, parts)


class _Capability(StatefulProcessor):
    """First use within its life, later uses, and the end of a life without any."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "issued_us long, used boolean, told boolean")
        self.waiting = handle.getListState("waiting", "ts_us long, record_id long, issue boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(k), bool(i)) for x in rows for t, k, i in zip(x.ts_us, x.record_id, x.issue, strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # an issue comes before a use at the same time
        waiting = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], not x[2], x[1])) if self.waiting.exists() else []
        issued, used, told = self.life.get() if self.life.exists() else (None, False, False)
        ready, out = [x for x in waiting if x[0] <= passed], []

        def end(now: int) -> None:
            nonlocal told
            if issued is not None and not used and not told and now > issued + self.ttl_us:
                told = True
                out.append((None, key[0], "EXPIRED_UNUSED"))

        for t, record, issue in ready:
            end(t)
            if issue:
                issued = t if issued is None else issued
                continue
            out.append((record, key[0], "UNKNOWN" if issued is None else "REPLAY" if used else "EXPIRED" if t > issued + self.ttl_us else "OK"))
            used = used or issued is not None
        end(passed)
        later = waiting[len(ready) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        elif self.waiting.exists():
            self.waiting.clear()
        if issued is not None:
            self.life.update((issued, used, told))
            if not used and not told:
                self.handle.registerTimer((issued + self.ttl_us) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["record_id", "capability", "status"]).astype({"record_id": "Int64"})


def capability_stream(stream: DataFrame, ttl_s: int, delay: str) -> DataFrame:
    """Uses of single-use capabilities over a stream of record_id, capability, ts_us, issue (true: it is issued, false: it is used).

    status: OK for the first use within `ttl_s` of the issue, EXPIRED for a first use after it, REPLAY for
    later uses, UNKNOWN for a use of what hasn't been issued; and EXPIRED_UNUSED, with a null
    record_id, when a life ends without a use, by a timer and without a further row of that capability.
    """
    use_rocksdb(stream.sparkSession)
    timed = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)
    return timed.groupBy("capability").transformWithStateInPandas(_Capability(ttl_s * 1_000_000), "record_id long, capability long, status string", "append", "EventTime")
