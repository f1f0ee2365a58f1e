"""Ordered folds by key: each key's rows pass one after another, and only the fold's state is held."""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .scan import ROWS_PER_TASK, segments

GENESIS = "0" * 64


def ordered_fold(df: DataFrame, key: str, order: list[str], make: Callable[[], Callable[[dict], dict]], added: str, busy_until: Column | None = None, rows_per_task: int = ROWS_PER_TASK, reads: list[str] | None = None) -> DataFrame:
    """The rows of df with the columns that a fold adds.

    make() gives a fresh fold for each key: a function of a row (dict) that returns the added
    values. Rows are dealt by key and sorted, never gathered: a key of any size needs the memory
    of the fold's state. One key's rows stay in one task, since each step needs the one before,
    unless `busy_until` says from which value of order[0] on a row no longer matters: keys of more
    than `rows_per_task` rows are then split, without loss, where nothing before matters any more.
    A stretch without such a point stays whole (`scan.segment_report` tells its size). `reads` names
    the columns that the fold reads, if not all: others stay in Arrow.
    """
    segment = None
    if busy_until is not None:
        df, segment = segments(df, key, order, busy_until, rows_per_task)
    by = [key] if segment is None else [key, segment]
    names = [c.strip().split(" ")[0] for c in added.split(",")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, started = None, None, False
        for batch in batches:
            out = []
            own = batch.schema.names if reads is None else reads
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in own), strict=True)
            for at, row in zip(keys, rows, strict=True):
                if not started or at != now:
                    now, fold, started = at, make(), True
                out.append(fold(dict(zip(own, row, strict=True))))
            if out:
                columns = [pa.array([o[c] for o in out], kinds[c]) for c in names]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    kinds = {c.strip().split(" ")[0]: {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.strip().split(" ")[1]] for c in added.split(",")}
    out = df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
    return out if segment is None else out.drop(segment)


def budget_fold(maximum: int, window_us: int, ts: str = "ts_us", protected: str = "protected", blocked: str | None = None) -> Callable[[], Callable[[dict], dict]]:
    """Rolling release budget: only allowed protected releases consume it; what is `window_us` old no longer counts. `blocked`: these rows have a legacy record before them."""

    def make():
        kept: deque = deque()

        def step(row: dict) -> dict:
            while kept and kept[0] <= row[ts] - window_us:
                kept.popleft()
            prior = len(kept)
            if blocked and row[blocked]:
                return {"allowed": False, "rule": "LEGACY_HISTORY_BLOCK", "prior_count": prior + 1}
            if not row[protected]:
                return {"allowed": True, "rule": "UNPROTECTED_RELEASE", "prior_count": prior}
            if prior >= maximum:
                return {"allowed": False, "rule": "CUMULATIVE_BUDGET_EXHAUSTED", "prior_count": prior}
            kept.append(row[ts])
            return {"allowed": True, "rule": "PROTECTED_RELEASE_WITHIN_BUDGET" if prior else "FIRST_PROTECTED_RELEASE", "prior_count": prior}

        return step

    return make


BUDGET_COLUMNS = "allowed boolean, rule string, prior_count long"


def rate_fold(limit: int, window_us: int, ts: str = "ts_us", counted: str | None = None) -> Callable[[], Callable[[dict], dict]]:
    """Sliding-window limit: a refused request leaves no time stamp. `counted`: only these rows leave one (failures), all are refused in a full window."""

    def make():
        kept: deque = deque()

        def step(row: dict) -> dict:
            while kept and kept[0] <= row[ts] - window_us:
                kept.popleft()
            if len(kept) >= limit:
                return {"admitted": False, "retry_after_s": math.ceil((window_us - (row[ts] - kept[0])) / 1_000_000)}
            if counted is None or row[counted]:
                kept.append(row[ts])
            return {"admitted": True, "retry_after_s": None}

        return step

    return make


RATE_COLUMNS = "admitted boolean, retry_after_s long"


def traffic_fold(limit: int, window_us: int, most_open: int, ts: str = "ts_us", end: str = "end_us") -> Callable[[], Callable[[dict], dict]]:
    """Sliding-window limit and requests open at once, together: a request refused for its rate leaves no time stamp, one refused for those that are open does. A request that ends at the time of another's start is no longer open."""

    def make():
        kept: deque = deque()
        running: list[int] = []

        def step(row: dict) -> dict:
            while kept and kept[0] <= row[ts] - window_us:
                kept.popleft()
            if len(kept) >= limit:
                return {"admitted": False, "reason": "RATE_LIMIT_EXCEEDED", "retry_after_s": math.ceil((window_us - (row[ts] - kept[0])) / 1_000_000)}
            kept.append(row[ts])
            while running and running[0] <= row[ts]:
                heapq.heappop(running)
            if len(running) >= most_open:
                return {"admitted": False, "reason": "CONCURRENCY_LIMIT_EXCEEDED", "retry_after_s": 1}
            heapq.heappush(running, row[end])
            return {"admitted": True, "reason": None, "retry_after_s": None}

        return step

    return make


TRAFFIC_COLUMNS = "admitted boolean, reason string, retry_after_s long"


def chain_fold(payload: str) -> Callable[[], Callable[[dict], dict]]:
    """Hash chain: sequence from 1, each digest over the one before and the payload."""

    def make():
        state = {"n": 0, "last": GENESIS}

        def step(row: dict) -> dict:
            state["n"] += 1
            before, state["last"] = state["last"], hashlib.sha256(f"{state['last']}|{row[payload]}".encode()).hexdigest()
            return {"sequence": state["n"], "previous_sha256": before, "content_sha256": state["last"]}

        return step

    return make


CHAIN_COLUMNS = "sequence long, previous_sha256 string, content_sha256 string"
