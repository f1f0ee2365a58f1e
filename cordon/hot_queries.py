"""Ordered operators where one scope holds half of all events, cut into buckets or at reset points; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import folds, ledger, policy, scan
from .queries import _FOLD, Tables, query
from .session import keeper
from .streaming.traffic import concurrency

_HOT = "CASE WHEN user_id % 2 = 0 THEN -1 ELSE user_id END"
_REC = f"SELECT event_id AS record_id, {_HOT} AS scope, ts, event_type <> 'view' AS protected, event_type || ':' || event_id AS payload FROM events"
ROWS = 100  # small, so that the hot scope is cut on test tables too


def _records(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("record_id"), F.expr(_HOT).alias("scope"), "ts", (F.col("event_type") != "view").alias("protected"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("payload"))


@query("g12_prior_count_hot", f"SELECT r.record_id, (SELECT count(*) FROM ({_REC}) p WHERE p.scope = r.scope AND p.protected AND p.ts < r.ts AND p.ts > r.ts - INTERVAL 1 DAY) AS prior_count FROM ({_REC}) r")
def _(t):
    return ledger.prior_count(_records(t), 86_400, rows_per_task=ROWS).select("record_id", "prior_count")


@query("g13_replay_budget_hot", _FOLD.format(_REC, "protected", "protected", "NOT protected OR len(live) < 2", "5 MINUTE").replace("protected AS ok", "true AS ok") + ", o AS (SELECT f.*, protected FROM f JOIN r USING (scope, n)) SELECT record_id, ok AS allowed, prior AS prior_count, CASE WHEN NOT protected THEN 'UNPROTECTED_RELEASE' WHEN NOT ok THEN 'CUMULATIVE_BUDGET_EXHAUSTED' WHEN prior > 0 THEN 'PROTECTED_RELEASE_WITHIN_BUDGET' ELSE 'FIRST_PROTECTED_RELEASE' END AS rule FROM o")
def _(t):
    return ledger.replay_budget(_records(t), 2, 300, rows_per_task=ROWS).select("record_id", "allowed", "prior_count", "rule")


@query("g14_legacy_block_hot", f"SELECT record_id, coalesce(max(CASE WHEN protected AND record_id % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM ({_REC})")
def _(t):
    return ledger.legacy_block(_records(t).withColumn("composition", F.when(F.col("record_id") % 50 != 0, F.lit("c"))), rows_per_task=ROWS).select("record_id", "blocked")


@query("g16_verify_chain_hot", "SELECT event_id AS record_id, CASE WHEN event_id % 101 = 0 THEN 'LINK' ELSE 'DIGEST' END AS fault FROM events WHERE event_id % 97 = 0 OR event_id % 101 = 0")
def _(t):
    built = keeper(t.spark)(ledger.chain(_records(t)))  # half of it is made by one task, which the check would run four times
    tampered = built.withColumn("payload", F.when(F.col("record_id") % 97 == 0, F.lit("changed")).otherwise(F.col("payload"))).withColumn("previous_sha256", F.when(F.col("record_id") % 101 == 0, F.lit("changed")).otherwise(F.col("previous_sha256")))
    return ledger.verify_chain(tampered, rows_per_task=ROWS).select("record_id", "fault")


@query("g20_assign_sequence_hot", f"""WITH r AS ({_REC}), old AS (SELECT scope, count(*) AS top FROM r WHERE ts < TIMESTAMP '2024-01-15' GROUP BY scope)
SELECT record_id, coalesce(top, 0) + row_number() OVER (PARTITION BY r.scope ORDER BY ts, record_id) AS sequence FROM r LEFT JOIN old USING (scope) WHERE ts >= TIMESTAMP '2024-01-15'""")
def _(t):
    r = _records(t)
    old = r.where("ts < timestamp'2024-01-15'").groupBy("scope").agg(F.count("*").alias("sequence"))
    return ledger.assign_sequence(r.where("ts >= timestamp'2024-01-15'"), old, rows_per_task=ROWS).select("record_id", "sequence")


@query("d11_asof_snapshot_hot", f"""WITH s AS (SELECT {_HOT} AS key, ts AS observed_at, ts + INTERVAL 6 HOUR AS expires_at, 's' || event_id AS snapshot_id FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, {_HOT} AS key, ts FROM events WHERE event_type = 'click')
SELECT event_id, e.key, ts, snapshot_id, CASE WHEN snapshot_id IS NULL THEN 'MISSING' WHEN expires_at <= ts THEN 'STALE' ELSE 'FRESH' END AS freshness FROM e ASOF LEFT JOIN s ON e.key = s.key AND e.ts >= s.observed_at""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    s = t.events.where("event_type = 'signup'").select(F.expr(_HOT).alias("key"), ts.alias("observed_at"), (ts + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), F.concat(F.lit("s"), "event_id").alias("snapshot_id"))
    return policy.asof_snapshot(t.events.where("event_type = 'click'").select("event_id", F.expr(_HOT).alias("key"), ts.alias("ts")), s, rows_per_task=ROWS)


_REQ = f"SELECT event_id AS record_id, {_HOT} AS scope, ts FROM events"
_WINDOW = 600_000_000


@query("k1_rate_limit_hot", _FOLD.format(_REQ, "true", "true", "len(live) < 2", "10 MINUTE") + " SELECT record_id, ok AS admitted FROM f")
def _(t):
    rows = _records(t).select("record_id", "scope", ledger.micros("ts").alias("ts_us"))
    return folds.ordered_fold(rows, "scope", ["ts_us", "record_id"], folds.rate_fold(2, _WINDOW), folds.RATE_COLUMNS, F.col("ts_us") + _WINDOW, ROWS).select("record_id", "admitted")


@query("k1_segments_hot", f"""WITH r AS (SELECT scope, coalesce(ts - lag(ts) OVER w >= INTERVAL 10 MINUTE, true)::INT AS start, ts, record_id FROM ({_REQ}) WINDOW w AS (PARTITION BY scope ORDER BY ts, record_id)),
s AS (SELECT scope, sum(start) OVER (PARTITION BY scope ORDER BY ts, record_id ROWS UNBOUNDED PRECEDING) AS segment FROM r), g AS (SELECT scope, segment, count(*) AS n FROM s GROUP BY ALL)
SELECT scope, sum(n)::BIGINT AS n_rows, count(*) AS n_segments, max(n) AS largest FROM g GROUP BY scope HAVING sum(n) > {ROWS}""")
def _(t):
    rows = _records(t).select("record_id", "scope", ledger.micros("ts").alias("ts_us"))
    return scan.segment_report(rows, "scope", ["ts_us", "record_id"], F.col("ts_us") + _WINDOW, ROWS)


@query("k3_concurrency_hot", f"""WITH m AS (SELECT scope, ts AS moment, 1 AS d FROM ({_REQ}) UNION ALL SELECT scope, ts + INTERVAL 2 HOUR, -1 FROM ({_REQ}))
SELECT scope, max(n)::BIGINT AS most_open FROM (SELECT scope, sum(d) OVER (PARTITION BY scope ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS n FROM m) GROUP BY scope""")
def _(t):
    return concurrency(_records(t).select("scope", F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end")), rows_per_task=ROWS)
