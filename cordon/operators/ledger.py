"""Release ledger: scopes, budgets, lifecycles and chain checks over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import BUDGET_COLUMNS, CHAIN_COLUMNS, GENESIS, budget_fold, chain_fold, ordered_fold
from .scan import ROWS_PER_TASK, cut, fresh, scan


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def canonical_sha(*columns: str) -> Column:
    """SHA-256 of the columns' texts in name order, joined by |; null is the empty text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(columns))), 256)


def is_protected(aggregates: Column, categories: Column) -> Column:
    """Any aggregate, or any category that isn't public."""
    return (F.size(aggregates) > 0) | F.exists(categories, lambda c: c != "PUBLIC_OR_LOW_RISK")


def idempotency(events: DataFrame) -> DataFrame:
    """receipt_id, n_events, status: FIRST, REPLAY (equal contents) or CONFLICT."""
    per = events.groupBy("receipt_id").agg(F.count("*").alias("n_events"), F.count_distinct("event_sha256").alias("d"))
    return per.select("receipt_id", "n_events", F.when(F.col("d") > 1, "CONFLICT").when(F.col("n_events") > 1, "REPLAY").otherwise("FIRST").alias("status"))


def lifecycle(records: DataFrame, transitions: DataFrame) -> DataFrame:
    """State of each record from its ordered transitions; none means RELEASED, an illegal sequence INVALID."""
    per = transitions.groupBy("record_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("transition_id", "state"))), lambda x: x["state"])).alias("states"))
    state = F.when(F.col("states").isNull(), "RELEASED").when(F.col("states") == "PENDING", "PENDING").when(F.col("states") == "PENDING,RELEASED", "RELEASED").when(F.col("states") == "PENDING,ABORTED", "ABORTED").otherwise("INVALID")
    return records.select("record_id").join(per, "record_id", "left").select("record_id", state.alias("state"), F.coalesce("states", F.lit("")).alias("states"))


def bad_transitions(records: DataFrame, transitions: DataFrame) -> DataFrame:
    return lifecycle(records, transitions).where("state = 'INVALID'").select("record_id", "states")


def active(records: DataFrame, states: DataFrame) -> DataFrame:
    return records.join(states.where("state = 'ABORTED'").select("record_id"), "record_id", "left_anti")


def prior_count(records: DataFrame, window_s: int, key: str = "scope", ts: str = "ts", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds prior_count: earlier protected records of the scope that are less than window_s old.

    A protected record adds one to a running sum at its time and takes it back when it is window_s old, so each record reads one
    number, however many lie in its window.
    """
    at, d, reads = (fresh(records, c) for c in ("_at", "_d", "_reads"))
    own = records.withColumns({at: micros(ts) * 2 + 1, d: F.col("protected").cast("long"), reads: F.lit(True)})
    back = own.where("protected").select(key, (F.col(at) - 1 + window_s * 2_000_000).alias(at), F.lit(-1).cast("long").alias(d), F.lit(False).alias(reads))
    both = cut(own.unionByName(back, allowMissingColumns=True), key, at, rows_per_task)
    return scan(both, [at], {"prior_count": ("sum", F.col(d))}, peers=False).done().where(reads).drop(at, d, reads)


def replay_budget(events: DataFrame, maximum: int, window_s: int, key: str = "scope", ts: str = "ts", tie: str = "record_id", legacy: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds allowed, rule, prior_count: decisions in order, where a denied release consumes nothing.

    Scopes of more than rows_per_task records are split where no protected release of the last window_s is left.
    """
    rows, blocked = events.withColumn("ts_us", micros(ts)), None
    if legacy:
        blocked = fresh(rows, "_blocked")
        rows = scan(cut(rows, key, "ts_us", rows_per_task), ["ts_us", tie], {blocked: ("max", F.col(legacy))}).done()
    busy = F.when(F.col("protected"), F.col("ts_us") + window_s * 1_000_000)
    out = ordered_fold(rows, key, ["ts_us", tie], budget_fold(maximum, window_s * 1_000_000, blocked=blocked), BUDGET_COLUMNS, busy, rows_per_task)
    return out.drop("ts_us", *([blocked] if blocked else []))


def legacy_block(records: DataFrame, key: str = "scope", ts: str = "ts", tie: str = "record_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds blocked: an earlier protected record of the scope has no composition."""
    b = scan(cut(records, key, ts, rows_per_task), [ts, tie], {"blocked": ("max", F.col("protected") & F.col("composition").isNull())})
    return b.done().withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def chain(records: DataFrame, key: str = "scope", order: list[str] | None = None, payload: str = "payload") -> DataFrame:
    """Adds sequence, previous_sha256 and content_sha256 of each scope's hash chain."""
    return ordered_fold(records, key, order or ["ts", "record_id"], chain_fold(payload), CHAIN_COLUMNS, reads=[payload])


def verify_chain(records: DataFrame, key: str = "scope", payload: str = "payload", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Records whose sequence, link or digest is wrong, with the first fault. Records are read several times: what is dear to make should be kept before."""
    b = scan(cut(records, key, "sequence", rows_per_task), ["sequence"], {"_before": ("last", F.struct("content_sha256")), "_n": ("sum", F.lit(1).cast("long"))})
    fault = F.when(F.col("sequence") != F.col("_n") + 1, "SEQUENCE").when(F.coalesce("_before.content_sha256", F.lit(GENESIS)) != F.col("previous_sha256"), "LINK").when(F.sha2(F.concat_ws("|", "previous_sha256", payload), 256) != F.col("content_sha256"), "DIGEST")
    return b.done().withColumn("fault", fault).where("fault is not null").drop("_before", "_n")


def assign_sequence(new: DataFrame, ledger: DataFrame, key: str = "scope", order: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds sequence: numbers that follow the scope's largest in the ledger."""
    top = ledger.groupBy(key).agg(F.max("sequence").alias("_top"))
    order = order or ["ts", "record_id"]
    b = scan(cut(new, key, order[0], rows_per_task), order, {"sequence": ("sum", F.lit(1).cast("long"))}, inclusive=True)
    return b.done().join(top, key, "left").withColumn("sequence", F.coalesce("_top", F.lit(0)) + F.col("sequence")).drop("_top")


def scope_totals(records: DataFrame, key: str = "scope", ts: str = "ts") -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n_records"), F.count_if("protected").alias("n_protected"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def verify_history(records: DataFrame, scopes: DataFrame, key: str = "scope") -> DataFrame:
    """scope, sequence, fault: DUPLICATE (a sequence that a scope holds more than once) or FOREIGN (a scope that isn't known; its smallest sequence)."""
    twice = records.groupBy(key, "sequence").agg(F.count("*").alias("n")).where("n > 1").select(key, "sequence", F.lit("DUPLICATE").alias("fault"))
    foreign = records.join(scopes.select(key), key, "left_anti").groupBy(key).agg(F.min("sequence").alias("sequence")).withColumn("fault", F.lit("FOREIGN"))
    return twice.unionByName(foreign)


def verify_claims(records: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id and fault of authorization claims: MISSING, FOREIGN (no record), MISMATCH, DUPLICATE."""
    c = claims.groupBy("record_id").agg(F.count("*").alias("n"), F.min("commitment_sha256").alias("commitment"))
    both = records.select("record_id", "content_sha256", F.lit(True).alias("own")).join(c, "record_id", "full_outer")
    fault = F.when(F.col("n").isNull(), "MISSING").when(F.col("own").isNull(), "FOREIGN").when(F.col("n") > 1, "DUPLICATE").when(F.col("commitment") != F.col("content_sha256"), "MISMATCH")
    return both.select("record_id", fault.alias("fault")).where("fault is not null")


def match_commitments(commitments: DataFrame, records: DataFrame) -> DataFrame:
    """receipt_id, matched: exactly one record of the receipt, with an equal digest."""
    r = records.groupBy("receipt_id").agg(F.count("*").alias("n"), F.min("content_sha256").alias("own"))
    return commitments.join(r, "receipt_id", "left").select("receipt_id", F.coalesce((F.col("n") == 1) & F.col("own").eqNullSafe(F.col("content_sha256")), F.lit(False)).alias("matched"))


def scope_keys(events: DataFrame) -> DataFrame:
    """Adds namespace_sha256 (principal and purpose) and scope_sha256 (namespace and subject domain); credential and session don't count."""
    space = F.sha2(F.concat_ws("|", "principal", "purpose"), 256)
    return events.withColumn("namespace_sha256", space).withColumn("scope_sha256", F.sha2(F.concat_ws("|", space, "subject_domain"), 256))


def verify_index(records: DataFrame) -> DataFrame:
    """Records whose index columns (scope, record_id) differ from the JSON payload's."""
    p = F.from_json("payload_json", "scope bigint, record_id bigint")
    return records.where(~(p["scope"].eqNullSafe(F.col("scope")) & p["record_id"].eqNullSafe(F.col("record_id")))).select("record_id")


def semantic_sha(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id and semantic_sha256: a digest of what a release shows and how it is grouped; output names, order and repeats don't count."""
    one = F.sha2(F.concat_ws("|", "dataset", "field", F.coalesce("kind", F.lit("REFERENCE"))), 256)
    per = refs.groupBy("query_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(one))).alias("shown"))
    text = F.concat_ws("|", F.coalesce("shown", F.lit("")), F.col("is_grouped").cast("string"), F.coalesce(F.col("threshold").cast("string"), F.lit("")), F.coalesce("threshold_subject", F.lit("")))
    return queries.join(per, "query_id", "left").select("query_id", F.sha2(text, 256).alias("semantic_sha256"))


def subject_domain(queries: DataFrame, sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, domain, reason: the category of the declared identifier field in the query's datasets. It must be
    an identifier in one of them (else NO_IDENTIFIER) and of one category wherever it stands (else SEVERAL_CATEGORIES)."""
    own = queries.select("query_id", F.element_at(F.split("subject", "[.]"), -1).alias("field"))
    there = sources.select("query_id", "dataset").distinct().join(own, "query_id").join(catalog, ["dataset", "field"]).groupBy("query_id").agg(F.count_distinct("category").alias("n"), F.min("category").alias("c"))
    one = F.col("c").isin("DIRECT_IDENTIFIER", "STABLE_PSEUDONYM") & (F.col("n") == 1)
    return own.join(there, "query_id", "left").select("query_id", F.when(one, F.col("c")).alias("domain"), F.when(F.col("n") > 1, "SEVERAL_CATEGORIES").when(~F.coalesce(one, F.lit(False)), "NO_IDENTIFIER").alias("reason"))


def cohort_form(facts: DataFrame) -> DataFrame:
    """query_id and cohort_json: sources, conditions and group keys as sorted sets without aliases; the order only where rows are limited.

    facts: query_id, part (source, condition, group, order), value, limited.
    """
    part = lambda p: F.array_sort(F.collect_set(F.when(F.col("part") == p, F.col("value"))))
    per = facts.groupBy("query_id").agg(part("source").alias("sources"), part("condition").alias("conditions"), part("group").alias("groups"), part("order").alias("order"), F.bool_or("limited").alias("limited"))
    shown = F.when(F.col("limited"), F.col("order")).otherwise(F.array().cast("array<string>")).alias("order")
    return per.select("query_id", F.to_json(F.struct("sources", "conditions", "groups", shown)).alias("cohort_json"))


def verify_composition(records: DataFrame) -> DataFrame:
    """record_id and fault of records whose composition disagrees with their semantics: PROTECTION (the flag isn't that of
    is_protected), MISSING (protected, without composition), UNEXPECTED (the reverse) or SUBJECT (another subject domain)."""
    protected = is_protected(F.col("aggregates"), F.col("categories"))
    fault = F.when(F.col("protected") != protected, "PROTECTION").when(protected & F.col("composition").isNull(), "MISSING").when(~protected & F.col("composition").isNotNull(), "UNEXPECTED")
    fault = fault.when(F.col("composition") != F.col("subject_domain"), "SUBJECT")
    return records.select("record_id", fault.alias("fault")).where("fault is not null")
