"""Lineage facts, context resolution and policy decisions over a log of plan facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keeper
from . import packed
from .scan import ROWS_PER_TASK, cut, scan

K = 20
EXPOSED = ["RAW_VALUE", "TRANSFORMED_RAW_VALUE", "GROUP_KEY", "AGGREGATE_OPERAND", "CONDITIONAL_AGGREGATE", "NESTED_SCOPE"]
IDENTIFIERS = ["DIRECT_IDENTIFIER", "STABLE_PSEUDONYM"]


def resolve_context(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds category and context_reason (UNRESOLVED_DATASET, UNRESOLVED_COLUMN, UNCLASSIFIED_COLUMN or null) to query_ref rows."""
    sets = catalog.select("dataset").distinct().withColumn("has_dataset", F.lit(True))
    out = refs.join(sets, "dataset", "left").join(catalog, ["dataset", "field"], "left")
    reason = F.when(F.col("has_dataset").isNull(), "UNRESOLVED_DATASET").when(F.col("category").isNull(), "UNRESOLVED_COLUMN").when(F.col("category") == "UNCLASSIFIED", "UNCLASSIFIED_COLUMN")
    return out.select(*refs.columns, "category", reason.alias("context_reason"))


def effective(context: DataFrame, lineage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Context rows and one more for each upstream source of their columns: eff_key, eff_category."""
    sources = lineage.join(catalog.toDF("src_dataset", "src_field", "src_category"), ["src_dataset", "src_field"], "left")
    up = context.join(sources, ["dataset", "field"]).select(*context.columns, F.concat_ws(".", "src_dataset", "src_field").alias("eff_key"), F.coalesce("src_category", F.lit("UNCLASSIFIED")).alias("eff_category"))
    own = context.select(*context.columns, F.concat_ws(".", "dataset", "field").alias("eff_key"), F.coalesce("category", F.lit("UNCLASSIFIED")).alias("eff_category"))
    return own.unionByName(up)


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def flags(queries: DataFrame, refs: DataFrame, catalog: DataFrame, lineage: DataFrame, count_quasi: bool = False) -> DataFrame:
    """One row a query with what its columns show; queries without columns keep false. n_quasi (shown quasi-identifiers) only on request."""
    rows = effective(resolve_context(refs, catalog), lineage, catalog).withColumn("own", F.concat_ws(".", "dataset", "field"))
    shown = F.col("kind").isin(EXPOSED)
    governed = F.array_compact(F.collect_set(F.when(F.col("category").isin(IDENTIFIERS), F.col("own"))))
    per = rows.groupBy("query_id").agg(
        _any(F.col("context_reason") == "UNRESOLVED_DATASET").alias("no_dataset"), _any(F.col("context_reason") == "UNRESOLVED_COLUMN").alias("no_column"),
        _any(F.col("context_reason").isNotNull() | (F.col("eff_category") == "UNCLASSIFIED")).alias("unclassified"), _any(F.col("kind") == "NESTED_SCOPE").alias("nested"),
        _any((F.col("kind") == "CONDITIONAL_AGGREGATE") & (F.col("eff_category") != "PUBLIC_OR_LOW_RISK")).alias("conditional"),
        _any(shown & (F.col("eff_category") == "DIRECT_IDENTIFIER")).alias("has_direct"), _any(shown & (F.col("eff_category") == "STABLE_PSEUDONYM")).alias("has_pseudonym"),
        _any(shown & (F.col("eff_category") == "SENSITIVE_ATTRIBUTE")).alias("has_sensitive"),
        _any(F.col("eff_category") == "SENSITIVE_ATTRIBUTE").alias("sensitive_anywhere"), governed.alias("governed"),
        *([F.size(F.collect_set(F.when(shown & (F.col("eff_category") == "QUASI_IDENTIFIER"), F.col("eff_key")))).alias("n_quasi")] if count_quasi else []),
    )
    names = [c for c in per.columns if c not in ("query_id", "governed")]
    fill = {c: 0 if c == "n_quasi" else False for c in names}
    out = queries.join(per, "query_id", "left").fillna(fill, names)
    return out.withColumn("subject_governed", F.coalesce(F.array_contains("governed", F.col("subject")), F.lit(False))).drop("governed")


def decide(queries: DataFrame, refs: DataFrame, catalog: DataFrame, lineage: DataFrame, k: int = K, min_quasi: int = 0) -> DataFrame:
    """One row a query: decision (BLOCK before REWRITE before ALLOW), reasons (ordered, unique), trusted_threshold.

    min_quasi: an ungrouped pseudonym with a sensitive attribute blocks only with as many shown
    quasi-identifiers (2 in legacy mode). One shuffle by query_id; catalog and lineage are joined as Catalyst sees fit. Join, group
    and filter columns count for resolution and for the threshold, not for linkage.
    """
    f = flags(queries, refs, catalog, lineage, min_quasi > 0)
    enough = F.col("n_quasi") >= min_quasi if min_quasi else F.lit(True)
    when = lambda c, reason: F.when(c, F.lit(reason))
    risk = "COMPOSITIONAL_REIDENTIFICATION_RISK"
    blocks = F.array_distinct(F.array_compact(F.array(
        F.col("upstream"), when(F.col("no_dataset"), "UNRESOLVED_DATASET"), when(F.col("no_column"), "UNRESOLVED_COLUMN"), when(F.col("unclassified"), "UNCLASSIFIED_COLUMN"), when(F.col("nested"), "UNRESOLVED_COLUMN"),
        when(F.col("conditional"), risk), when(F.col("has_direct") & F.col("has_sensitive"), "DIRECT_SENSITIVE_LINKAGE"), when(~F.col("is_grouped") & F.col("has_pseudonym") & F.col("has_sensitive") & enough, risk),
    )))
    f = f.withColumn("blocks", blocks).withColumn("trusted_threshold", F.when((F.col("threshold_subject") == F.col("subject")) & F.col("subject_governed"), F.col("threshold")))
    grouped = F.col("is_grouped") & F.col("sensitive_anywhere")
    small = F.coalesce(F.col("trusted_threshold") < k, F.lit(True))
    one = lambda reason: F.array(F.lit(reason))
    decision = F.when(F.size("blocks") > 0, "BLOCK").when(grouped & ~F.col("subject_governed"), "BLOCK").when(grouped & small, "REWRITE").otherwise("ALLOW")
    reasons = F.when(F.size("blocks") > 0, F.col("blocks")).when(grouped & ~F.col("subject_governed"), one("UNTRUSTED_SUBJECT_KEY")).when(grouped & small, one("SMALL_GROUP_RISK")).otherwise(one("NO_COMPOSITIONAL_RISK"))
    return f.withColumn("decision", decision).withColumn("reasons", reasons)


def needs_threshold(flagged: DataFrame) -> DataFrame:
    return flagged.select("query_id", (F.col("is_grouped") & F.col("sensitive_anywhere")).alias("needs_threshold"))


def trusted_threshold(having: DataFrame) -> DataFrame:
    """Largest conjunctive distinct-count literal of each query, if it has one subject and no OR; else null."""
    term = F.col("conjunctive") & ~F.col("under_or") & F.col("is_count_distinct") & F.col("op").isin(">=", ">")
    value = F.when(F.col("op") == ">", F.col("literal") + 1).otherwise(F.col("literal"))
    per = having.groupBy("query_id").agg(F.max(F.when(term, value)).alias("t"), F.count_distinct(F.when(term, F.concat_ws(".", "dataset", "field"))).alias("n"), F.min(F.when(term, F.concat_ws(".", "dataset", "field"))).alias("s"), F.bool_or("under_or").alias("o"))
    good = (F.col("n") == 1) & ~F.col("o")
    return per.select("query_id", F.when(good, F.col("t")).alias("threshold"), F.when(good, F.col("s")).alias("threshold_subject"), F.when(F.col("o"), "UNDER_OR").when(F.col("n") > 1, "SEVERAL_SUBJECTS").alias("warning"))


def rollup_plan(refs: DataFrame) -> DataFrame:
    """Sorted unique column keys of each query: all referenced, projected, group keys."""
    key = F.concat_ws(".", "dataset", "field")
    keys = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return refs.groupBy("query_id").agg(keys(key).alias("referenced"), keys(F.when(F.col("kind").isNotNull(), key)).alias("projected"), keys(F.when(F.col("kind") == "GROUP_KEY", key)).alias("group_keys"))


def flag_wildcards(refs: DataFrame) -> DataFrame:
    return refs.groupBy("query_id").agg(_any(F.col("field") == "*").alias("has_wildcard"))


def classify_exposure(outputs: DataFrame) -> DataFrame:
    """Exposure kind of each output (query_id, output_name) from its sources in order of `position`.

    Sources carry is_filter, bare, grouped, agg (none, count, other), nested. Precedence: a
    filtered or conditional aggregate; a bare column (GROUP_KEY if grouped); an output without
    columns is NESTED_SCOPE; else the first source that no count stands on decides; if a count
    stands on all, AGGREGATE_VALUE.
    """
    has = F.col("src_field").isNotNull()
    kind = F.when(F.col("is_filter"), "CONDITIONAL_AGGREGATE").when(F.col("agg") == "other", "AGGREGATE_OPERAND").when(F.col("nested"), "NESTED_SCOPE").otherwise("TRANSFORMED_RAW_VALUE")
    deciding = has & (F.col("agg") != "count")
    per = outputs.groupBy("query_id", "output_name").agg(
        _any(F.col("is_filter")).alias("f"), _any(F.col("bare") & ~F.col("grouped")).alias("raw"), _any(F.col("bare") & F.col("grouped")).alias("key"), F.count_if(has).alias("n"), F.min_by(F.when(deciding, kind), F.when(deciding, F.col("position"))).alias("k"),
    )
    out = F.when(F.col("f"), "CONDITIONAL_AGGREGATE").when(F.col("key"), "GROUP_KEY").when(F.col("raw"), "RAW_VALUE").when(F.col("n") == 0, "NESTED_SCOPE").otherwise(F.coalesce("k", F.lit("AGGREGATE_VALUE")))
    return per.select("query_id", "output_name", out.alias("kind"))


def check_joins(joins: DataFrame) -> DataFrame:
    """Joins outside the profile: only inner or left with ON."""
    reason = F.when(F.col("kind").isin("CROSS", "SEMI", "ANTI") | F.col("side").isin("RIGHT", "FULL"), "JOIN_KIND").when(F.col("has_using"), "USING").when(~F.col("has_on"), "NO_CONDITION")
    return joins.withColumn("join_reason", reason).where("join_reason is not null")


def lineage_closure(edges: DataFrame, hops: int = 3, most: int = 1_000_000) -> DataFrame:
    """All upstream keys within `hops` steps: key, source, depth (the smallest). Cycles end by depth.

    Sources go through shuffles as lists, a row for each key or each edge, and become rows only in the last step, so that what is shuffled doesn't
    grow with a row for each path. A walk is an edge and a shorter walk; walks that longer ones go on from are found for keys that are sources.
    A list holds at most `most` sources: where degrees allow more, lists are parted by the sources' hash. The distinct edges are written once, for the largest degree and the levels.
    """
    e = keeper(edges.sparkSession)(edges.select("key", "source").distinct())
    degree = e.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    parts = min(max(1, -(-(degree**hops) // most)), 1 << 20)
    part = F.pmod(F.xxhash64("source"), F.lit(parts)) if parts > 1 else F.lit(0)
    gap = F.when(F.bool_or(F.col("source").isNull()), F.array(F.lit(None).cast(e.schema["source"].dataType)))
    lists = e.groupBy("key", part.alias("part")).agg(F.concat(F.collect_list("source"), F.coalesce(gap, F.array().cast(f"array<{e.schema['source'].dataType.simpleString()}>"))).alias("sources"))
    inner = e.join(e.select(F.col("source").alias("key")).distinct(), "key", "left_semi") if hops > 2 else None
    walk = lambda first, now: first.select("key", F.col("source").alias("via")).join(now.withColumnRenamed("key", "via"), "via").select("key", "part", "sources")
    levels, now = [lists.withColumn("depth", F.lit(1))], lists
    for d in range(2, hops + 1):
        levels.append(walk(e, now).withColumn("depth", F.lit(d)))
        if d < hops:
            now = walk(inner, now).groupBy("key", "part").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    at = lambda d: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("depth") == d, F.col("sources"))))).alias(f"at{d}")
    per = reduce(DataFrame.unionByName, levels).groupBy("key", "part").agg(*map(at, range(1, hops + 1)))
    found, seen = [], None
    for d in range(1, hops + 1):
        new = F.col(f"at{d}") if seen is None else F.array_except(f"at{d}", seen)
        seen = F.col("at1") if seen is None else F.array_union(seen, f"at{d}")
        found.append(F.arrays_zip(new.alias("source"), F.array_repeat(F.lit(d), F.size(new)).alias("depth")))
    return per.select("key", F.inline(F.concat(*found)))


def lineage_closure_ids(edges: DataFrame, hops: int = 3, name: Callable[[str], Column] = F.col, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`lineage_closure` for keys and sources that are whole numbers, above -(2 ** 62) and below 2 ** 62; `name` makes what is returned for one from its column.

    A key's sources are packed, at best into a byte each, so a path takes a byte or two of shuffle where near numbers are near nodes. An edge is shuffled
    once by key, unless it can only be a walk's first step, and once by source, where the walk may go on; ranges of keys and sources show what cannot.
    Edges themselves are the first step and need no list; they go with the lists only where a longer walk can meet them again. The edges to a source
    that more than rows_per_task keys have are dealt to several tasks, each with a copy of the source's own lists.
    """
    none = 1 << 62  # stands for null
    within = lambda c, lo, hi: F.coalesce(F.col(c).between(lo, hi), F.lit(False))
    lo_hi = lambda c: (F.min(c), F.max(c))
    count, k0, k1, s0, s1 = edges.agg(F.count("*"), *lo_hi("key"), *lo_hi("source")).first()
    begins, goes_on = within("key", s0, s1), within("source", k0, k1)
    top = F.expr("approx_top_k(on, 1000, 10000)")
    a0, a1, b0, b1, top = edges.withColumn("on", F.when(goes_on, F.col("source")).cast("long")).agg(*lo_hi(F.when(goes_on, F.col("key"))), *lo_hi(F.when(begins, F.col("source"))), top).first()
    hubs = {x["item"]: -(-x["count"] // rows_per_task) for x in top if x["item"] is not None and x["count"] > rows_per_task}
    e = edges.select(*(F.coalesce(F.col(c).cast("long"), F.lit(none)).alias(c) for c in ("key", "source")))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // rows_per_task))

    lists = e.where(begins | ~goes_on).repartition(tasks, "key").dropDuplicates().sortWithinPartitions("key", "source").mapInArrow(packed.pack, packed.LISTS)
    shares = lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in hubs.items() for x in kv)), F.col(c)), F.lit(1))
    dealt = lambda df, c, f: df.withColumn("share", f(shares(c))) if hubs else df
    by = ["source", "share"] if hubs else ["source"]
    steps = dealt(e.where(goes_on), "source", lambda n: F.coalesce(F.pmod(F.xxhash64("key"), n), F.lit(0))).repartition(tasks, *by).dropDuplicates()
    walk = lambda first, now: first.join(dealt(now.withColumnRenamed("key", "source"), "source", lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))), by).select("key", "part", "items")
    at = lambda df, d: df.withColumn("depth", F.lit(d))
    found = lambda df, least: df.repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(packed.unpack(least), packed.FOUND)
    rows = lambda df: df.select("key", F.explode("sources").alias("source"), "depth")
    named = lambda df, c: df.withColumn(c, F.when(F.col(c) != none, name(c)))

    again = e.where((within("key", a0, a1) | (F.col("key") == none)) & (within("source", b0, b1) | (F.col("source") == none)))
    levels, now = [at(again.mapInArrow(packed.pack, packed.LISTS), 1)], lists
    for d in range(2, hops + 1):
        levels.append(at(walk(steps, now), d))
        if d == hops or a0 is None or a1 < s0 or a0 > s1:  # no step is from a key that another leads to
            break
        now = rows(found(at(walk(steps.where(begins), now), d), d)).mapInArrow(packed.pack, packed.LISTS)
    ends = rows(named(at(lists, 1).mapInArrow(packed.unpack(1), packed.FOUND), "key")).where(~goes_on)
    walks = rows(named(found(reduce(DataFrame.unionByName, levels), 2), "key"))  # a key is named once a list
    return named(named(at(steps.drop("share"), 1), "key").unionByName(ends).unionByName(walks), "source")


def catalog_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields added, removed or changed between two snapshots."""
    both = a.withColumnRenamed("category", "before").withColumn("in_a", F.lit(True)).join(b.withColumnRenamed("category", "after").withColumn("in_b", F.lit(True)), ["dataset", "field"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "REMOVED").when(~F.col("before").eqNullSafe(F.col("after")), "CHANGED")
    return both.select("dataset", "field", "before", "after", change.alias("change")).where("change is not null")


def label_conflicts(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """dataset, field, category (UNCLASSIFIED without a known label), n_categories; labels are compared lower-case without other characters than a-z and 0-9."""
    known = labels.withColumn("label", F.regexp_replace(F.lower("label"), "[^a-z0-9]", "")).join(dictionary, "label", "left")
    per = known.groupBy("dataset", "field").agg(F.count_distinct("category").alias("n_categories"), F.min("category").alias("c"))
    return per.select("dataset", "field", F.when(F.col("n_categories") == 1, F.col("c")).when(F.col("n_categories") == 0, "UNCLASSIFIED").alias("category"), "n_categories")


def asof_snapshot(events: DataFrame, snapshots: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each event (key, ts) with the latest snapshot (key, observed_at, expires_at, snapshot_id) of its key observed at or before it; stale at or after expiry.

    Union and a running last value, so no join multiplies rows; keys of more than rows_per_task rows are split.
    """
    e = events.select("key", "event_id", "ts", F.lit(1).alias("side"), F.lit(None).cast("string").alias("snapshot_id"), F.lit(None).cast("timestamp").alias("expires_at"))
    s = snapshots.select("key", F.lit(None).cast("long").alias("event_id"), F.col("observed_at").alias("ts"), F.lit(0).alias("side"), "snapshot_id", "expires_at")
    seen = F.when(F.col("side") == 0, F.struct("snapshot_id", "expires_at"))
    both = scan(cut(e.unionByName(s), "key", "ts", rows_per_task), ["ts", "side"], {"seen": ("last", seen)}, inclusive=True).done()
    state = F.when(F.col("seen").isNull(), "MISSING").when(F.col("seen.expires_at") <= F.col("ts"), "STALE").otherwise("FRESH")
    return both.where("side = 1").select("event_id", "key", "ts", F.col("seen.snapshot_id").alias("snapshot_id"), state.alias("freshness"))


def resolve_evidence(claims: DataFrame, now: Column) -> DataFrame:
    """Trust state of each (subject, predicate) from its claims, in the order UNKNOWN, AGENT_ASSERTED, STALE, INCOMPLETE, CONTESTED, TRUSTED."""
    fresh = (F.col("observed_at") <= now) & (F.col("expires_at") > now)
    good = F.col("source") != "agent"
    per = claims.groupBy("subject", "predicate").agg(F.count("*").alias("n"), _any(good).alias("any_good"), _any(good & fresh).alias("any_fresh"), _any(good & fresh & F.col("complete")).alias("any_complete"), F.count_distinct(F.when(good & fresh & F.col("complete"), F.col("value"))).alias("n_values"))
    state = F.when(F.col("n") == 0, "UNKNOWN").when(~F.col("any_good"), "AGENT_ASSERTED").when(~F.col("any_fresh"), "STALE").when(~F.col("any_complete"), "INCOMPLETE").when(F.col("n_values") > 1, "CONTESTED").otherwise("TRUSTED")
    return per.select("subject", "predicate", state.alias("trust_state"))


def check_plan(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id and violation: threshold and its subject stand together; a group key needs a grouped query."""
    half = queries.where(F.col("threshold").isNotNull() != F.col("threshold_subject").isNotNull()).select("query_id", F.when(F.col("threshold").isNotNull(), "THRESHOLD_WITHOUT_SUBJECT").otherwise("SUBJECT_WITHOUT_THRESHOLD").alias("violation"))
    keys = refs.where("kind = 'GROUP_KEY'").select("query_id").distinct().join(queries.where("not is_grouped"), "query_id", "left_semi").withColumn("violation", F.lit("KEY_WITHOUT_GROUPING"))
    return half.unionByName(keys)


def reconcile(found: DataFrame, expected: DataFrame) -> DataFrame:
    """asset and status of the assets that are not on both sides: MISSING or UNEXPECTED."""
    both = found.withColumn("f", F.lit(True)).join(expected.withColumn("e", F.lit(True)), "asset", "full_outer")
    return both.select("asset", F.when(F.col("f").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").alias("status")).where("status is not null")


def duplicate_fields(fields: DataFrame) -> DataFrame:
    return fields.groupBy("dataset", "field").agg(F.count("*").alias("n")).where("n > 1")


def drift(steps: DataFrame) -> DataFrame:
    """Requests that have seen more than one snapshot."""
    return steps.groupBy("request_id").agg(F.count_distinct("snapshot_sha256").alias("n_snapshots")).where("n_snapshots > 1")


def applicability(claims: DataFrame, now: Column) -> DataFrame:
    """claim_id, state: FUTURE before it was observed, EXPIRED at or after its end, else APPLICABLE."""
    return claims.select("claim_id", F.when(F.col("observed_at") > now, "FUTURE").when(F.col("expires_at") <= now, "EXPIRED").otherwise("APPLICABLE").alias("state"))


def support_gaps(claims: DataFrame, known: DataFrame) -> DataFrame:
    """claim_id and each support of it (array `supports`) that isn't a known claim."""
    each = claims.select("claim_id", F.explode(F.array_distinct("supports")).alias("missing"))
    return each.join(known.select(F.col("claim_id").alias("missing")), "missing", "left_anti").select("claim_id", "missing")


def evidence_root(claims: DataFrame) -> DataFrame:
    """Digest of each snapshot's set of claim digests."""
    return claims.groupBy("snapshot").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set("claim_sha256"))), 256).alias("root_sha256"))


# Fields that no release may show as they are.
FORBIDDEN_FIELDS = ["customer_id", "email", "phone", "full_name", "precise_area"]


def forbidden_outputs(refs: DataFrame, names: list[str] | None = None) -> DataFrame:
    return refs.where((F.col("kind") == "RAW_VALUE") & F.lower("field").isin(names or FORBIDDEN_FIELDS)).select("query_id", "field").distinct()


def prove_subject_count(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """query_id, proven: exactly one output counts the declared subject."""
    own = refs.where("kind = 'AGGREGATE_VALUE'").join(queries.select("query_id", "subject"), "query_id").where(F.concat_ws(".", "dataset", "field") == F.col("subject"))
    return own.groupBy("query_id").agg((F.count("*") == 1).alias("proven"))


def effective_outcome(decisions: DataFrame, checks: DataFrame) -> DataFrame:
    """query_id, outcome: a rewritten query is allowed if all its checks passed, and blocked if one failed or none was made."""
    per = checks.groupBy("query_id").agg(F.bool_and("passed").alias("ok"))
    return decisions.join(per, "query_id", "left").select("query_id", F.when(F.col("decision") != "REWRITE", F.col("decision")).when(F.col("ok"), "ALLOW").otherwise("BLOCK").alias("outcome"))


def plan_budget(plan_node: DataFrame, max_nodes: int = 2_000, max_depth: int = 64) -> DataFrame:
    """query_id, n_nodes, depth, over_budget; depth is max_depth + 1 where it is larger or nodes form a cycle.

    Pointer jumping: each round doubles the ancestors a node has passed, so 64 levels take seven joins.
    """
    # d counts the node and its ancestors below `up`, the next one to be counted
    now = plan_node.select("query_id", "node_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("d"))
    reach = 1
    while reach <= max_depth:
        above = now.select("query_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"))
        now = now.join(above, ["query_id", "up"], "left").select("query_id", "node_id", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        reach *= 2
    depth = F.least(F.max(F.when(F.col("up").isNotNull(), max_depth + 1).otherwise(F.col("d"))), F.lit(max_depth + 1))
    per = now.groupBy("query_id").agg(F.count("*").alias("n_nodes"), depth.alias("depth"))
    return per.withColumn("over_budget", (F.col("n_nodes") > max_nodes) | (F.col("depth") > max_depth))


def resolve_derived(projections: DataFrame, max_depth: int = 64, levels: int = 8, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Physical sources of each query's root outputs: query_id, output_name, dataset, field.

    projections: query_id, scope_id (0 is the root), output_name, dataset or src_scope, src_column.
    A reference to an output that isn't there, or that doesn't end within max_depth scopes (a cycle, or a plan deeper
    than the depth budget), becomes dataset @unresolved. After each `levels` scopes the rows are kept, and the search ends
    if none is open; it keeps nothing where max_depth is no more than that.
    """
    now = projections.where("scope_id = 0").select("query_id", F.col("output_name").alias("root_output"), "dataset", "src_scope", "src_column")
    lower = projections.select("query_id", F.col("scope_id").alias("src_scope"), F.col("output_name").alias("src_column"), F.col("dataset").alias("d2"), F.col("src_scope").alias("s2"), F.col("src_column").alias("c2"), F.lit(True).alias("there"))
    for level in range(1, max_depth + 1):
        open_, there = F.col("src_scope").isNotNull(), F.col("there").isNotNull()
        now = now.join(lower, ["query_id", "src_scope", "src_column"], "left").select(
            "query_id", "root_output", F.when(~open_, F.col("dataset")).when(~there, "@unresolved").otherwise(F.col("d2")).alias("dataset"),
            F.when(open_ & there, F.col("s2")).alias("src_scope"), F.when(open_ & there, F.col("c2")).otherwise(F.col("src_column")).alias("src_column"))
        if level % levels == 0 and level < max_depth:
            keep = keep or keeper(projections.sparkSession)
            now = keep(now.distinct())
            if now.where("src_scope is not null").isEmpty():
                break
    return now.select("query_id", F.col("root_output").alias("output_name"), F.when(F.col("src_scope").isNotNull(), "@unresolved").otherwise(F.col("dataset")).alias("dataset"), F.col("src_column").alias("field")).distinct()


def bind_unqualified(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, field, dataset, reason: an unqualified column belongs to the only source of its query, else AMBIGUOUS_COLUMN."""
    per = sources.groupBy("query_id").agg(F.count_distinct("dataset").alias("n"), F.min("dataset").alias("d"))
    return refs.join(per, "query_id", "left").select("query_id", "field", F.when(F.col("n") == 1, F.col("d")).alias("dataset"), F.when(F.coalesce(F.col("n"), F.lit(0)) != 1, "AMBIGUOUS_COLUMN").alias("reason"))


def admissible(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Claims whose (source, derivation) a rule allows; those of agents and fuzzy derivations never are."""
    return claims.where("source <> 'agent' and derivation <> 'fuzzy'").join(rules, ["source", "derivation"], "left_semi")


def replay_diff(candidate: DataFrame, expected: DataFrame) -> DataFrame:
    """claim_id and fault of a candidate claim set against the expected one: MISSING, UNEXPECTED, DUPLICATE or CHANGED."""
    c = candidate.groupBy("claim_id").agg(F.count("*").alias("n"), F.min("content_sha256").alias("got"))
    both = c.join(expected.select("claim_id", F.col("content_sha256").alias("want")), "claim_id", "full_outer")
    fault = F.when(F.col("n").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("n") > 1, "DUPLICATE").when(F.col("got") != F.col("want"), "CHANGED")
    return both.select("claim_id", fault.alias("fault")).where("fault is not null")


def merge_context(first: DataFrame, second: DataFrame) -> DataFrame:
    """One context row for each (query_id, dataset, field); the second wins."""
    both = first.withColumn("o", F.lit(1)).unionByName(second.withColumn("o", F.lit(2)))
    return both.groupBy("query_id", "dataset", "field").agg(F.max_by("category", "o").alias("category"))


def governed_columns(context: DataFrame) -> DataFrame:
    """query_id, columns by category (sorted keys), rejected: some column is unclassified."""
    key = F.concat_ws(".", "dataset", "field")
    own = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("category") == c, key))))
    return context.groupBy("query_id").agg(own("QUASI_IDENTIFIER").alias("quasi"), own("SENSITIVE_ATTRIBUTE").alias("sensitive"), _any(F.col("category").isNull() | (F.col("category") == "UNCLASSIFIED")).alias("rejected"))


def qualify(df: DataFrame, *parts: str) -> DataFrame:
    """Adds qualified_name: the parts that are there, joined by dots."""
    return df.withColumn("qualified_name", F.concat_ws(".", *parts))


def mark_group_keys(outputs: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds is_group_key: the query groups by the output's column. keys: query_id, dataset, field."""
    own = keys.select("query_id", "dataset", "field").distinct().withColumn("is_group_key", F.lit(True))
    return outputs.join(own, ["query_id", "dataset", "field"], "left").fillna(False, ["is_group_key"])


def is_pure_count() -> Column:
    """A bare count of all rows, of one column or of its distinct values, over facts agg, is_filter, nested, n_columns and bare."""
    return (F.col("agg") == "count") & ~F.col("is_filter") & ~F.col("nested") & ((F.col("n_columns") == 0) | ((F.col("n_columns") == 1) & F.col("bare")))


def root_outputs(outputs: DataFrame) -> DataFrame:
    """query_id, keys: sorted unique columns that the root scope (scope_id 0) shows."""
    return outputs.where("scope_id = 0").groupBy("query_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.concat_ws(".", "dataset", "field")))).alias("keys"))


def evidence(queries: DataFrame, refs: DataFrame, catalog: DataFrame, lineage: DataFrame) -> DataFrame:
    """query_id and evidence: the shown columns of each category (own or upstream, sorted), what is unresolved, and the threshold."""
    rows = effective(resolve_context(refs, catalog), lineage, catalog)
    shown = F.col("kind").isin(EXPOSED)
    keys = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("eff_key"))))
    per = rows.groupBy("query_id").agg(
        keys(shown & (F.col("eff_category") == "DIRECT_IDENTIFIER")).alias("direct"), keys(shown & (F.col("eff_category") == "STABLE_PSEUDONYM")).alias("pseudonyms"), keys(shown & (F.col("eff_category") == "QUASI_IDENTIFIER")).alias("quasi"),
        keys(shown & (F.col("eff_category") == "SENSITIVE_ATTRIBUTE")).alias("sensitive"), keys(F.col("context_reason").isNotNull()).alias("unresolved"),
    )
    parts = ["direct", "pseudonyms", "quasi", "sensitive", "unresolved"]
    none = F.array().cast("array<string>")
    return queries.join(per, "query_id", "left").select("query_id", F.struct(*(F.coalesce(c, none).alias(c) for c in parts), "threshold", "threshold_subject").alias("evidence"))


def edit_refs(queries: DataFrame, refs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plan facts of changed queries: a query for each (query_id, variant) of the edits, with the id `query_id#variant`.

    edits: query_id, variant, op (ADD, REMOVE, or KEEP for a variant that changes no column), dataset, field, kind.
    """
    name = F.concat_ws("#", F.col("query_id").cast("string"), "variant")
    each = edits.select("query_id", "variant").distinct()
    gone = edits.where("op = 'REMOVE'").select("query_id", "variant", "dataset", "field").distinct()
    rest = each.join(refs, "query_id").join(gone, ["query_id", "variant", "dataset", "field"], "left_anti")
    new = edits.where("op = 'ADD'").select("query_id", "variant", "dataset", "field", "kind")
    both = rest.select(*new.columns).unionByName(new).withColumn("query_id", name).drop("variant")
    return each.join(queries, "query_id").withColumn("query_id", name), both
