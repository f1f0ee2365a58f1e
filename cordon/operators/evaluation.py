"""Evaluation of decision logs, repairs and receipts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ["ALLOW", "REWRITE", "BLOCK"]


def match(results: DataFrame) -> DataFrame:
    """Adds decision_ok and reason_ok against expected_initial and expected_reason."""
    return results.withColumn("decision_ok", F.col("decision") == F.col("expected_initial")).withColumn("reason_ok", F.array_contains("reasons", F.col("expected_reason")))


def confusion(results: DataFrame) -> DataFrame:
    """Expected by actual decision; cells without rows are 0."""
    return results.groupBy("expected_initial").pivot("decision", DECISIONS).agg(F.count(F.lit(1))).fillna(0, DECISIONS)


def metrics(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_cases"), F.count_if("decision_ok").alias("n_correct"), F.round(F.avg(F.col("decision_ok").cast("double")), 6).alias("accuracy"),
        F.count_if((F.col("decision") == "ALLOW") & (F.col("expected_initial") != "ALLOW")).alias("false_allows"), F.count_if((F.col("decision") != "ALLOW") & (F.col("expected_initial") == "ALLOW")).alias("false_blocks"),
    )


def gates(m: DataFrame, min_accuracy: float = 1.0) -> DataFrame:
    """Gates that a row of metrics fails."""
    failed = F.array_compact(F.array(F.when(F.col("accuracy") < min_accuracy, F.lit("ACCURACY")), F.when(F.col("false_allows") > 0, F.lit("FALSE_ALLOWS")), F.when(F.col("n_cases") == 0, F.lit("EMPTY"))))
    return m.select(F.explode(failed).alias("gate"))


def check_labels(cases: DataFrame, key: str = "case_id", label: str = "expected_initial") -> DataFrame:
    return cases.groupBy(label).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_cases"))


# Dimensions of the mutation matrix.
FAMILIES = ["support_case", "churn_score", "purchase_amount"]
ALIASES = [("c", "s"), ("cust", "sens"), ("a", "b"), ("x1", "x2")]
JOINS = ["JOIN", "INNER JOIN"]
PREDICATES = ["none", "age", "area"]
TAILS = ["none", "limit"]


def mutations(spark) -> DataFrame:
    """The 144 combinations of the matrix, with a stable id. The dimensions are fixed lists."""
    lists = [("family", FAMILIES), ("aliases", ["/".join(a) for a in ALIASES]), ("join_style", JOINS), ("predicate", PREDICATES), ("tail", TAILS)]
    out = spark.range(1).select()
    for name, values in lists:
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.withColumn("mutation_id", F.substring(F.sha2(F.concat_ws("|", *(n for n, _ in lists)), 256), 1, 16))


def sessions(attempts: DataFrame, most: int = 4) -> DataFrame:
    """session, first_allowed (attempt number), exhausted: no attempt of the first `most` was allowed."""
    per = attempts.groupBy("session").agg(F.min(F.when(F.col("allowed") & (F.col("attempt") <= most), F.col("attempt"))).alias("first_allowed"), F.count("*").alias("n_attempts"))
    return per.withColumn("exhausted", F.col("first_allowed").isNull() & (F.col("n_attempts") >= most))


def candidates(actions: DataFrame) -> DataFrame:
    """All single and paired repair actions of each query: query_id, first, second (null for a single), cost. A query has a few dozen actions at most, which is checked by the caller's bound."""
    one = actions.select("query_id", F.col("action").alias("first"), F.lit(None).cast("string").alias("second"), "goal_cost", "info_cost", "change_cost")
    b = actions.select("query_id", F.col("action").alias("second"), *(F.col(c).alias(f"_{c}") for c in ("goal_cost", "info_cost", "change_cost")))
    two = actions.withColumnRenamed("action", "first").join(b, "query_id").where("first < second").select("query_id", "first", "second", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("goal_cost", "info_cost", "change_cost")))
    return one.unionByName(two)


def choose_action(actions: DataFrame, eligible: Callable[[Column], Column]) -> DataFrame:
    """What `choose_repair` chooses from the `candidates` of the actions of which `eligible` (a condition on a candidate's columns) holds.
    Only a query's actions are shuffled, repeats once; its singles and pairs are made in its row and never stand as rows."""
    costs = ("goal_cost", "info_cost", "change_cost")
    none = F.lit(None).cast("string")
    per = actions.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("action", *costs))).alias("acts"))
    one = F.transform("acts", lambda x: F.struct(x.action.alias("first"), none.alias("second"), *(x[c].alias(c) for c in costs)))
    pair = lambda x, y: F.struct(x.action.alias("first"), y.action.alias("second"), *((x[c] + y[c]).alias(c) for c in costs))
    after = lambda x: F.filter("acts", lambda y: F.col("query_id").isNotNull() & (x.action < y.action))
    two = F.flatten(F.transform("acts", lambda x: F.transform(after(x), lambda y: pair(x, y))))
    own = per.withColumn("cands", F.concat(one, two)).withColumn("fit", F.filter("cands", eligible))
    best = F.array_min(F.transform("fit", lambda c: F.struct(*(c[n].alias(n) for n in costs), F.concat_ws("+", c["first"], c["second"]).alias("name"))))
    status = F.when(F.size("fit") > 0, "REPAIR_FOUND").otherwise("NO_ELIGIBLE_REPAIR")
    return own.select("query_id", best["name"].alias("repair"), F.size("fit").cast("long").alias("n_eligible"), F.size("cands").cast("long").alias("n_candidates"), status.alias("status"))


def choose_repair(evaluated: DataFrame) -> DataFrame:
    """The cheapest eligible candidate of each query, the smaller name on ties; and the query's status."""
    name = F.concat_ws("+", "first", "second")
    best = F.min(F.when(F.col("eligible"), F.struct("goal_cost", "info_cost", "change_cost", name.alias("name"))))
    per = evaluated.groupBy("query_id").agg(best.alias("b"), F.count_if("eligible").alias("n_eligible"), F.count("*").alias("n_candidates"))
    return per.select("query_id", F.col("b.name").alias("repair"), "n_eligible", "n_candidates", F.when(F.col("n_eligible") > 0, "REPAIR_FOUND").otherwise("NO_ELIGIBLE_REPAIR").alias("status"))


def repair_status(evaluated: DataFrame) -> DataFrame:
    """query_id, repair, status of candidates (query_id, candidate, three costs, eligible, failed): FAIL_CLOSED, without a repair, if the check
    of any candidate failed (or tells nothing), else REPAIR_FOUND with the cheapest eligible one, else NO_ELIGIBLE_REPAIR."""
    best = F.min(F.when(F.col("eligible"), F.struct("goal_cost", "info_cost", "change_cost", "candidate")))
    per = evaluated.groupBy("query_id").agg(best.alias("b"), F.bool_or(F.coalesce("failed", F.lit(True))).alias("failed"))
    status = F.when(F.col("failed"), "FAIL_CLOSED").when(F.col("b").isNotNull(), "REPAIR_FOUND").otherwise("NO_ELIGIBLE_REPAIR")
    return per.select("query_id", F.when(~F.col("failed"), F.col("b.candidate")).alias("repair"), status.alias("status"))


def content_sha(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def build_receipts(decisions: DataFrame, key: bytes) -> DataFrame:
    """Receipts of decisions without result rows: content digest and HMAC seal."""
    from ..functions.text import hmac_sha256

    r = decisions.select(F.concat(F.lit("r-"), F.col("query_id").cast("string")).alias("receipt_id"), "principal", "decision", F.concat_ws(",", "reasons").alias("reasons"), "trusted_threshold")
    return r.withColumn("content_sha256", content_sha("receipt_id", "principal", "decision", "reasons", "trusted_threshold")).withColumn("seal", hmac_sha256(F.col("content_sha256"), key))


def verify_receipts(receipts: DataFrame, key: bytes) -> DataFrame:
    """Receipts whose digest or seal is wrong."""
    from ..functions.text import hmac_sha256

    fault = F.when(content_sha("receipt_id", "principal", "decision", "reasons", "trusted_threshold") != F.col("content_sha256"), "DIGEST").when(hmac_sha256(F.col("content_sha256"), key) != F.col("seal"), "SEAL")
    return receipts.withColumn("fault", fault).where("fault is not null")


def repair_funnel(evaluated: DataFrame) -> DataFrame:
    """stage (the last that a candidate reached), n, n_reached (candidates that reached it). The stages are a fixed few."""
    per = evaluated.groupBy("stage").agg(F.count("*").alias("n"))
    return per.withColumn("n_reached", F.sum("n").over(Window.orderBy(F.desc("stage"))))


def mutation_report(results: DataFrame) -> DataFrame:
    """family, n, n_blocked, n_executed of mutation outcomes."""
    return results.groupBy("family").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "BLOCK").alias("n_blocked"), F.count_if(F.col("decision") != "BLOCK").alias("n_executed"))


def check_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts that break a rule: REWRITE_WITHOUT_TEXT, RUN_NOT_ALLOWED or RUN_WITH_FAILED_CHECK."""
    fault = F.when((F.col("decision") == "REWRITE") & F.col("safe_text").isNull(), "REWRITE_WITHOUT_TEXT").when(F.col("executed") & (F.col("final_decision") != "ALLOW"), "RUN_NOT_ALLOWED").when(F.col("executed") & ~F.forall("checks", lambda c: c), "RUN_WITH_FAILED_CHECK")
    return receipts.withColumn("fault", fault).where("fault is not null").select("receipt_id", "fault")


def candidate_cost(cands: DataFrame, costs: DataFrame) -> DataFrame:
    """Adds goal_cost, info_cost and change_cost of candidates (query_id, candidate, actions array) from a table of action costs."""
    each = cands.select("query_id", "candidate", F.explode("actions").alias("action")).join(costs, "action")
    return each.groupBy("query_id", "candidate").agg(*(F.sum(c).alias(c) for c in ("goal_cost", "info_cost", "change_cost")))


# What each family selects beside the subject.
FAMILY_COLUMNS = {"support_case": ("support_cases", "case_category"), "churn_score": ("retention_scores", "churn_score"), "purchase_amount": ("orders", "purchase_amount")}


def render(mutations: DataFrame) -> DataFrame:
    """Adds sql_text, the statement that a mutation stands for."""
    pick = lambda k: F.create_map(*(F.lit(x) for f, own in FAMILY_COLUMNS.items() for x in (f, own[k])))[F.col("family")]
    a, b = F.split("aliases", "/")[0], F.split("aliases", "/")[1]
    where = F.when(F.col("predicate") == "age", F.concat(F.lit(" WHERE "), a, F.lit(".age_band = '18-29'"))).when(F.col("predicate") == "area", F.concat(F.lit(" WHERE "), a, F.lit(".precise_area IS NOT NULL"))).otherwise("")
    parts = ["SELECT ", a, ".customer_id, ", b, ".", pick(1), " FROM customers ", a, " ", F.col("join_style"), " ", pick(0), " ", b, " ON ", a, ".customer_id = ", b, ".customer_id", where, F.when(F.col("tail") == "limit", " LIMIT 10").otherwise("")]
    return mutations.withColumn("sql_text", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def report_sha(report: DataFrame) -> DataFrame:
    """One digest of a report's rows, in any order, with their number."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(report.columns))), 256)
    part = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    sums = report.select(part.alias("p")).agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor("p"), F.lit(0)).alias("x"), F.coalesce(F.sum("p"), F.lit(0)).alias("s"))
    return sums.select("n_rows", F.sha2(F.concat_ws("|", "n_rows", "x", "s"), 256).alias("report_sha256"))


def sequences(events: DataFrame, scenarios: dict[str, tuple[str, str]], maximum: int, window_s: int) -> DataFrame:
    """Every event (record_id, scope, ts, protected) under each release scenario, with the budget's decision.

    scenarios: name to the cohort and family under which a scope's later releases are made. What
    a credential, cohort or family is called changes no scope, so the budget must hold in all.
    """
    from .ledger import replay_budget

    names = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("cohort"), F.lit(f).alias("family")) for n, (c, f) in scenarios.items())))
    each = events.withColumn("x", names).select("*", "x.scenario", "x.cohort", "x.family").drop("x").withColumn("key", F.concat_ws("|", F.col("scope").cast("string"), "scenario"))
    return replay_budget(each, maximum, window_s, key="key")
