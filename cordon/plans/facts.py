"""Plan facts of a query log: request templates joined to a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Governed catalog (dataset, field, category).
CATALOG = [
    ("customers", "customer_id", "STABLE_PSEUDONYM"), ("customers", "age_band", "QUASI_IDENTIFIER"), ("customers", "precise_area", "QUASI_IDENTIFIER"), ("customers", "coarse_region", "QUASI_IDENTIFIER"),
    ("orders", "order_id", "PUBLIC_OR_LOW_RISK"), ("orders", "customer_id", "STABLE_PSEUDONYM"), ("orders", "purchase_amount", "SENSITIVE_ATTRIBUTE"), ("orders", "category", "PUBLIC_OR_LOW_RISK"), ("orders", "ordered_at", "PUBLIC_OR_LOW_RISK"),
    ("support_cases", "case_id", "PUBLIC_OR_LOW_RISK"), ("support_cases", "customer_id", "STABLE_PSEUDONYM"), ("support_cases", "case_category", "SENSITIVE_ATTRIBUTE"), ("support_cases", "sensitivity_level", "SENSITIVE_ATTRIBUTE"),
    ("location_activity", "customer_id", "STABLE_PSEUDONYM"), ("location_activity", "precise_area", "QUASI_IDENTIFIER"), ("location_activity", "activity_count", "PUBLIC_OR_LOW_RISK"),
    ("retention_scores", "customer_id", "STABLE_PSEUDONYM"), ("retention_scores", "churn_score", "SENSITIVE_ATTRIBUTE"), ("retention_scores", "model_timestamp", "PUBLIC_OR_LOW_RISK"),
]
# Lineage (dataset, field, source dataset, source field).
LINEAGE = [
    ("retention_scores", "customer_id", "customers", "customer_id"), ("retention_scores", "churn_score", "orders", "purchase_amount"), ("retention_scores", "churn_score", "support_cases", "case_category"),
    ("retention_scores", "churn_score", "support_cases", "sensitivity_level"), ("retention_scores", "churn_score", "location_activity", "activity_count"), ("retention_scores", "churn_score", "location_activity", "precise_area"),
]
# Request templates (template, case, grouped, threshold, threshold subject, declared subject, upstream failure,
# expected first decision, expected outcome, expected reason).
_OK, _SMALL, _RISK = "NO_COMPOSITIONAL_RISK", "SMALL_GROUP_RISK", "COMPOSITIONAL_REIDENTIFICATION_RISK"
TEMPLATES = [
    (0, "A01", True, None, None, "orders.customer_id", None, "ALLOW", "ALLOW", _OK),
    (1, "A02", False, None, None, "orders.customer_id", None, "ALLOW", "ALLOW", _OK),
    (2, "A03", False, None, None, "orders.customer_id", None, "ALLOW", "ALLOW", _OK),
    (3, "A04", True, None, None, "customers.customer_id", None, "ALLOW", "ALLOW", _OK),
    (4, "A05", True, None, None, "customers.customer_id", None, "ALLOW", "ALLOW", _OK),
    (5, "A06", True, None, None, "customers.customer_id", None, "ALLOW", "ALLOW", _OK),
    (6, "A07", True, None, None, "orders.customer_id", None, "ALLOW", "ALLOW", _OK),
    (7, "A08", False, None, None, "retention_scores.customer_id", None, "ALLOW", "ALLOW", _OK),
    (8, "A09", False, None, None, "retention_scores.customer_id", None, "ALLOW", "ALLOW", _OK),
    (9, "A10", False, None, None, "support_cases.customer_id", None, "ALLOW", "ALLOW", _OK),
    (10, "R01", True, None, None, "customers.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (11, "R02", True, 5, "customers.customer_id", "customers.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (12, "R03", True, None, None, "orders.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (13, "R04", True, None, None, "customers.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (14, "R05", True, None, None, "customers.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (15, "R06", True, None, None, "customers.customer_id", None, "REWRITE", "ALLOW", _SMALL),
    (16, "R07", True, None, None, "customers.customer_id", None, "REWRITE", "BLOCK", _SMALL),
    (17, "R08", True, None, None, "customers.customer_id", None, "REWRITE", "BLOCK", _SMALL),
    (18, "R09", True, 20, "orders.order_id", "orders.customer_id", None, "REWRITE", "BLOCK", _SMALL),
    (19, "R10", True, None, None, "customers.customer_id", None, "REWRITE", "BLOCK", _SMALL),
    (20, "B01", False, None, None, "customers.customer_id", None, "BLOCK", "BLOCK", _RISK),
    (21, "B02", False, None, None, "customers.customer_id", None, "BLOCK", "BLOCK", _RISK),
    (22, "B03", False, None, None, "customers.customer_id", None, "BLOCK", "BLOCK", _RISK),
    (23, "B04", False, None, None, "unknown_customers.customer_id", None, "BLOCK", "BLOCK", "UNRESOLVED_DATASET"),
    (24, "B05", False, None, None, "customers.customer_id", None, "BLOCK", "BLOCK", "UNRESOLVED_COLUMN"),
    (25, "B06", False, None, None, "customers.customer_id", None, "BLOCK", "BLOCK", "UNRESOLVED_COLUMN"),
    (26, "B07", False, None, None, "customers.customer_id", "UNSUPPORTED_STATEMENT", "BLOCK", "BLOCK", "UNSUPPORTED_STATEMENT"),
    (27, "B08", False, None, None, "orders.customer_id", "MULTIPLE_STATEMENTS", "BLOCK", "BLOCK", "MULTIPLE_STATEMENTS"),
    (28, "B09", False, None, None, "customers.customer_id", "AMBIGUOUS_COLUMN", "BLOCK", "BLOCK", "AMBIGUOUS_COLUMN"),
    (29, "B10", False, None, None, "customers.customer_id", "UNSUPPORTED_STATEMENT", "BLOCK", "BLOCK", "UNSUPPORTED_STATEMENT"),
]
# Columns of each template, `dataset.field kind`; a kind of - is referenced only.
_REGION, _AREA, _SUBJECT, _SCORE = "customers.coarse_region GROUP_KEY", "customers.precise_area GROUP_KEY", "customers.customer_id AGGREGATE_VALUE", "retention_scores.churn_score AGGREGATE_OPERAND"
_EXPORT = ["customers.customer_id RAW_VALUE", "customers.age_band RAW_VALUE", "customers.precise_area RAW_VALUE"]
_COLUMNS = {
    0: ["orders.category GROUP_KEY"], 1: ["orders.category RAW_VALUE"], 2: ["orders.order_id RAW_VALUE", "orders.category RAW_VALUE"], 3: ["customers.age_band GROUP_KEY"], 4: [_REGION, _SUBJECT],
    5: [_REGION, "location_activity.activity_count AGGREGATE_OPERAND", "customers.customer_id -", "location_activity.customer_id -"], 6: ["orders.category GROUP_KEY", "orders.ordered_at AGGREGATE_OPERAND"],
    8: ["retention_scores.model_timestamp RAW_VALUE"], 9: ["support_cases.case_id RAW_VALUE"],
    10: [_REGION, _SCORE, _SUBJECT, "retention_scores.customer_id -"], 11: [_REGION, _SCORE, _SUBJECT, "retention_scores.customer_id -"],
    12: ["orders.category GROUP_KEY", "orders.purchase_amount AGGREGATE_OPERAND", "orders.customer_id AGGREGATE_VALUE"], 13: [_REGION, "orders.purchase_amount AGGREGATE_OPERAND", _SUBJECT, "orders.customer_id -"],
    14: [_REGION, "support_cases.case_category GROUP_KEY", _SUBJECT, "support_cases.customer_id -"], 15: [_REGION, _SCORE, _SUBJECT, "retention_scores.customer_id -"],
    16: [_AREA, _SCORE, _SUBJECT, "retention_scores.customer_id -"], 17: [_AREA, "orders.purchase_amount AGGREGATE_OPERAND", _SUBJECT, "orders.customer_id -"],
    18: ["orders.category GROUP_KEY", "orders.purchase_amount AGGREGATE_OPERAND", "orders.customer_id AGGREGATE_VALUE", "orders.order_id -"], 19: [_REGION, _SCORE, _SUBJECT, "retention_scores.customer_id -"],
    20: [*_EXPORT, "support_cases.case_category RAW_VALUE", "support_cases.customer_id -"], 21: [*_EXPORT, "retention_scores.churn_score RAW_VALUE", "retention_scores.customer_id -"], 22: [*_EXPORT, "orders.purchase_amount RAW_VALUE", "orders.customer_id -"],
    23: ["unknown_customers.customer_id RAW_VALUE"], 24: ["customers.unclassified_new_field RAW_VALUE"], 25: ["customers.* RAW_VALUE"],
}
REFS = [(t, *c.split(" ")[0].split("."), None if c.endswith(" -") else c.split(" ")[1]) for t, own in _COLUMNS.items() for c in own]
TABLES = {
    "catalog": (CATALOG, "dataset string, field string, category string"),
    "lineage": (LINEAGE, "dataset string, field string, src_dataset string, src_field string"),
    "template": (TEMPLATES, "template long, case_id string, is_grouped boolean, threshold int, threshold_subject string, subject string, upstream string, expected_initial string, expected_effective string, expected_reason string"),
    "template_ref": (REFS, "template long, dataset string, field string, kind string"),
}


def fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of given rows whose size Catalyst knows, so that it is broadcast; rows of unknown size are joined by a shuffle that sends all that names one dataset to one task."""
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = [c.strip().split(" ") for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    typed = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({', '.join(name for name, _ in columns)})")


def small(spark: SparkSession, name: str) -> DataFrame:
    """One of the fixed tables, a few dozen rows whatever the log's size."""
    return fixed(spark, *TABLES[name])


def values_sql(name: str) -> str:
    """The same table as a SQL CTE body."""
    rows, schema = TABLES[name]
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    columns = ", ".join(c.strip().split(" ")[0] for c in schema.split(","))
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def request_log(events: DataFrame) -> DataFrame:
    """Requests from an event table: query_id, principal, ts, template."""
    return events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("principal"), "ts", F.pmod("event_id", F.lit(30)).alias("template"))


LOG_SQL = "log AS (SELECT event_id AS query_id, user_id AS principal, ts, event_id % 30 AS template FROM events)"


def log_facts(spark: SparkSession, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries (one row a request) and query_ref (one row a request and column) of a log. The templates are a fixed table, so it is broadcast."""
    log = request_log(events)
    queries = log.join(F.broadcast(small(spark, "template")), "template")
    refs = log.select("query_id", "template").join(F.broadcast(small(spark, "template_ref")), "template").drop("template")
    return queries, refs
