"""Operators on small fixtures: folds, tampering, sources, sinks, rules."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon import queries as own
from cordon.functions import text as fx
from cordon.operators import evaluation as ev
from cordon.operators import folds, history, ledger, policy, release, repair
from cordon.operators import variants as va
from cordon.plans import facts
from cordon.sources import sinks, tables


def releases(spark, times, protected=None):
    rows = [(k, "s", t, True if protected is None else protected[k]) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "record_id long, scope string, sec long, protected boolean").withColumn("ts", F.timestamp_seconds("sec"))


def decisions(df):
    return [r.rule for r in df.orderBy("record_id").collect()]


def test_budget_of_two(spark):
    out = ledger.replay_budget(releases(spark, [0, 10, 20]), 2, 3600)
    assert decisions(out) == ["FIRST_PROTECTED_RELEASE", "PROTECTED_RELEASE_WITHIN_BUDGET", "CUMULATIVE_BUDGET_EXHAUSTED"]


def test_budget_horizon_is_exclusive_and_denied_releases_cost_nothing(spark):
    out = ledger.replay_budget(releases(spark, [0, 3599, 3600, 7200]), 1, 3600)
    assert [r.allowed for r in out.orderBy("record_id").collect()] == [True, False, True, True]


def test_legacy_history_blocks_even_unprotected(spark):
    df = releases(spark, [0, 100_000, 200_000], [True, False, True]).withColumn("old", F.col("record_id") == 0)
    assert decisions(ledger.replay_budget(df, 5, 10, legacy="old"))[1:] == ["LEGACY_HISTORY_BLOCK"] * 2


def test_chain_and_tampering(spark):
    df = ledger.chain(releases(spark, [1, 2, 3]).withColumn("payload", F.concat(F.lit("p"), "record_id")))
    assert ledger.verify_chain(df).count() == 0
    bad = df.withColumn("content_sha256", F.when(F.col("record_id") == 1, "x").otherwise(F.col("content_sha256")))
    assert {r.record_id: r.fault for r in ledger.verify_chain(bad).collect()} == {1: "DIGEST", 2: "LINK"}


def test_hmac_equals_the_standard_library(spark):
    key = b"k" * 80
    row = spark.createDataFrame([("äbc",)], "m string").select(fx.hmac_sha256(F.col("m"), key).alias("h")).first()
    assert row.h == hmac.new(key, "äbc".encode(), hashlib.sha256).hexdigest()


def test_screen(spark):
    cases = {"SELECT 1": None, "": "UNSUPPORTED_STATEMENT", "SELECT 'drop; x'": None, "SELECT 1; SELECT 2": "MULTIPLE_STATEMENTS", "drop table x": "UNSUPPORTED_STATEMENT", "SELECT 1 -- delete": None, None: "UNSUPPORTED_STATEMENT"}
    df = spark.createDataFrame([(k,) for k in cases], "sql_text string")
    assert {r.sql_text: r.screen_reason for r in fx.screen_statements(df).collect()} == cases


def test_secrets_in_four_spellings(spark):
    import base64

    s = "pass word/1"
    texts = [s, "pass+word%2F1", s.encode().hex(), base64.b64encode(s.encode()).decode(), "none"]
    df = spark.createDataFrame([(k, f"x {t} y") for k, t in enumerate(texts)], "id int, text string")
    out = fx.scan_secrets(df, "text", spark.createDataFrame([(7, s)], "secret_id int, secret string"))
    assert {r.id: r.spelling for r in out.collect()} == {0: "raw", 1: "percent", 2: "hex", 3: "base64"}


def test_warehouse_invariants(spark):
    w = tables.gen_warehouse(spark, 120)
    assert {r.table_name: r.n_rows for r in tables.row_counts(w).collect()} == {"customers": 120, "orders": 360, "support_cases": 120, "location_activity": 120, "retention_scores": 120}
    assert [r.subject_count for r in release.subjects_by(w["customers"], ["coarse_region"], "customer_id").collect()] == [40] * 3
    assert [r.subject_count for r in release.subjects_by(w["customers"], ["precise_area"], "customer_id").collect()] == [10] * 12
    assert release.release_min_group(w["customers"], ["precise_area"], [], "customer_id").count() == 0


def test_warehouse_query_shows_ids_as_its_sql(spark, tmp_path):
    import duckdb

    spark.range(100_020).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = own.QUERIES["a1_warehouse"](spark, str(tmp_path)).where("customer_id like 'C1000_'")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT * FROM ({own.ORACLES['a1_warehouse']}) WHERE customer_id LIKE 'C1000_'").fetchall())


def test_empty_release_fails_the_group_check(spark):
    empty = spark.createDataFrame([], "g string, subject_count long")
    assert release.check_groups(empty).first().passed is False


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") % 7)
    a, b = tables.fingerprint(df).first(), tables.fingerprint(df.orderBy(F.desc("id"))).first()
    assert a == b != tables.fingerprint(df.where("id > 0")).first()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("s", T.StringType())])
    assert tables.read_typed_csv(spark, str(tmp_path / "a.csv"), schema).count() == 2
    (tmp_path / "c.json").write_text('{"version": "1", "datasets": {"d": {"urn": "u", "fields": {"f": {"category": "PUBLIC_OR_LOW_RISK", "tags": []}}}}}')
    assert tables.read_catalog(spark, str(tmp_path / "c.json")).select("dataset", "field", "category").collect() == [("d", "f", "PUBLIC_OR_LOW_RISK")]
    receipts = lambda sha: spark.createDataFrame([("r1", sha)], "receipt_id string, content_sha256 string")
    to = str(tmp_path / "receipts")
    assert sinks.write_receipts(receipts("a"), to).count() == 0
    assert sinks.write_receipts(receipts("a"), to).count() == 0
    assert sinks.write_receipts(receipts("b"), to).count() == 1
    assert spark.read.parquet(to).count() == 1
    sinks.append_ledger(spark.createDataFrame([("s", 1)], "scope string, n int"), str(tmp_path / "ledger"))
    sinks.append_ledger(spark.createDataFrame([("s", 2)], "scope string, n int"), str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x").write_bytes(b"1")
    (tmp_path / "o" / "y").write_bytes(b"2")
    sha = hashlib.sha256(b"1").hexdigest()
    cat = spark.createDataFrame([("x", 1, sha), ("z", 1, sha)], "path string, size long, sha256 string")
    assert {r.path: r.status for r in tables.audit_objects(spark, str(tmp_path / "o" / "*"), cat).collect()} == {"x": "ok", "y": "unexpected", "z": "missing"}


def test_matrix_has_144_rows(spark):
    df = ev.mutations(spark)
    assert df.count() == df.select("mutation_id").distinct().count() == 144


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "key string, source string")
    assert {(r.key, r.source): r.depth for r in policy.lineage_closure(edges).collect()}[("a", "a")] == 3


def test_closure_shuffles_no_row_a_path(spark):
    import itertools

    rows = [(f"o{k % 40}", f"p{k % 7}") for k in range(200)] + [(f"p{k % 7}", f"s{k % 9}") for k in range(60)] + [("s1", None), ("s2", "o3"), (None, "x"), ("o1", "s1"), ("o1", "o1")]
    edges, want = spark.createDataFrame(rows, "key string, source string"), {}
    for a in set(rows):
        now = {a}
        for d in range(1, 4):
            for key, source in now:
                want[key, source] = min(d, want.get((key, source), d))
            now = {(k, y) for (k, x), (v, y) in itertools.product(now, set(rows)) if x is not None and x == v}
    for most in (1_000_000, 100):  # whole lists, and lists in parts
        out = policy.lineage_closure(edges, 3, most)
        assert sorted(map(repr, ((r.key, r.source, r.depth) for r in out.collect()))) == sorted(repr((k, s, d)) for (k, s), d in want.items())
    # paths become rows after the last shuffle
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1


def test_packed_closure_equals_brute_force(spark):
    import itertools
    import random

    pick = random.Random(4)
    ids = [0, 1, 5, -7, (1 << 24) - 1, 1 << 24, (1 << 24) + 300, 70_000, -(1 << 40), (1 << 61) + 3, 1 - (1 << 62), (1 << 62) - 1, None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # lists are cut by batches
    try:
        for hops, n, most in ((1, 30, 1000), (2, 40, 2), (3, 40, 1000), (3, 40, 2), (4, 25, 1000), (3, 0, 1000)):  # with most = 2, sources with more keys are dealt
            rows, want = [(pick.choice(ids), pick.choice(ids)) for _ in range(n)], {}
            for a in set(rows):
                now = {a}
                for d in range(1, hops + 1):
                    for key, source in now:
                        want[key, source] = min(d, want.get((key, source), d))
                    now = {(k, y) for (k, x), (v, y) in itertools.product(now, set(rows)) if x is not None and x == v}
            out = policy.lineage_closure_ids(spark.createDataFrame(rows, "key long, source long"), hops, rows_per_task=most)
            assert (most == 2) == ("share" in out._jdf.queryExecution().analyzed().toString())
            assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((k, s, d)) for (k, s), d in want.items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_task_gets_all_columns_of_one_dataset(spark):
    rows = [(1, "it's", "a\\b"), (None, "NULL", None)]
    assert sorted(map(repr, map(tuple, facts.fixed(spark, rows, "n int, x string, y string").collect()))) == sorted(map(repr, rows))
    refs = spark.range(100).selectExpr("id as query_id", "'customers' as dataset", "'age_band' as field", "'RAW_VALUE' as kind")
    for out in (policy.resolve_context(refs, facts.small(spark, "catalog")), policy.effective(policy.resolve_context(refs, facts.small(spark, "catalog")), facts.small(spark, "lineage"), facts.small(spark, "catalog"))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() >= 100 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_fixed_point(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    f = spark.createDataFrame([("s", "p"), ("s", "q"), ("t", "p")], "scope string, fact string")
    rules = spark.createDataFrame([(1, "p", "r"), (1, "q", "r"), (2, "r", "x")], "rule_id int, premise string, conclusion string")
    out = {(r.scope, r.fact) for r in history.fixed_point(f, rules).collect()}
    assert out == {("s", "p"), ("s", "q"), ("s", "r"), ("s", "x"), ("t", "p")}


def test_missing_provenance_is_indeterminate(spark):
    o = spark.createDataFrame([("s", "f", None, 1), ("s", "g", "1", 2), ("s", "g", "2", 3), ("s", "h", "1", 4)], "scope string, family string, snapshot string, release_id long")
    assert {r.family: r.result for r in history.f5(o).collect()} == {"f": "INDETERMINATE", "g": "MATCHED"}


def test_conditional_aggregate_over_protected_data_blocks(spark):
    q = spark.createDataFrame([(1, True, 20, "orders.customer_id", "orders.customer_id", None)], "query_id long, is_grouped boolean, threshold int, threshold_subject string, subject string, upstream string")
    r = lambda kind: spark.createDataFrame([(1, "orders", "purchase_amount", kind), (1, "orders", "customer_id", "AGGREGATE_VALUE")], "query_id long, dataset string, field string, kind string")
    run = lambda kind: policy.decide(q, r(kind), facts.small(spark, "catalog"), facts.small(spark, "lineage")).first()
    assert run("CONDITIONAL_AGGREGATE").decision == "BLOCK"
    assert run("AGGREGATE_OPERAND").decision == "ALLOW"


@pytest.mark.parametrize(("rows", "kind"), [
    ([("o", "c", True, False, False, "none", False, 0)], "RAW_VALUE"), ([("o", "c", True, True, False, "none", False, 0)], "GROUP_KEY"), ([("o", None, False, False, False, "count", False, 0)], "NESTED_SCOPE"),
    ([("o", "c", False, False, False, "count", False, 0)], "AGGREGATE_VALUE"), ([("o", "c", False, False, False, "count", False, 0), ("o", "d", False, False, False, "other", False, 1)], "AGGREGATE_OPERAND"),
    ([("o", "c", False, False, True, "other", False, 0)], "CONDITIONAL_AGGREGATE"),
])
def test_exposure_precedence(spark, rows, kind):
    df = spark.createDataFrame([(1, *r) for r in rows], "query_id long, output_name string, src_field string, bare boolean, grouped boolean, is_filter boolean, agg string, nested boolean, position int")
    assert policy.classify_exposure(df).first().kind == kind


def test_receipts_that_repeat_in_a_batch(spark, tmp_path):
    from cordon.sources import sinks

    rows = [("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
    df = spark.createDataFrame(rows, "receipt_id string, content_sha256 string")
    assert sorted(tuple(r) for r in sinks.write_receipts(df, f"{tmp_path}/r").collect()) == [("b", "1"), ("b", "2")]
    again = spark.createDataFrame([("a", "1"), ("c", "9")], df.schema)
    assert [tuple(r) for r in sinks.write_receipts(again, f"{tmp_path}/r").collect()] == [("c", "9")]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [("a", "1"), ("c", "1")]


def test_direct_identifier_conditional_and_nested_block(spark):
    from cordon.operators import policy

    catalog = spark.createDataFrame([("p", "email", "DIRECT_IDENTIFIER"), ("p", "key", "STABLE_PSEUDONYM"), ("p", "ill", "SENSITIVE_ATTRIBUTE"), ("p", "age", "QUASI_IDENTIFIER")], "dataset string, field string, category string")
    lineage = spark.createDataFrame([], "dataset string, field string, src_dataset string, src_field string")
    refs = [(1, "email", "RAW_VALUE"), (1, "ill", "RAW_VALUE"), (2, "ill", "CONDITIONAL_AGGREGATE"), (3, "age", "NESTED_SCOPE"), (4, "key", "RAW_VALUE"), (4, "ill", "RAW_VALUE"), (5, "age", "RAW_VALUE")]
    refs = spark.createDataFrame([(q, "p", f, k) for q, f, k in refs], "query_id long, dataset string, field string, kind string")
    queries = spark.createDataFrame([(k, False, None, None, "p.key", None) for k in range(1, 6)], "query_id long, is_grouped boolean, threshold int, threshold_subject string, subject string, upstream string")
    got = {r.query_id: (r.decision, r.reasons) for r in policy.decide(queries, refs, catalog, lineage).collect()}
    risk = "COMPOSITIONAL_REIDENTIFICATION_RISK"
    assert got == {1: ("BLOCK", ["DIRECT_SENSITIVE_LINKAGE"]), 2: ("BLOCK", [risk]), 3: ("BLOCK", ["UNRESOLVED_COLUMN"]), 4: ("BLOCK", [risk]), 5: ("ALLOW", ["NO_COMPOSITIONAL_RISK"])}
    legacy = {r.query_id: r.decision for r in policy.decide(queries, refs, catalog, lineage, min_quasi=2).collect()}
    assert legacy[4] == "ALLOW" and legacy[1] == "BLOCK"


def test_secrets_in_normal_form(spark):
    texts = ["ｐass word~1", "pass%20word~1", "pass+word%7E1", "pass word~1", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = fx.scan_secrets(df, "text", spark.createDataFrame([(7, "pass word~1"), (8, ""), (9, "word~１")], "secret_id int, secret string"))
    assert {(r.id, r.secret_id, r.spelling) for r in out.collect()} == {(0, 7, "nfkc"), (0, 9, "nfkc"), (1, 9, "nfkc"), (2, 7, "percent"), (3, 7, "raw"), (3, 9, "nfkc")}
    assert fx.scan_secrets(df, "text", spark.createDataFrame([], "secret_id int, secret string")).count() == 0


@pytest.mark.parametrize("small_list", [fx.SMALL_LIST, 0])
def test_secrets_of_a_long_list_in_long_texts(spark, monkeypatch, small_list):
    import base64
    import random
    import unicodedata
    from urllib.parse import quote_plus

    monkeypatch.setattr(fx, "SMALL_LIST", small_list)  # 0: the list is shuffled
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abAB01 ~/é１\U0001f511") for _ in range(n))
    known = [(k, word(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 20, 60]))) for k in range(300)] + [(0, "ab~0"), (0, "AB 1")]
    known += [(k, "q" * 40 + str(k)) for k in range(300, 600)]
    parts = [x for s in draw.sample([s for _, s in known], 12) for x in (s, quote_plus(s, safe="*-._").replace("~", "%7E"), s.encode().hex(), base64.b64encode(s.encode()).decode())]
    texts = ["z" * 4090 + p + "y" * 4090 + "q" * 40 + "417" for p in parts] + [word(60) for _ in range(40)] + [None, "", "ab~0", "ab~0"]
    df = spark.createDataFrame([(k, t, {"a": 1}) for k, t in enumerate(texts)], "`a.id` int, `a.text` string, m map<string,int>")
    out = fx.scan_secrets(df, "a.text", spark.createDataFrame(known, "secret_id int, secret string"))
    expected = []
    for k, t in enumerate(texts):
        own = set()
        for i, s in known if t else []:
            forms = {"raw": s, "percent": quote_plus(s, safe="*-._").replace("~", "%7E"), "hex": s.encode().hex(), "base64": base64.b64encode(s.encode()).decode()}
            own |= {(k, i, n) for n, f in forms.items() if f in t}
        own |= {(k, i, "nfkc") for i, s in known if t and unicodedata.normalize("NFKC", s) in unicodedata.normalize("NFKC", t) and (k, i, "raw") not in own}
        expected += sorted(own)
    assert sorted((r[0], r.secret_id, r.spelling) for r in out.collect()) == sorted(expected) and len(expected) > 100


def test_a_short_list_of_secrets_is_searched_without_grams(spark, monkeypatch):
    s = "pass word~１"
    texts = [s, f"a{s}b", "pass+word%7E%EF%BC%91", s.encode().hex(), "pass word~1", "ｐass word~1", "none", "", None, s, "é"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    secrets = spark.createDataFrame([(7, s), (8, "é"), (8, "non"), (9, "")], "secret_id int, secret string")
    found = lambda: sorted((r.id, r.secret_id, r.spelling) for r in fx.scan_secrets(df, "text", secrets).collect())
    with monkeypatch.context() as m:
        m.setattr(fx, "_met", None)  # no gram is cut
        short = found()
    monkeypatch.setattr(fx, "SHORT_LIST", 0)
    assert short == found() and {r[2] for r in short} >= {"raw", "percent", "hex", "nfkc"}


def test_requests_refused_for_open_ones_count_for_the_rate(spark):
    s = 1_000_000
    rows = [(1, "p", 0, 5 * s), (2, "p", s, 2 * s), (3, "p", 2 * s, 3 * s), (4, "p", 3 * s, 4 * s), (5, "p", 10 * s, 11 * s), (6, "q", 0, 1), (7, "q", 1, 2)]
    df = spark.createDataFrame(rows, "id int, who string, ts_us long, end_us long")
    out = {r.id: (r.reason, r.retry_after_s) for r in folds.ordered_fold(df, "who", ["ts_us"], folds.traffic_fold(3, 10 * s, 1), folds.TRAFFIC_COLUMNS).collect()}
    assert out == {1: (None, None), 2: ("CONCURRENCY_LIMIT_EXCEEDED", 1), 3: ("CONCURRENCY_LIMIT_EXCEEDED", 1), 4: ("RATE_LIMIT_EXCEEDED", 7), 5: (None, None), 6: (None, None), 7: (None, None)}


def test_an_action_is_chosen_without_rows_of_pairs(spark):
    import random

    draw = random.Random(3)
    rows = [(q, f"a{draw.randrange(5)}", draw.randrange(3), draw.randrange(2), draw.randrange(2)) for q in range(40) for _ in range(draw.randrange(1, 8))] + [(99, "x", 0, 0, 0), (None, "x", 1, 0, 0), (None, "y", 0, 1, 0)]
    acts = spark.createDataFrame([*rows, *rows[:9]], "query_id long, action string, goal_cost int, info_cost int, change_cost int")
    got = ev.choose_action(acts, lambda c: c.goal_cost + c.info_cost >= 1)
    plan = got._jdf.queryExecution().executedPlan().toString()  # as it is before it runs
    assert "Join" not in plan and plan.count("Exchange ") == 1
    by_rows = ev.choose_repair(ev.candidates(acts.distinct()).withColumn("eligible", F.expr("goal_cost + info_cost >= 1")))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, by_rows.collect()), key=repr)


def test_a_failed_check_closes_the_repair(spark):
    rows = [("a", "x", 1, 1, 1, True, False), ("a", "y", 0, 1, 1, True, False), ("b", "x", 0, 0, 0, True, False), ("b", "y", 1, 1, 1, False, True), ("c", "x", 1, 1, 1, False, False), ("d", "x", 1, 1, 1, True, None)]
    df = spark.createDataFrame(rows, "query_id string, candidate string, goal_cost int, info_cost int, change_cost int, eligible boolean, failed boolean")
    assert {r.query_id: (r.repair, r.status) for r in ev.repair_status(df).collect()} == {"a": ("y", "REPAIR_FOUND"), "b": (None, "FAIL_CLOSED"), "c": (None, "NO_ELIGIBLE_REPAIR"), "d": (None, "FAIL_CLOSED")}


def test_lifecycle_of_moves_that_come_late(spark, tmp_path):
    from cordon.streaming.traffic import drain, lifecycle_stream

    schema = "record_id long, transition_id long, state string"
    files = [[(1, 2, "RELEASED"), (2, 1, "PENDING")], [(1, 1, "PENDING"), (3, 2, "PENDING"), (3, 1, "PENDING")], [(2, 3, "RELEASED"), (2, 2, "ABORTED")]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "moves"))
    like = spark.read.schema(schema).parquet(str(tmp_path / "moves"))
    out = drain(lifecycle_stream, like, str(tmp_path / "moves"), files_a_batch=1).collect()
    assert len(out) == 5
    assert {k: max((r.n_moves, r.state) for r in out if r.record_id == k)[1] for k in (1, 2, 3)} == {1: "RELEASED", 2: "INVALID", 3: "INVALID"}


def test_lifecycle_runs_no_python_by_record(spark):
    from cordon.streaming.traffic import lifecycle_stream

    moves = spark.createDataFrame([(1, 5, "PENDING"), (2, 1, "RELEASED"), (3, 2, "ABORTED"), (3, 1, "PENDING"), (4, 1, "PENDING"), (4, 2, None), (5, 1, None)], "record_id long, transition_id long, state string")
    out = lifecycle_stream(moves)
    assert {r.record_id: (r.n_moves, r.state) for r in out.collect()} == {1: (1, "PENDING"), 2: (1, "INVALID"), 3: (2, "ABORTED"), 4: (2, "INVALID"), 5: (1, "INVALID")}
    assert "Pandas" not in out._jdf.queryExecution().toString()


def test_chain_of_rows_that_come_late(spark, tmp_path):
    from cordon.streaming.traffic import chain_stream, drain

    s, schema = 1_000_000, "record_id long, scope long, ts_us long, payload string"
    files = [[(3, 1, 30 * s, "c"), (9, 2, 31 * s, "x")], [(1, 1, 10 * s, "a"), (2, 1, 10 * s, "b")], [(4, 1, 90 * s, "d"), (10, 2, 40 * s, "y")], [(99, 3, 900 * s, "end")]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    like = spark.read.schema(schema).parquet(str(tmp_path / "rows"))
    got = drain(lambda x: chain_stream(x, "60 seconds"), like, str(tmp_path / "rows"), files_a_batch=1)
    want = folds.ordered_fold(like.where("record_id < 99"), "scope", ["ts_us", "record_id"], folds.chain_fold("payload"), folds.CHAIN_COLUMNS)
    names = ["record_id", "sequence", "previous_sha256", "content_sha256"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


def test_long_chains_of_scopes_end_and_cycles_do_not(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    chain = [(1, k, f"o{k}", None, k + 1, f"o{k + 1}") for k in range(40)] + [(1, 40, "o40", "orders", None, "price")]
    cycle = [(2, 0, "out", None, 1, "v"), (2, 1, "v", None, 2, "v"), (2, 1, "v", None, 1, "v"), (2, 2, "v", None, 1, "v"), (3, 0, "a", "t", None, "x"), (3, 0, "b", None, 1, "none")]
    df = spark.createDataFrame(chain + cycle, "query_id int, scope_id int, output_name string, dataset string, src_scope int, src_column string")
    got = {tuple(r) for r in policy.resolve_derived(df, max_depth=48).collect()}
    assert got == {(1, "o0", "orders", "price"), (2, "out", "@unresolved", "v"), (3, "a", "t", "x"), (3, "b", "@unresolved", "none")}


def test_budget_of_releases_that_come_late(spark, tmp_path):
    from cordon.streaming.traffic import budget_stream, drain

    s, schema = 1_000_000, "record_id long, scope long, ts_us long, protected boolean"
    files = [[(3, 1, 30 * s, True), (4, 1, 31 * s, False)], [(1, 1, 10 * s, True), (2, 1, 20 * s, True), (7, 2, 35 * s, True)], [(5, 1, 115 * s, True), (6, 1, 116 * s, True)], [(99, 3, 900 * s, False)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    like = spark.read.schema(schema).parquet(str(tmp_path / "rows"))
    got = drain(lambda x: budget_stream(x, 2, 100, "60 seconds"), like, str(tmp_path / "rows"), files_a_batch=1).collect()
    want = folds.ordered_fold(like.where("record_id < 99"), "scope", ["ts_us", "record_id"], folds.budget_fold(2, 100 * s), folds.BUDGET_COLUMNS).collect()
    assert sorted((r.record_id, r.allowed, r.rule) for r in got) == sorted((r.record_id, r.allowed, r.rule) for r in want)
    assert {r.record_id for r in got if not r.allowed} == {3, 6}


def odd_plans(spark):
    """Queries with nulls in every column, one without columns, and columns of every category, unknown and foreign ones among them."""
    kinds = ["RAW_VALUE", "GROUP_KEY", "AGGREGATE_OPERAND", "AGGREGATE_VALUE", None, "CONDITIONAL_AGGREGATE", "NESTED_SCOPE", "TRANSFORMED_RAW_VALUE"]
    fields = [("people", f) for f in ("email", "person_id", "age", "zip", "diagnosis", "note", "score")] + [("visits", "zip"), ("people", "blob"), ("people", "lost"), ("gone", "x")]
    thresholds = [(None, None), (5, "people.person_id"), (30, "people.person_id"), (30, "people.email")]
    queries = [(n, [True, False, None][n % 3], *thresholds[n % 4], [None, "people.person_id", "people.person_id", "people.email"][n // 2 % 4], "NO_PARSE" if n % 37 == 0 else None) for n in range(240)]
    refs = [(n, *fields[(n * 7 + j * (1 + n % 3)) % (7 if n % 3 else len(fields))], kinds[(n // 5 + j * 3 * (n % 2)) % (5 if n % 4 else len(kinds))]) for n in range(1, 240) for j in range(1 + n % 4)]
    queries.append((500, True, None, None, "people.person_id", None))
    refs += [(500, "people", "person_id", "AGGREGATE_VALUE"), (500, "people", "diagnosis", "AGGREGATE_OPERAND"), (500, "people", "zip", "GROUP_KEY")]
    catalog = [("people", "email", "DIRECT_IDENTIFIER"), ("people", "person_id", "STABLE_PSEUDONYM"), ("people", "age", "QUASI_IDENTIFIER"), ("people", "zip", "QUASI_IDENTIFIER"), ("people", "diagnosis", "SENSITIVE_ATTRIBUTE"), ("people", "note", "PUBLIC_OR_LOW_RISK"), ("people", "score", "PUBLIC_OR_LOW_RISK"), ("people", "blob", "UNCLASSIFIED"), ("visits", "zip", "QUASI_IDENTIFIER")]
    return (
        spark.createDataFrame(queries, "query_id long, is_grouped boolean, threshold int, threshold_subject string, subject string, upstream string"), spark.createDataFrame(refs, "query_id long, dataset string, field string, kind string"),
        facts.fixed(spark, catalog, "dataset string, field string, category string"), facts.fixed(spark, [("people", "score", "people", "diagnosis"), ("people", "note", "people", "age")], "dataset string, field string, src_dataset string, src_field string"),
    )


def test_variants_are_judged_as_changed_queries_without_copies_of_columns(spark):
    q, r, c, lin = odd_plans(spark)
    n = F.col("query_id")
    releases = q.select(F.when(n % 11 > 0, n % 5).alias("scope"), n.alias("release_id"), "is_grouped", F.when(n % 3 == 0, "SUM").alias("aggregate"), F.when(n % 13 > 0, F.concat(F.lit("c"), (n % 4).cast("string"))).alias("cohort"), F.when(n % 7 > 0, F.concat(F.lit("y"), (n % 3).cast("string"))).alias("snapshot"))
    edges = facts.fixed(spark, [("y0", "y1"), ("y0", "y2"), ("y1", "y2")], "snapshot string, next_snapshot string")
    current = releases.where("scope % 2 = 0 and snapshot < 'y2'").select("scope", "snapshot").distinct()
    out = va.admissible_variants(q, r, c, lin, releases, edges, current)

    every = va.variants(releases, r.withColumnRenamed("query_id", "release_id"), c, edges).withColumn("variant", F.concat_ws(":", "kind", "target"))
    added = F.col("kind").startswith("ADD_")
    op = F.when(added, "ADD").when(F.col("kind").isin("REMOVE_PROJECTION", "DROP_GROUP_KEY"), "REMOVE").otherwise("KEEP")
    part = lambda k: F.when(op != "KEEP", F.split("target", r"\.")[k])
    kind = F.when(F.col("kind") == "ADD_PROJECTION", "RAW_VALUE").when(added, "GROUP_KEY")
    changed = policy.edit_refs(q, r, every.select(F.col("release_id").alias("query_id"), "variant", op.alias("op"), part(0).alias("dataset"), part(1).alias("field"), kind.alias("kind")))
    allowed = {x.query_id for x in policy.decide(*changed, c, lin).where("decision = 'ALLOW'").collect()}
    now = {(x.scope, x.snapshot) for x in current.collect()}
    at = {x.release_id: (x.scope, x.snapshot) for x in releases.collect()}
    want = [(x.release_id, x.kind, x.target) for x in every.collect() if f"{x.release_id}#{x.variant}" in allowed and (x.kind != "STEP_SNAPSHOT" or (at[x.release_id] in now and None not in at[x.release_id]))]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len({k for _, k, _ in want}) == 8
    # variants become rows after the last shuffle
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.count("Generate") == 1


def test_single_repairs_are_judged_as_changed_queries_without_copies_of_columns(spark):
    q, r, c, lin = odd_plans(spark)
    r = r.unionByName(r.where("query_id % 5 = 0"))  # a column may stand in a query more than once
    acts = repair.actions(q, r, c)
    fit = repair.applicable(acts, q, r).where("fault is null")
    q2, r2 = repair.apply_repairs(q, r, fit.drop("fault"))
    done = policy.decide(q2, r2, c, lin).withColumn("failed", F.arrays_overlap("reasons", F.array(*map(F.lit, repair.UNRESOLVED))))
    want = done.select(F.substring_index("query_id", "#", 1), "variant", "decision", F.col("decision") == "ALLOW", "failed").collect()
    judged = repair.evaluate_repairs(q, r, c, lin, acts)
    assert sorted(map(tuple, judged.collect())) == sorted(map(tuple, want)) and len({(x.decision, x.failed) for x in want}) == 4
    n = {x.query_id: x["count"] for x in r2.groupBy("query_id").count().collect()}
    sized = repair.sized_repairs(q, r, fit)
    assert sorted(map(repr, map(tuple, sized.collect()))) == sorted(repr((x.query_id, x.threshold, x.threshold_subject, n.get(x.query_id, 0))) for x in q2.collect())
    # columns are shuffled by their query alone, once for each table that is made of them
    for out in (judged, sized):
        assert "variant" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x)


def test_decisions_by_bits_are_those_of_the_policy(spark):
    q, r, c, lin = odd_plans(spark)
    got = repair.decide_by_bits(q, repair.column_bits(r, c, lin))
    want = {x.query_id: x.decision for x in policy.decide(q, r, c, lin).collect()}
    assert {x.query_id: x.decision for x in got.collect()} == want and set(want.values()) == {"ALLOW", "REWRITE", "BLOCK"}
