"""Running values and ordered folds over keys cut into buckets, against plain windows, plain folds and brute force."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cordon.operators import folds, history, ledger, policy, scan

SCHEMA = "id long, key string, at long, v long, tag string"


def rows(n, seed, moments=400):
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "hot", "warm", "a", "b", None]), r.choice([None, *range(moments)]) if i % 40 == 0 else r.randrange(moments), r.choice([None, 1, 2, 3]), r.choice([None, "x", "y"])) for i in range(n)]


def values():
    return {"n": ("sum", F.col("v")), "top": ("max", F.col("v")), "tag_before": ("last", F.col("tag"))}


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("rows_per_task", [7, 60, 10_000])
def test_scan_equals_a_window_by_key(spark, inclusive, rows_per_task):
    df = spark.createDataFrame(rows(900, 1), SCHEMA)
    b = scan.cut(df, "key", "at", rows_per_task)
    assert (b.bucket is None) == (rows_per_task == 10_000)
    got = scan.scan(b, ["at", "id"], values(), inclusive).done()
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("n"), F.max("v").over(w).alias("top"), F.last("tag", True).over(w).alias("tag_before"))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_peers_left_out(spark):
    df = spark.createDataFrame(rows(900, 2, moments=60), SCHEMA).where("at is not null")
    got = scan.scan(scan.cut(df, "key", "at", 20), ["at"], {"n": ("sum", F.lit(1).cast("long"))}, peers=False).done()
    by = {}
    for r in df.collect():
        by.setdefault(r.key, []).append(r.at)
    assert all(r.n == sum(x < r["at"] for x in by[r.key]) for r in got.collect())


def test_a_hot_key_is_in_many_buckets_of_bounded_size(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "other", i, 1, "x") for i in range(6000)], SCHEMA)
    b = scan.cut(df, "key", "at", 100)
    sizes = [r["count"] for r in b.df.groupBy("key", b.bucket).count().where("key = 'hot'").collect()]
    assert len(sizes) >= 36 and max(sizes) <= 150 and sum(sizes) == 4000
    # a bucket is a contiguous stretch of its key
    spans = sorted((r.lo, r.hi) for r in b.df.where("key = 'hot'").groupBy(b.bucket).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    # no window by key alone is left in the plan
    plan = scan.scan(b, ["at"], {"n": ("sum", F.col("v"))}).done()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(key#\d+L?, \d+\)", plan) and re.search(rf"hashpartitioning\(key#\d+, {b.bucket}#\d+", plan)


def test_few_cuts_where_there_are_very_many_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(scan, "MAX_PARTS", 5)
    df = spark.createDataFrame(rows(900, 3), SCHEMA)
    b = scan.cut(df, "key", "at", 2)
    assert b.df.where("key = 'hot'").select(b.bucket).distinct().count() <= 5
    got = scan.scan(b, ["at", "id"], {"n": ("sum", F.lit(1).cast("long"))}, inclusive=True).done()
    assert {r.key: r.n for r in got.groupBy("key").agg(F.max("n").alias("n")).collect()} == {r.key: r["count"] for r in df.groupBy("key").count().collect()}


def test_empty_tables_one_moment_and_clashing_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scan.scan(scan.cut(none, "key", "at", 1), ["at", "id"], values()).done().count() == 0
    same = spark.createDataFrame([(i, "k", 5, 1, "x", i, i, i, i, i) for i in range(50)], SCHEMA + ", _n long, _bucket long, _key long, _at long, _c0 long")
    got = scan.scan(scan.cut(same, "key", "at", 4), ["at", "id"], {"n": ("sum", F.col("v"))}).done()
    assert got.columns == [*same.columns, "n"] and all(r.n == r.id == r._key == r._at for r in got.collect())


@pytest.mark.parametrize("limit,window", [(1, 3), (2, 8), (4, 25)])
def test_folds_cut_at_resets_decide_as_whole_folds(spark, limit, window):
    df = spark.createDataFrame(rows(900, 4, moments=1500), SCHEMA).where("at is not null").withColumn("protected", F.coalesce(F.col("v") > 1, F.lit(False))).withColumn("end", F.col("at") + F.col("id") % 9)
    busy = F.when(F.col("protected"), F.col("at") + window)
    number = scan.segments(df, "key", ["at", "id"], busy, 50)
    assert number[1] is not None and number[0].where("key = 'hot'").select(number[1]).distinct().count() > 3
    for make, added, until in [
        (folds.budget_fold(limit, window, ts="at"), folds.BUDGET_COLUMNS, busy),
        (folds.rate_fold(limit, window, ts="at"), folds.RATE_COLUMNS, F.col("at") + window),
        (folds.rate_fold(limit, window, ts="at", counted="protected"), folds.RATE_COLUMNS, busy),
        (folds.traffic_fold(limit, window, 1, ts="at", end="end"), folds.TRAFFIC_COLUMNS, F.greatest(F.col("at") + window, "end")),
    ]:
        whole = folds.ordered_fold(df, "key", ["at", "id"], make, added)
        parts = folds.ordered_fold(df, "key", ["at", "id"], make, added, until, 50)
        assert parts.columns == whole.columns
        assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))


def test_the_report_names_stretches_that_cant_be_cut(spark):
    dense, sparse = [(i, "dense", i, 1, "x") for i in range(200)], [(i, "sparse", 10 * i, 1, "x") for i in range(200)]
    df = spark.createDataFrame(dense + sparse + [(1, "small", 1, 1, "x")], SCHEMA)
    got = {r.key: (r.n_rows, r.n_segments, r.largest) for r in scan.segment_report(df, "key", ["at", "id"], F.col("at") + 5, 100).collect()}
    assert got == {"dense": (200, 1, 200), "sparse": (200, 200, 1)}
    assert scan.segment_report(df, "key", ["at", "id"], F.col("at") + 5, 1000).count() == 0


def test_legacy_blocks_across_buckets(spark):
    df = spark.createDataFrame(rows(600, 5, moments=5000), SCHEMA).where("at is not null and key is not null").select("id", "key", F.timestamp_seconds("at").alias("ts"), F.lit(True).alias("protected"), (F.col("id") % 150 == 0).alias("old"))
    args = dict(key="key", tie="id", legacy="old")
    parts, whole = (ledger.replay_budget(df, 2, 60, rows_per_task=n, **args).collect() for n in (30, 10_000))
    assert sorted(parts) == sorted(whole) and any(r.rule == "LEGACY_HISTORY_BLOCK" for r in parts)


def test_prior_counts_and_snapshots_of_a_hot_scope(spark):
    r = random.Random(6)
    data = [(i, "s", r.randrange(3000), r.random() < 0.6) for i in range(500)]
    df = spark.createDataFrame(data, "record_id long, scope string, sec long, protected boolean").withColumn("ts", F.timestamp_seconds("sec"))
    want = {i: sum(p and t - 200 < u < t for _, _, u, p in data) for i, _, t, _ in data}
    for n in (20, 10_000):
        got = ledger.prior_count(df, 200, rows_per_task=n)
        assert got.columns == [*df.columns, "prior_count"] and {x.record_id: x.prior_count for x in got.collect()} == want
    snaps = df.where("protected").select(F.col("scope").alias("key"), F.col("ts").alias("observed_at"), F.timestamp_seconds(F.col("sec") + 7).alias("expires_at"), F.concat(F.lit("s"), "sec").alias("snapshot_id")).distinct()
    events = df.where("not protected").select(F.col("scope").alias("key"), F.col("record_id").alias("event_id"), "ts")
    assert sorted(policy.asof_snapshot(events, snaps, 20).collect()) == sorted(policy.asof_snapshot(events, snaps).collect())


def test_closure_reads_only_scopes_that_moved(spark):
    # one scope walks a chain of ten rules, a thousand end after the first
    facts = spark.createDataFrame([("long", "f0")] + [(f"s{i}", f) for i in range(1000) for f in ("p", "q")], "scope string, fact string")
    rules = spark.createDataFrame([(i, f"f{i}", f"f{i + 1}") for i in range(10)] + [(50, "p", "r"), (50, "q", "r"), (51, "r", "z"), (51, "never", "z")], "rule_id int, premise string, conclusion string")
    report = []
    out = history.fixed_point(facts, rules, report=report)
    assert out.count() == 1 + 10 + 3000 and out.distinct().count() == out.count()
    assert [r["new"] for r in report] == [1001, *[1] * 9, 0]
    assert report[0]["delta"] == 2001 and all(r["delta"] == 1 and r["met"] <= 2 and r["derived"] <= 11 for r in report[2:])


def test_closure_equals_brute_force(spark):
    r = random.Random(7)
    names = [f"a{i}" for i in range(12)]
    rules = [(i, p, c) for i in range(14) for c in [r.choice(names)] for p in r.sample(names, r.choice([1, 2, 2, 3]))]
    facts = [(f"s{s}", f) for s in range(25) for f in r.sample(names, 3)]
    want = set()
    for s in {x for x, _ in facts}:
        have = {f for x, f in facts if x == s}
        while new := {c for i, _, c in rules if all(p in have for j, p, _ in rules if j == i)} - have:
            have |= new
        want |= {(s, f) for f in have}
    got = history.fixed_point(spark.createDataFrame(facts + facts[:5], "scope string, fact string"), spark.createDataFrame(rules + rules[:3], "rule_id int, premise string, conclusion string")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert history.fixed_point(spark.createDataFrame([], "scope string, fact string"), spark.createDataFrame(rules, "rule_id int, premise string, conclusion string")).count() == 0


@pytest.mark.parametrize("name", ["g16_verify_chain_hot", "g16_verify_chain"])
def test_a_chain_is_made_once_to_be_verified(spark, monkeypatch, name):
    from cordon import hot_queries, queries

    made, real = spark.sparkContext.accumulator(0), ledger.chain

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def chain(*args):
        df = real(*args)
        return df.mapInArrow(counted, df.schema)

    monkeypatch.setattr(ledger, "chain", chain)
    assert hot_queries.ledger is ledger
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES[name](spark, sf).count() > 0
    assert made.value == spark.read.parquet(f"{sf}/events.parquet").count()


def test_a_fold_gets_the_columns_it_reads(spark):
    df = spark.createDataFrame([(1, k, "x") for k in range(5)], "scope long, n long, other string")
    make = lambda: lambda row: {"seen": ",".join(row)}
    assert {(r.seen, r.other) for r in folds.ordered_fold(df, "scope", ["n"], make, "seen string", reads=["n"]).collect()} == {("n", "x")}
    assert {r.seen for r in folds.ordered_fold(df, "scope", ["n"], make, "seen string").collect()} == {"scope,n,other"}
