"""Bounded search against a plain breadth-first search, and stateful streams over several micro-batches and a restart."""

import itertools
import random
import uuid

import pytest
from pyspark.sql import functions as F

from cordon.operators import folds, history, search
from cordon.streaming import limits

ACTION = "owner string, ord int, action string, atoms array<string>, family string, step boolean, at string, to string, admissible boolean"
STATE = "owner string, scope string, atoms array<string>, snapshot string, pairs array<string>"


def keeper(spark, tmp_path):
    def keep(df):
        df.write.parquet(to := str(tmp_path / uuid.uuid4().hex))
        return spark.read.schema(df.schema).parquet(to)

    return keep


def brute(state, actions, depth, budget):
    """(status, reason, depth, path) of one scope; actions in order."""

    def judge(node):
        atoms, _, pairs, lost = node
        families = [p.split("@")[0] for p in pairs]
        bad = [n for n, c in (("F4", {"id", "s"} <= atoms), ("F5", len(set(families)) < len(families))) if c]
        return search.UNSAFE if bad else search.UNSURE if lost else None

    first = (frozenset(state[2]), state[3], frozenset(state[4]), False)
    level, seen = [(first, ())], {first}
    if (event := judge(first)) is not None:
        return (event, 0, "")
    for d in range(1, depth + 1):
        following = []
        for (atoms, snapshot, pairs, lost), path in level:
            for _, _, name, new, family, step, at, to, ok in actions:
                if not ok or (step and at != snapshot):
                    continue
                node = (atoms | set(new), to if step else snapshot, pairs | ({f"{family}@{snapshot}"} if family and snapshot else set()), lost or bool(family and snapshot is None))
                if node in seen:
                    continue
                seen.add(node)
                event = search.BUDGET if len(seen) > budget else judge(node)
                if event:
                    return (event, d, ">".join((*path, name)))
                following.append((node, (*path, name)))
        level = following
    return (None, None, None)


def test_search_equals_breadth_first(spark, tmp_path):
    rng = random.Random(3)
    states, actions = [], []
    for k in range(40):
        owner = f"o{k}"
        snaps = rng.choice([["d1"], ["d1", "d2"], ["d1", None], ["d1", "d2", None]])
        pool = [("a", None), ("b", None), ("id", None), ("s", "fam"), ("c", None)]
        own = [(owner, n, f"add {a}", [a], f, False, None, None, rng.random() < 0.8) for n, (a, f) in enumerate(rng.sample(pool, 4))]
        own += [(owner, 10 + n, f"step {n}", [], None, True, a, b, True) for n, (a, b) in enumerate(itertools.pairwise(snaps))]
        actions += own
        for j in range(3):
            atoms = rng.sample(["a", "b", "s", "x"], rng.randint(0, 3))
            states.append((owner, f"{owner}-{j}", atoms, "d1", ["fam@d1"] if "s" in atoms else []))
    # a sensitive release under a snapshot that nobody knows can't be judged
    actions += [("odd", 1, "add a", ["a"], None, False, None, None, True), ("odd", 2, "add s", ["s"], "fam", False, None, None, True), ("odd", 9, "step", [], None, True, "d1", None, True)]
    states += [("odd", "odd-1", ["x"], "d1", []), ("odd", "odd-2", ["s"], "d1", ["fam@d1"])]
    keep, both = keeper(spark, tmp_path), F.array_contains("atoms", "id") & F.array_contains("atoms", "s")
    for depth, budget in ((3, 1000), (3, 9), (0, 5), (1, 2)):
        got, steps, levels = search.search(spark.createDataFrame(states, STATE), spark.createDataFrame(actions, ACTION), search.named(F4=both, F5=search.two_snapshots()), search.named(F5=F.col("lost")), keep, depth, budget)
        rows = {r.scope: r for r in got.collect()}
        assert len(rows) == len(states)
        kinds = set()
        for s in states:
            event, at, path = brute(s, [a for a in actions if a[0] == s[0]], depth, budget)
            r = rows[s[1]]
            assert (r.status, r.reason, r.depth, r.path) == ((search.CLEAR if event is None else search.UNSAFE if event == search.UNSAFE else search.CLOSED), None if event in (None, search.UNSAFE) else event, at, path)
            kinds.add(event)
        assert depth < 3 or len(kinds) >= (3 if budget > 10 else 2)
        # a witness has a step a level, and each starts where the one before ended
        assert history.verify_paths(steps).count() == 0
        assert {r.path: r.n for r in steps.groupBy("path").agg(F.count("*").alias("n")).collect()} == {k: r.depth for k, r in rows.items() if r.status == search.UNSAFE and r.depth}
        assert levels.groupBy("scope").count().where(F.col("count") > budget).count() == 0


def test_set_hash_is_incremental(spark):
    row = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    one = search.atom_hashes(F.col("x"))
    two = search.atom_hashes(F.array(F.lit("b")), search.atom_hashes(F.array(F.lit("c"), F.lit("a"))))
    assert row.select((one == two).alias("same")).first().same


def test_temporal_gate_is_found_by_search(spark, tmp_path):
    rel = spark.createDataFrame([(1, True, "ALLOW", "y1"), (2, True, "ALLOW", "y3"), (3, False, "ALLOW", "y1"), (4, True, "BLOCK", "y1")], "release_id long, sensitive boolean, decision string, snapshot string")
    edges = spark.createDataFrame([("y1", "y2"), ("y2", "y3")], "snapshot string, next_snapshot string")
    got = search.temporal_gate(rel, edges, keeper(spark, tmp_path)).collect()
    assert [(r.release_id, r.depth, r.predicate) for r in got] == [(1, 2, "F5")]
    assert search.temporal_gate(rel, edges, keeper(spark, tmp_path), depth=1).count() == 0


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, transform, schema, folder, base):
    """One start of a stream over the files that are there; a later call goes on from its checkpoint."""
    out = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet"))
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    state = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
    return spark.read.schema(out.schema).parquet(f"{base}/out"), state


def test_rate_stream_over_batches_and_a_restart(spark, tmp_path):
    schema = "record_id long, scope long, ts_us long"
    rng = random.Random(5)
    rows = sorted(((k, k % 7, (1000 + rng.randrange(200)) * 1_000_000) for k in range(300)), key=lambda r: r[2])
    late = (999, 1, 1_005_000_000)  # comes when the watermark is past it
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    # inside a file rows stand in any order
    parts = [rng.sample(p, len(p)) for p in (rows[:100], rows[100:200], [*rows[200:], late])]
    run = lambda s: limits.rate_stream(s, 3, 20, "10 seconds")
    for p in parts[:2]:
        feed(spark, folder, p, schema)
    drained(spark, run, schema, folder, base)
    feed(spark, folder, parts[2], schema)
    feed(spark, folder, [(-1, -1, 10**10)], schema)
    out, state = drained(spark, run, schema, folder, base)
    batch = folds.ordered_fold(spark.createDataFrame(rows, schema), "scope", ["ts_us", "record_id"], folds.rate_fold(3, 20_000_000), folds.RATE_COLUMNS)
    pick = lambda df: {r.record_id: (r.admitted, None if r.retry_after_s is None or r.retry_after_s != r.retry_after_s else int(r.retry_after_s)) for r in df.where("scope >= 0").collect()}
    expected = pick(batch)
    assert pick(out) == expected and len({a for a, _ in expected.values()}) == 2
    assert state[-1] < max(state) and state[-1] <= 3  # idle scopes have left the store


def test_limit_streams_keep_groups_of_scopes_together(spark, tmp_path):
    schema = "record_id long, scope long, ts_us long"
    big = 2**53 + 1  # no double
    rows = [(k, None if k % 40 == 7 else big + k % 40, (1000 + k // 50) * 1_000_000) for k in range(600)]
    folder = str(tmp_path / "in")
    for part in (rows[:300], rows[300:], [(-1, -1, 10**10)]):
        feed(spark, folder, part, schema)
    out, state = drained(spark, lambda s: limits.rate_stream(s, 3, 4, "1 second", parts=2), schema, folder, str(tmp_path / "run"))
    batch = folds.ordered_fold(spark.createDataFrame(rows, schema), "scope", ["ts_us", "record_id"], folds.rate_fold(3, 4_000_000), folds.RATE_COLUMNS)
    pick = lambda df: sorted((r.record_id, r.scope, r.admitted) for r in df.where("record_id >= 0").collect())
    assert repr(pick(out)) == repr(pick(batch)) and len({r[2] for r in pick(out)}) == 2
    assert max(state) <= 2 * 8  # two lists and a few timers a group, not a scope


def test_parts_of_a_stream_have_equally_many_files(spark):
    import glob
    import os

    from cordon import queries as own

    t = own.Tables(spark, "/root/testdata/sf0.001")
    path, files = own._in_batches(t, rows_per_file=50)
    there = sorted(glob.glob(path.removeprefix("file:")), key=os.path.getmtime)
    assert files > 1 and len(there) == 3 * files + 1
    ends = [spark.read.parquet(*there[k : k + files]).selectExpr("min(ts)", "max(ts)", "count(*)").first() for k in range(0, len(there), files)]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and sum(e[2] for e in ends) == t.events.count() + 1


def test_capability_stream_tells_of_unused_ones(spark, tmp_path):
    schema = "record_id long, capability long, ts_us long, issue boolean"
    s = 1_000_000
    folder = str(tmp_path / "in")
    feed(spark, folder, [(1, 1, 1 * s, True), (2, 2, 1 * s, True), (3, 3, 1 * s, True), (4, 1, 3 * s, False), (5, 9, 2 * s, False)], schema)
    feed(spark, folder, [(6, 1, 30 * s, False), (7, 3, 31 * s, False)], schema)
    feed(spark, folder, [(8, 3, 40 * s, False), (9, -1, 10_000 * s, True)], schema)
    out, _ = drained(spark, lambda x: limits.capability_stream(x, 5, "1 second"), schema, folder, str(tmp_path / "run"))
    got = sorted(((r.capability, r.record_id, r.status) for r in out.where("capability >= 0").collect()), key=repr)
    assert got == sorted([(1, 4, "OK"), (1, 6, "REPLAY"), (2, None, "EXPIRED_UNUSED"), (3, None, "EXPIRED_UNUSED"), (3, 7, "EXPIRED"), (3, 8, "REPLAY"), (9, 5, "UNKNOWN")], key=repr)


def test_repairs_by_pairs_fail_closed_and_bounded(spark):
    from cordon.operators import policy, repair

    catalog = spark.createDataFrame([("p", "id", "STABLE_PSEUDONYM"), ("p", "mail", "DIRECT_IDENTIFIER"), ("p", "ill", "SENSITIVE_ATTRIBUTE"), ("p", "age", "QUASI_IDENTIFIER")], "dataset string, field string, category string")
    lineage = spark.createDataFrame([], "dataset string, field string, src_dataset string, src_field string")
    # 1: both identifiers and a sensitive column, so that no single drop but that of `ill` helps; 2: the same of a lost history; 3: safe; 4: safe alone, but 3 was released before to the same principal; 5: no columns
    queries = spark.createDataFrame([(q, p, q, False, None, None, "p.id", None) for q, p in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 1))], "query_id long, principal long, ts long, is_grouped boolean, threshold int, threshold_subject string, subject string, upstream string")
    shown = [(1, "id"), (1, "mail"), (1, "ill"), (2, "id"), (2, "mail"), (2, "ill"), (3, "ill"), (3, "age"), (4, "mail"), (4, "age")]
    refs = spark.createDataFrame([(q, "p", f, "RAW_VALUE") for q, f in shown], "query_id long, dataset string, field string, kind string")
    bits = repair.column_bits(refs, catalog, lineage)
    before = repair.exposures_before(queries, bits, policy.decide(queries, refs, catalog, lineage), spark.createDataFrame([(2,)], "principal long"))
    costs = spark.createDataFrame(repair.COSTS, "action string, goal_cost int, info_cost int, change_cost int")
    acts = repair.applicable(repair.actions(queries, refs, catalog), queries, refs)
    done = repair.validate_candidates(queries, bits, acts, before, costs)
    chosen = {r.query_id: (r.status, r.repair, r.n_candidates) for r in repair.choose_candidate(done).collect()}
    # five actions (three drops, one count, one threshold that is not for ungrouped queries) give 15 candidates; counting `ill` is cheaper than dropping it
    assert chosen == {1: ("REPAIR_FOUND", "COUNT_OUTPUT:p.ill", 15), 2: ("FAIL_CLOSED", None, 15), 4: ("REPAIR_FOUND", "DROP_OUTPUT:p.mail", 3)}
    stages = {(r.query_id, r.candidate): r.failure_stage for r in done.collect()}
    assert stages[1, "DROP_OUTPUT:p.id"] == stages[1, "DROP_OUTPUT:p.mail"] == "LOCAL_POLICY" and stages[1, "DROP_OUTPUT:p.id+DROP_OUTPUT:p.mail"] is None
    assert stages[1, "COUNT_OUTPUT:p.ill+DROP_OUTPUT:p.ill"] == stages[4, "RAISE_THRESHOLD"] == "GENERATE"
    few = {r.query_id: (r.status, r.n_candidates) for r in repair.choose_candidate(repair.validate_candidates(queries, bits, acts, before, costs, max_actions=4)).collect()}
    assert few == {1: ("FAIL_CLOSED", 0), 2: ("FAIL_CLOSED", 0), 4: ("REPAIR_FOUND", 3)}
    none = {r.query_id: (r.status, r.n_candidates) for r in repair.choose_candidate(repair.validate_candidates(queries, bits, acts.where("false"), before, costs)).collect()}
    assert none == {1: ("NO_ELIGIBLE_REPAIR", 0), 2: ("NO_ELIGIBLE_REPAIR", 0), 4: ("NO_ELIGIBLE_REPAIR", 0)}


@pytest.mark.parametrize("order", ["events first", "snapshots first", "mixed"])
def test_snapshots_and_events_meet_in_any_order(spark, tmp_path, order):
    from cordon.streaming.traffic import asof_streams, drain

    rng = random.Random(8)
    events = [("e", k, rng.randrange(6), rng.randrange(3600 * 40)) for k in range(150)]
    snaps = [("s", k, rng.randrange(6), rng.randrange(3600 * 40)) for k in range(1000, 1040)]
    # an event at the very time of a snapshot, at its end, and one without a key
    events += [("e", 900, snaps[0][2], snaps[0][3]), ("e", 901, snaps[0][2], snaps[0][3] + 6 * 3600), ("e", 902, None, 50)]
    files = {"events first": [events, snaps], "snapshots first": [snaps, events], "mixed": [events[::2] + snaps[1::2], snaps[::2] + events[1::2]]}[order]
    far = 3600 * 24 * 400
    files += [[("e", -1, -1, far), ("s", -2, -1, far)], [("e", -3, -1, 2 * far), ("s", -4, -1, 2 * far)]]
    schema = "kind string, id long, key long, at long"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def both(x):
        ts = F.timestamp_seconds("at")
        e = x.where("kind = 'e'").select(F.col("id").alias("event_id"), "key", ts.alias("ts"))
        s = x.where("kind = 's'").select("key", ts.alias("observed_at"), (ts + F.expr("INTERVAL 6 HOURS")).alias("expires_at"), F.col("id").alias("snapshot_id"))
        return asof_streams(e, s, "8 HOURS", "48 hours")

    out = drain(both, spark.createDataFrame([], schema), str(tmp_path / "in" / "*.parquet"), files_a_batch=1)
    got = sorted((r.event_id, r.snapshot_id, r.fresh) for r in out.where("event_id >= 0").collect())
    expected = []
    for _, k, key, at in events:
        held = [(t, i) for _, i, own, t in snaps if own == key and at - 8 * 3600 <= t <= at]
        newest = max(held, default=(None, None))
        expected.append((k, newest[1], bool(held) and at < newest[0] + 6 * 3600))
    assert got == sorted(expected) and any(f for *_, f in got) and any(i and not f for _, i, f in got) and any(i is None for _, i, _ in got)


def test_search_sends_no_table_of_nodes_through_the_driver(spark, tmp_path):
    states = spark.createDataFrame([("o", f"o-{k}", ["a"], "d1", []) for k in range(5)], STATE)
    actions = spark.createDataFrame([("o", 1, "add id", ["id"], None, False, None, None, True), ("o", 2, "add s", ["s"], "fam", False, None, None, True)], ACTION)
    both = F.array_contains("atoms", "id") & F.array_contains("atoms", "s")
    keep = keeper(spark, tmp_path)
    got, steps, _ = search.search(keep(states), keep(actions), search.named(F4=both), search.named(F5=F.col("lost")), keep)
    assert {(r.status, r.depth, r.path) for r in got.collect()} == {(search.UNSAFE, 2, "add id>add s")} and steps.count() == 10
    assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in (got, steps))


def test_a_level_meets_the_states_seen_in_one_shuffle_and_releases_are_decided_once(spark, tmp_path):
    plans, inner = [], keeper(spark, tmp_path)

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return inner(df)

    rel = spark.createDataFrame([(1, True, "ALLOW", "y1"), (2, True, "ALLOW", "y3")], "release_id long, sensitive boolean, decision string, snapshot string")
    edges = spark.createDataFrame([("y1", "y2"), ("y2", "y3")], "snapshot string, next_snapshot string")
    assert [tuple(r) for r in search.temporal_gate(rel, edges, keep, depth=2).collect()] == [(1, 2, "F5")]
    assert not any("LeftAnti" in p for p in plans)
    assert not any("LogicalRDD" in p for p in plans[2:])  # what is given is read for the first two tables alone
