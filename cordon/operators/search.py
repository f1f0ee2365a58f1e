"""Bounded search over what scopes could be shown next: breadth first, all scopes at once, failing closed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNSAFE, CLEAR, CLOSED = "PROSPECTIVE_UNSAFE", "NO_COUNTEREXAMPLE_WITHIN_BOUND", "FAIL_CLOSED"
BUDGET, UNSURE = "STATE_BUDGET_EXHAUSTED", "INDETERMINATE_SECURITY_PREDICATE"
_NODE = ["owner", "scope", "path", "names", "atoms", "hashes", "snapshot", "pairs", "lost", "parent"]


def atom_hashes(atoms: Column, start: Column | None = None) -> Column:
    """Two 64-bit hashes of a set of strings; those of a larger set follow from them and its new members."""
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return F.aggregate(atoms, none if start is None else start, lambda h, x: F.struct(h.a.bitwiseXOR(F.xxhash64(x)).alias("a"), h.b.bitwiseXOR(F.xxhash64(x, F.lit(17))).alias("b")))


def _spread(df: DataFrame) -> DataFrame:
    """df, to be shuffled in joins: files of nodes are far smaller than their rows, so what looks small enough to broadcast would fill the driver."""
    return df.hint("merge")


def _keyed(nodes: DataFrame) -> DataFrame:
    """Adds key: what tells states of a scope apart, which is the set of atoms, the snapshot and the sensitive (release, snapshot) pairs."""
    parts = [F.hex("hashes.a"), F.hex("hashes.b"), F.size("atoms").cast("string"), F.coalesce("snapshot", F.lit("?")), F.concat_ws(",", "pairs"), F.col("lost").cast("string")]
    return nodes.withColumn("key", F.sha2(F.concat_ws("|", *parts), 256))


def two_snapshots(pairs: str = "pairs") -> Column:
    """Whether a family stands under two snapshots in pairs `family@snapshot` (F5)."""
    families = F.transform(pairs, lambda p: F.substring_index(p, "@", 1))
    return F.size(F.array_distinct(families)) < F.size(families)


def named(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in sorted(conditions.items()))), lambda x: x.isNotNull())


def search(states: DataFrame, actions: DataFrame, forbidden: Column, indeterminate: Column, keep: Callable[[DataFrame], DataFrame], depth: int = 3, max_states: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shortest forbidden state that every scope can reach by at most `depth` admissible actions.

    states: owner, scope, atoms (array), snapshot (null: not known), pairs (array of `family@snapshot`, the
    sensitive releases so far). actions: owner, ord (int, their order), action, atoms, family (of a sensitive
    release, else null), step (boolean: it moves from snapshot `at` to `to`, both may be null), admissible.
    forbidden, indeterminate: arrays of predicate names over atoms, pairs, snapshot and lost (a sensitive
    release was made under no known snapshot). A path is ordered by its length, then by its actions.

    :return: results (scope, status, reason, depth, path, predicates, n_states), steps (path, step, action,
        pre_state, post_state: the witness of each unsafe scope, from parent pointers) and levels (scope, depth, state).

    The first state in that order that is forbidden makes a scope unsafe; one that can't be judged, or more than
    `max_states` states, makes it fail closed. A state is entered once, by its first path. Each level is one
    join with the actions and one shuffle by scope, in which states meet those seen before, are counted and numbered; an action that
    changes nothing is left out before it. Scopes that have ended leave the frontier, so its size is bounded by `max_states` times the actions of each open scope.
    """
    now = states.select("owner", "scope", F.array().cast("array<int>").alias("path"), F.array().cast("array<string>").alias("names"), F.array_sort(F.array_distinct("atoms")).alias("atoms"), "snapshot", F.array_sort(F.array_distinct("pairs")).alias("pairs"))
    now = now.withColumns({"hashes": atom_hashes(F.col("atoms")), "lost": F.lit(False), "parent": F.lit(None).cast("string")})
    allowed = actions.where("admissible").select(F.col("owner").alias("whose"), "ord", "action", F.col("atoms").alias("new"), "family", "step", "at", "to")
    seen = None
    ended, levels = [], []
    each = Window.partitionBy("scope")
    for d in range(depth + 1):
        node = F.struct(*(c for c in _NODE if c != "scope"))
        new = _keyed(now).where("parent is null or key <> parent").select("scope", "key", "path", node.alias("n"), F.lit(False).alias("old"))
        if seen is not None:
            new = new.unionByName(seen.withColumn("old", F.lit(True)), allowMissingColumns=True)
        new = new.repartition("scope").groupBy("scope", "key").agg(F.min_by("n", "path").alias("n"), F.bool_or("old").alias("old"))
        new = new.withColumn("before", F.count_if("old").over(each)).where("not old").select("scope", "key", "n.*", "before")
        place = F.col("before") + F.row_number().over(each.orderBy("path"))
        judged = new.withColumn("place", place).withColumns({"bad": forbidden, "unsure": indeterminate})
        reason = F.when(F.col("place") > max_states, BUDGET).when(F.size("bad") > 0, UNSAFE).when(F.size("unsure") > 0, UNSURE)
        level = keep(judged.withColumn("event", reason).withColumn("open", F.count("event").over(each) == 0))
        levels.append(level.select("scope", "key", "parent", F.lit(d).alias("depth"), F.element_at("names", -1).alias("action") if d else F.lit("").alias("action"), "place"))
        first = level.where("event is not null").groupBy("scope").agg(F.min_by(F.struct("key", "event", "names", "bad", "unsure", "place"), "path").alias("e"))
        ended.append(keep(first.select("scope", "e.*", F.lit(d).alias("depth"))))
        seen = level.select("scope", "key") if seen is None else seen.unionByName(level.select("scope", "key"))
        open_ = level.where("open")
        if d == depth or open_.isEmpty():
            break
        fits = ~F.col("step") | F.col("at").eqNullSafe(F.col("snapshot"))
        child = open_.join(_spread(allowed), (F.col("owner") == F.col("whose")) & fits)
        fresh, known = F.array_except("new", "atoms"), F.col("family").isNotNull() & F.col("snapshot").isNotNull()
        now = child.select(
            "owner", "scope", F.concat("path", F.array("ord")).alias("path"), F.concat("names", F.array("action")).alias("names"), F.array_sort(F.concat("atoms", fresh)).alias("atoms"), atom_hashes(fresh, F.col("hashes")).alias("hashes"),
            F.when(F.col("step"), F.col("to")).otherwise(F.col("snapshot")).alias("snapshot"), F.when(known, F.array_sort(F.array_union("pairs", F.array(F.concat_ws("@", "family", "snapshot"))))).otherwise(F.col("pairs")).alias("pairs"),
            (F.col("lost") | (F.col("family").isNotNull() & F.col("snapshot").isNull())).alias("lost"), F.col("key").alias("parent"),
        )
    last = reduce(DataFrame.unionByName, ended)
    every = reduce(DataFrame.unionByName, levels)
    unsafe = F.col("event") == UNSAFE
    told = last.select(
        "scope", F.when(unsafe, UNSAFE).otherwise(CLOSED).alias("status"), F.when(~unsafe, F.col("event")).alias("reason"), "depth", F.concat_ws(">", "names").alias("path"),
        F.concat_ws(",", F.when(F.col("event") == BUDGET, F.array().cast("array<string>")).when(unsafe, F.col("bad")).otherwise(F.col("unsure"))).alias("predicates"), F.least(F.col("place"), F.lit(max_states)).cast("long").alias("n_states"),
    )
    none = F.lit(None).cast("string")
    clear = seen.groupBy("scope").agg(F.count("*").alias("n_states")).join(_spread(last.select("scope")), "scope", "left_anti").select("scope", F.lit(CLEAR).alias("status"), none.alias("reason"), F.lit(None).cast("int").alias("depth"), none.alias("path"), F.lit("").alias("predicates"), "n_states")
    return told.unionByName(clear), _witness(last.where(unsafe), levels), every.where(F.col("place") <= max_states).select("scope", "depth", F.col("key").alias("state"))


def _witness(last: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Steps back from the last state of each path to its first."""
    out, now = [], None
    for d in range(len(levels) - 1, 0, -1):
        own = last.where(F.col("depth") == d).select("scope", "key")
        now = own if now is None else now.unionByName(own)
        step = now.join(_spread(levels[d]), ["scope", "key"]).select(F.col("scope").alias("path"), F.lit(d).alias("step"), "action", F.col("parent").alias("pre_state"), F.col("key").alias("post_state"))
        out.append(step)
        now = step.select(F.col("path").alias("scope"), F.col("pre_state").alias("key"))
    empty = last.select(F.col("scope").alias("path"), F.lit(0).alias("step"), F.lit("").alias("action"), F.col("key").alias("pre_state"), F.col("key").alias("post_state")).where("false")
    return reduce(DataFrame.unionByName, out, empty)


def temporal_gate(releases: DataFrame, edges: DataFrame, keep: Callable[[DataFrame], DataFrame], depth: int = 3) -> DataFrame:
    """release_id, depth, predicate of releases that the policy allows by themselves, yet from which a forbidden state is reached
    when snapshots step on (edges: snapshot, next_snapshot) and the release is replayed.

    releases: release_id, sensitive, decision, snapshot. Found by `search`, from the state that the release leaves. What is allowed is
    decided once and kept.
    """
    own = keep(releases.where("sensitive and decision = 'ALLOW'").select("release_id", "snapshot")).withColumn("owner", F.col("release_id").cast("string"))
    family = F.concat(F.lit("release"), F.col("owner"))
    pair = F.when(F.col("snapshot").isNotNull(), F.array(F.concat_ws("@", family, "snapshot"))).otherwise(F.array().cast("array<string>"))
    states = own.select("owner", F.col("release_id").alias("scope"), F.array(family).alias("atoms"), "snapshot", pair.alias("pairs"))
    none, no_atoms = F.lit(None).cast("string"), F.array().cast("array<string>")
    replay = own.select("owner", F.lit(1).alias("ord"), F.lit("replay").alias("action"), F.array(family).alias("atoms"), family.alias("family"), F.lit(False).alias("step"), none.alias("at"), none.alias("to"))
    onward = keep(edges.select(F.col("snapshot").alias("at"), F.col("next_snapshot").alias("to")).distinct())  # of a known size, so that releases aren't shuffled by their few snapshots
    # the snapshots that paths of this length can step to
    reach = own.select("owner", F.col("snapshot").alias("now"))
    steps = []
    for _ in range(depth):
        reach = reach.join(onward, F.col("now") == F.col("at"))
        steps.append(reach.select("owner", "at", "to"))
        reach = reach.select("owner", F.col("to").alias("now")).distinct()
    step = reduce(DataFrame.unionByName, steps).distinct()
    step = step.select("owner", (F.lit(1) + F.dense_rank().over(Window.partitionBy("owner").orderBy("to"))).alias("ord"), F.concat(F.lit("step to "), "to").alias("action"), no_atoms.alias("atoms"), none.alias("family"), F.lit(True).alias("step"), "at", "to")
    results, _, _ = search(states, keep(replay.unionByName(step).withColumn("admissible", F.lit(True))), named(F5=two_snapshots()), named(F5=F.col("lost")), keep, depth)
    return results.where((F.col("status") == UNSAFE) & (F.col("depth") > 0)).select(F.col("scope").alias("release_id"), "depth", F.col("predicates").alias("predicate"))
