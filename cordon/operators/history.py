"""Release-history reasoning: atoms, closure, forbidden combinations, for all scopes at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keeper

IDENTIFIERS = ["DIRECT_IDENTIFIER", "STABLE_PSEUDONYM"]


def atoms(releases: DataFrame) -> DataFrame:
    """scope, release_id, atom_kind, a, b: one row for each thing a release shows; equal atoms once.

    releases: scope, release_id, family, cohort, snapshot, is_grouped, threshold, columns array of (key, category, kind).
    """
    col = releases.select("scope", "release_id", F.explode("columns").alias("c")).select("scope", "release_id", F.concat(F.lit("COLUMN_"), F.coalesce("c.kind", F.lit("REFERENCE"))).alias("atom_kind"), F.col("c.key").alias("a"), F.col("c.category").alias("b"))
    one = lambda kind, a, b=F.lit(None).cast("string"): releases.select("scope", "release_id", F.lit(kind).alias("atom_kind"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    parts = [col, one("FAMILY", F.col("family")), one("COHORT", F.col("cohort"), F.col("family")), one("SNAPSHOT", F.col("snapshot"), F.col("family")), one("THRESHOLD", F.col("threshold")).where("a is not null"), releases.where("is_grouped").select("scope", "release_id", F.lit("GROUPED").alias("atom_kind"), F.lit("yes").alias("a"), F.lit(None).cast("string").alias("b"))]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def category_presence(a: DataFrame) -> DataFrame:
    return a.where("atom_kind like 'COLUMN_%' and b is not null").select("scope", F.col("b").alias("category")).distinct()


def coexposure(a: DataFrame) -> DataFrame:
    """Scopes that have shown an identifier and a sensitive attribute, with the smallest release of each."""
    per = a.groupBy("scope").agg(F.min(F.when(F.col("b").isin(IDENTIFIERS), F.col("release_id"))).alias("identifier_release"), F.min(F.when(F.col("b") == "SENSITIVE_ATTRIBUTE", F.col("release_id"))).alias("sensitive_release"))
    return per.where("identifier_release is not null and sensitive_release is not null")


def cohort_variation(a: DataFrame) -> DataFrame:
    """Families that a scope has released for two cohorts or more."""
    return a.where("atom_kind = 'COHORT'").groupBy("scope", F.col("b").alias("family")).agg(F.count_distinct("a").alias("n_cohorts")).where("n_cohorts >= 2")


def fixed_point(facts: DataFrame, rules: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int | None = None, report: list[dict] | None = None) -> DataFrame:
    """Least fixed point of Horn rules. facts: scope, fact. rules: rule_id, premise, conclusion (a row a premise).

    Each round joins only the facts of the round before with the premises and adds to how many premises of a rule a scope has
    met. Between rounds go these counts of rules not yet met and the facts that rules can conclude, and those only of
    scopes that gained a fact: a scope without one is done, and no later round reads it. A repeated fact or premise counts once;
    null scopes and facts meet no premise. checkpoint writes a table (default: to the shared folder). max_rounds defaults to the number of
    conclusions and one, which no closure exceeds. report takes a dict of the rows of each round (it counts them).
    """
    keep = checkpoint or keeper(facts.sparkSession)
    rules = rules.select("rule_id", "premise", "conclusion").distinct()
    needed = rules.groupBy("rule_id", "conclusion").agg(F.count("*").alias("needed"))
    premises = rules.join(needed, ["rule_id", "conclusion"]).withColumnRenamed("premise", "fact")
    heads = rules.select(F.col("conclusion").alias("fact")).distinct()
    delta = keep(facts.select("scope", "fact").distinct())
    found, met = [delta], None
    derived = delta.join(heads, "fact", "left_semi").select("scope", "fact")
    for n in range(1, (max_rounds or heads.count() + 1) + 1):
        counts = delta.join(premises, "fact").groupBy("scope", "rule_id", "conclusion", "needed").agg(F.count("*").alias("n"))
        if met is not None:
            moved = delta.select("scope").distinct()
            met, derived = met.join(moved, "scope", "left_semi"), keep(derived.join(moved, "scope", "left_semi"))
            counts = counts.unionByName(met).groupBy("scope", "rule_id", "conclusion", "needed").agg(F.sum("n").alias("n"))
        counts = keep(counts)
        new = keep(counts.where("n = needed").select("scope", F.col("conclusion").alias("fact")).distinct().join(derived, ["scope", "fact"], "left_anti"))
        if report is not None:
            report.append({"round": n, "delta": delta.count(), "met": counts.count(), "derived": derived.count(), "new": new.count()})
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(new)
        delta, met, derived = new, counts.where("n < needed"), derived.unionByName(new)
    raise RuntimeError("the rules did not reach a fixed point")


def state_sha(a: DataFrame) -> DataFrame:
    """Digest of each scope's set of atoms, without regard to order."""
    one = F.sha2(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("atom_kind", "a", "b"))), 256)
    return a.select("scope", one.alias("s")).distinct().groupBy("scope").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("s"))), 256).alias("state_sha256"), F.count("*").alias("n_atoms"))


def f1_f2(a: DataFrame) -> DataFrame:
    """A direct (F1) or stable (F2) identifier shown with a sensitive attribute in one release: the smallest such release of each scope."""
    shown = a.where("atom_kind in ('COLUMN_RAW_VALUE', 'COLUMN_GROUP_KEY', 'COLUMN_TRANSFORMED_RAW_VALUE', 'COLUMN_AGGREGATE_OPERAND')")
    per = shown.groupBy("scope", "release_id").agg(F.bool_or(F.col("b") == "DIRECT_IDENTIFIER").alias("d"), F.bool_or(F.col("b") == "STABLE_PSEUDONYM").alias("p"), F.bool_or(F.col("b") == "SENSITIVE_ATTRIBUTE").alias("s")).where("s")
    one = lambda flag, name: per.where(flag).groupBy("scope").agg(F.min("release_id").alias("witness")).select("scope", F.lit(name).alias("predicate"), "witness")
    return one("d", "F1").unionByName(one("p", "F2"))


def f3(a: DataFrame, k: int = 20) -> DataFrame:
    """A grouped release with sensitive columns and no threshold, or one below k."""
    per = a.groupBy("scope", "release_id").agg(F.bool_or(F.col("atom_kind") == "GROUPED").alias("g"), F.bool_or(F.coalesce(F.col("b") == "SENSITIVE_ATTRIBUTE", F.lit(False))).alias("s"), F.min(F.when(F.col("atom_kind") == "THRESHOLD", F.col("a").cast("int"))).alias("k"))
    return per.where((F.col("g")) & F.col("s") & F.coalesce(F.col("k") < k, F.lit(True))).groupBy("scope").agg(F.min("release_id").alias("witness")).select("scope", F.lit("F3").alias("predicate"), "witness")


def f4(a: DataFrame) -> DataFrame:
    """An identifier and a sensitive attribute shown in two different releases of a scope; found from the smallest and largest release of each kind, without pairing releases."""
    shown = a.where("atom_kind like 'COLUMN_%' and atom_kind not in ('COLUMN_REFERENCE', 'COLUMN_AGGREGATE_VALUE')")
    lo_hi = lambda cond, n: [F.min(F.when(cond, F.col("release_id"))).alias(f"{n}_lo"), F.max(F.when(cond, F.col("release_id"))).alias(f"{n}_hi")]
    per = shown.groupBy("scope").agg(*lo_hi(F.col("b").isin(IDENTIFIERS), "i"), *lo_hi(F.col("b") == "SENSITIVE_ATTRIBUTE", "s"))
    both = per.where("i_lo is not null and s_lo is not null and not (i_lo = i_hi and s_lo = s_hi and i_lo = s_lo)")
    return both.select("scope", F.lit("F4").alias("predicate"), F.least("i_lo", "s_lo").alias("witness"))


def f5(observations: DataFrame) -> DataFrame:
    """The same sensitive family under two snapshots; a family seen without any is INDETERMINATE. scope, family, snapshot, release_id."""
    per = observations.groupBy("scope", "family").agg(F.count_distinct("snapshot").alias("n"), F.bool_or(F.col("snapshot").isNull()).alias("gap"), F.min("release_id").alias("witness"))
    return per.select("scope", "family", "witness", F.when(F.col("n") >= 2, "MATCHED").when(F.col("gap"), "INDETERMINATE").otherwise("CLEAR").alias("result")).where("result <> 'CLEAR'")


def evaluate_state(a: DataFrame, k: int = 20) -> DataFrame:
    """scope, forbidden (predicates that match, sorted) of each scope with any."""
    hits = f1_f2(a).unionByName(f3(a, k)).unionByName(f4(a))
    return hits.groupBy("scope").agg(F.concat_ws(",", F.array_sort(F.collect_set("predicate"))).alias("forbidden"))


def evaluate_all(a: DataFrame, observations: DataFrame, governance: DataFrame, k: int = 20) -> DataFrame:
    """scope, forbidden, indeterminate of each scope with either: the predicates F1 to F6 that match, and those that lack what they need (sorted).

    observations: scope, family, snapshot, release_id (as `f5`). governance: scope, result (as `f6` of variants gives it). A predicate that
    matches somewhere in the scope isn't indeterminate there.
    """
    hits = f1_f2(a).unionByName(f3(a, k)).unionByName(f4(a)).select("scope", "predicate", F.lit(True).alias("hit"))
    seen = f5(observations).select("scope", F.lit("F5").alias("predicate"), (F.col("result") == "MATCHED").alias("hit"))
    governed = governance.select("scope", F.lit("F6").alias("predicate"), F.lit(True).alias("hit"))
    per = hits.unionByName(seen).unionByName(governed).groupBy("scope", "predicate").agg(F.bool_or("hit").alias("hit"))
    names = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(F.when(c, F.col("predicate")))))
    return per.groupBy("scope").agg(names(F.col("hit")).alias("forbidden"), names(~F.col("hit")).alias("indeterminate"))


def verify_paths(steps: DataFrame) -> DataFrame:
    """Steps (path, step) whose pre_state isn't the post_state of the step before."""
    before = F.lag("post_state").over(Window.partitionBy("path").orderBy("step"))
    return steps.withColumn("_before", before).where("_before is not null and not (_before <=> pre_state)").select("path", "step")


def what_if(states: DataFrame, variants: DataFrame, depth: int = 3, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """First forbidden state that each scope can reach: scope, depth (0: it is there already), path (the smallest).

    states: scope, mask (bits of the categories shown). variants: scope, action, bit, that a
    further release would show. Forbidden: an identifier (bits 1, 2) with a sensitive attribute
    (bit 8). Breadth first over all scopes at once; a scope leaves the frontier when it has a
    witness, and a state is entered once, by its smallest path. Scopes without one aren't returned.
    """
    keep = keep or keeper(states.sparkSession)
    bad = (F.col("mask").bitwiseAND(3) != 0) & (F.col("mask").bitwiseAND(8) != 0)
    now = keep(states.groupBy("scope").agg(F.bit_or("mask").alias("mask")).withColumn("path", F.lit("")))
    seen = now.select("scope", "mask")
    out = now.where(bad).select("scope", F.lit(0).alias("depth"), "path")
    for d in range(1, depth + 1):
        step = now.where(~bad).join(variants, "scope").select("scope", F.col("mask").bitwiseOR(F.col("bit")).alias("mask"), F.concat_ws(">", F.when(F.col("path") != "", F.col("path")), F.col("action")).alias("path"))
        fresh = step.groupBy("scope", "mask").agg(F.min("path").alias("path")).join(seen, ["scope", "mask"], "left_anti")
        now = keep(fresh.join(out.select("scope"), "scope", "left_anti"))
        seen = seen.unionByName(now.select("scope", "mask"))
        out = keep(out.unionByName(now.where(bad).groupBy("scope").agg(F.min("path").alias("path")).select("scope", F.lit(d).alias("depth"), "path")))
    return out
