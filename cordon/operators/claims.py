"""Catalog intake and evidence claims: labels, lineage, snapshots, claim generation and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sha(*columns) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in columns)), 256)


def normal_label(label: str) -> Column:
    """Lower case, without other characters than a-z and 0-9."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def collect_labels(raw: DataFrame) -> DataFrame:
    """dataset, field, label, is_blank: plain (array `tags`) and edited (array `edited`) labels, each once, trimmed; blanks are marked to be rejected."""
    each = raw.select("dataset", "field", F.explode(F.concat(F.coalesce("tags", F.array()), F.coalesce("edited", F.array()))).alias("label"))
    return each.select("dataset", "field", F.trim("label").alias("label")).distinct().withColumn("is_blank", F.coalesce(F.col("label") == "", F.lit(True)))


def classify_fields(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds the normalised label and its category (null for a label that the dictionary doesn't hold)."""
    return labels.withColumn("label", normal_label("label")).join(dictionary, "label", "left")


def attach_lineage(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """dataset, field, src_key, src_category, resolved: upstream columns without self edges.

    A source that isn't in the catalog, or whose edge is incomplete, becomes an UNCLASSIFIED one
    with a key made of its digest, so that it blocks instead of being lost.
    """
    other = edges.where("not (dataset <=> src_dataset and field <=> src_field)").distinct()
    known = other.join(catalog.select(F.col("dataset").alias("src_dataset"), F.col("field").alias("src_field"), F.col("category").alias("src_category")), ["src_dataset", "src_field"], "left")
    resolved = F.col("src_category").isNotNull() & F.col("complete")
    key = F.when(resolved, F.concat_ws(".", "src_dataset", "src_field")).otherwise(F.concat(F.lit("unresolved."), F.substring(_sha("dataset", "field", "src_dataset", "src_field"), 1, 16)))
    return known.select("dataset", "field", key.alias("src_key"), F.when(resolved, F.col("src_category")).otherwise("UNCLASSIFIED").alias("src_category"), resolved.alias("resolved"))


def check_assets(assets: DataFrame, prefix: str, flagship: str) -> DataFrame:
    """map, n_assets, faults of each asset map (map, asset, urn): DUPLICATE_URN, BAD_PREFIX, NO_FLAGSHIP."""
    per = assets.groupBy("map").agg(F.count("*").alias("n_assets"), F.count_distinct("urn").alias("n_urns"), F.bool_and(F.coalesce(F.col("urn").startswith(prefix), F.lit(False))).alias("ok"), F.bool_or(F.col("asset") == flagship).alias("there"))
    fault = F.concat_ws(",", F.when(F.col("n_urns") < F.col("n_assets"), "DUPLICATE_URN"), F.when(~F.col("ok"), "BAD_PREFIX"), F.when(~F.coalesce("there", F.lit(False)), "NO_FLAGSHIP"))
    return per.select("map", "n_assets", fault.alias("faults"))


def snapshot_sha(catalog: DataFrame) -> DataFrame:
    """snapshot and content_sha256: a digest of its fields, without the time of observation.

    Fields are digested by dataset and datasets by snapshot, so no snapshot's fields meet in one array.
    """
    row = _sha("field", "category")
    sets = catalog.groupBy("snapshot", "dataset").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(row))), 256).alias("d"))
    return sets.groupBy("snapshot").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "dataset", "d")))), 256).alias("content_sha256"))


def build_claims(fields: DataFrame, lineage: DataFrame, snapshot: str) -> DataFrame:
    """Claims of a catalog: claim_id, subject, predicate, value, derivation, content_sha256.

    fields: dataset, urn, owner, domain, field, category. lineage: dataset, field, src_dataset,
    src_field. Predicates of a dataset: DATASET_EXISTS, DATASET_URN, DATASET_OWNER, DATASET_DOMAIN,
    FIELD_COUNT; of a field: FIELD_EXISTS, FIELD_CATEGORY, FIELD_IS_SENSITIVE; of an edge:
    LINEAGE_EDGE, LINEAGE_SOURCE_EXISTS, LINEAGE_SOURCE_CATEGORY.
    """
    key = F.concat_ws(".", "dataset", "field")
    sets = fields.groupBy("dataset").agg(F.min("urn").alias("urn"), F.min("owner").alias("owner"), F.min("domain").alias("domain"), F.count("*").alias("n"))
    source = fields.select(F.col("dataset").alias("src_dataset"), F.col("field").alias("src_field"), F.col("category").alias("src_category"))
    edges = lineage.join(source, ["src_dataset", "src_field"], "left")

    def stacked(df: DataFrame, subject: Column, values: dict[str, Column], derivation: str) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("value")) for p, v in values.items())))
        return df.select(subject.alias("subject"), each.alias("x")).select("subject", "x.predicate", "x.value", F.lit(derivation).alias("derivation"))

    claims = reduce(DataFrame.unionByName, [
        stacked(sets, F.col("dataset"), {"DATASET_EXISTS": F.lit("true"), "DATASET_URN": F.col("urn"), "DATASET_OWNER": F.col("owner"), "DATASET_DOMAIN": F.col("domain"), "FIELD_COUNT": F.col("n")}, "observed"),
        stacked(fields, key, {"FIELD_EXISTS": F.lit("true"), "FIELD_CATEGORY": F.col("category"), "FIELD_IS_SENSITIVE": F.col("category") == "SENSITIVE_ATTRIBUTE"}, "mapped"),
        stacked(edges, F.concat(key, F.lit("<"), F.concat_ws(".", "src_dataset", "src_field")), {"LINEAGE_EDGE": F.lit("true"), "LINEAGE_SOURCE_EXISTS": F.col("src_category").isNotNull(), "LINEAGE_SOURCE_CATEGORY": F.coalesce("src_category", F.lit("UNCLASSIFIED"))}, "mapped"),
    ]).where("value is not null").distinct()
    return claims.withColumn("claim_id", F.substring(_sha(F.lit(snapshot), "subject", "predicate"), 1, 16)).withColumn("content_sha256", _sha("claim_id", "subject", "predicate", "value", "derivation"))


def check_claims(claims: DataFrame, snapshot: str) -> DataFrame:
    """claim_id and the first fault of each claim: ID, DIGEST, INTERVAL (its end isn't after its start) or SUPPORTS (not sorted or not unique)."""
    fault = F.when(F.col("claim_id") != F.substring(_sha(F.lit(snapshot), "subject", "predicate"), 1, 16), "ID").when(F.col("content_sha256") != _sha("claim_id", "subject", "predicate", "value", "derivation"), "DIGEST")
    fault = fault.when(F.col("effective_until") <= F.col("effective_from"), "INTERVAL").when(F.col("supports") != F.array_sort(F.array_distinct("supports")), "SUPPORTS")
    return claims.select("claim_id", fault.alias("fault")).where("fault is not null")


def check_bundle(claims: DataFrame, lifetime_s: int, now: Column) -> DataFrame:
    """bundle, n_claims, faults: the claims of a bundle share snapshot, version and time; it lives as long as the policy says, isn't of the future and isn't stale."""
    one = lambda c: F.min(c) != F.max(c)
    life = F.col("expires_at").cast("timestamp").cast("double") - F.col("observed_at").cast("timestamp").cast("double")
    per = claims.groupBy("bundle").agg(
        F.count("*").alias("n_claims"), one("snapshot").alias("s"), one("version").alias("v"), one("observed_at").alias("o"), F.bool_or(F.abs(life - lifetime_s) > 1e-3).alias("l"), F.bool_or(F.col("observed_at") > now).alias("f"), F.bool_or(F.col("expires_at") <= now).alias("e"),
    )
    names = {"s": "SNAPSHOT", "v": "VERSION", "o": "OBSERVED_AT", "l": "LIFETIME", "f": "FUTURE", "e": "STALE"}
    return per.select("bundle", "n_claims", F.concat_ws(",", *(F.when(F.col(c), n) for c, n in names.items())).alias("faults"))


def required_facts(expected: DataFrame, claims: DataFrame) -> DataFrame:
    """query_id, subject, predicate, status of the facts that queries rest on, against resolved claims (subject, predicate, value, trusted).

    MISSING without a claim, CONFLICTING with several values, AMBIGUOUS with several claims of one value, NOT_TRUSTED if none is trusted, else COVERED.
    """
    per = claims.groupBy("subject", "predicate").agg(F.count("*").alias("n"), F.count_distinct("value").alias("v"), F.bool_or("trusted").alias("t"))
    status = F.when(F.col("n").isNull(), "MISSING").when(F.col("v") > 1, "CONFLICTING").when(~F.col("t"), "NOT_TRUSTED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("COVERED")
    return expected.distinct().join(per, ["subject", "predicate"], "left").select("query_id", "subject", "predicate", status.alias("status"))


def partition_claims(claims: DataFrame) -> DataFrame:
    """subject, observed, mapped: sorted claim ids of each kind of derivation."""
    own = lambda d: F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("derivation") == d, F.col("claim_id")))))
    return claims.groupBy("subject").agg(own("observed").alias("observed"), own("mapped").alias("mapped"))
