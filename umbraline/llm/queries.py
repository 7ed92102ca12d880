"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraline.llm import address_rewrites, bin_slack, censored_lengths, lookalike, name_attribution, pair_index_bpe, refinement, weak_spans
from umbraline.plans.lineage import cut
from umbraline.sources.tables import table


# Fixed values of the project's data.
LOOK_TYPES = ["PERSON", "ORG_PRIVATE", "EMAIL", "USERNAME", "CITY_STATE", "BIRTHPLACE", "EMPLOYEE_ID", "CUSTOMER_ID"]
LOOK_KEY_TYPES = ["EMAIL", "USERNAME", "CUSTOMER_ID", "BIRTHPLACE", "CITY_STATE", "EMPLOYEE_ID"]
COPY_KEY_TYPES = ["POLICY_NUMBER", "MEMBER_ID", "CASE_NUMBER", "MATTER_ID", "ADDRESS", "UNCLASSIFIED_GROUP_VALUE"]
FREE_ORDER_TYPES = ["ADDRESS", "UNCLASSIFIED_GROUP_VALUE"]


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "candidates").where("pii_type IN ('ADDRESS', 'STREET', 'PO_BOX')")
    return address_rewrites.locations(rows, "cand_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return address_rewrites.same_location_pairs(cut(_locations(spark, sf_dir)), "cand_id")


def p1_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address record with its location."""
    return _locations(spark, sf_dir)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "candidates").where("source = 'group' AND pii_type = 'UNCLASSIFIED_GROUP_VALUE'")
    registry = table(spark, sf_dir, "registry").where(F.col("pii_type").isin(COPY_KEY_TYPES))
    free = F.col("pii_type").isin(FREE_ORDER_TYPES)
    a = refinement.copies(candidates, "cand_id", "text", ["pii_type"], free)
    b = refinement.copies(registry, "record_id", "normalized", ["pii_type", "discriminator"], free)
    return a.select(F.lit("candidates").alias("tbl"), "first_id", "copies").unionByName(
        b.select(F.lit("registry").alias("tbl"), "first_id", "copies")
    )


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("pii_type").isin("PERSON", "ORG_PRIVATE")
    registry = table(spark, sf_dir, "registry").where(wanted).select(
        F.col("record_id").alias("row_id"), F.col("scope_ref").alias("scope"), "pii_type", F.col("original").alias("spelling")
    )
    roster = table(spark, sf_dir, "roster").where(wanted).select(
        F.col("roster_id").alias("row_id"), F.col("first_seen_in").alias("scope"), "pii_type", F.col("original").alias("spelling")
    )
    spelt = F.array_append(F.coalesce(F.flatten(F.map_values("forms")), F.array().cast("array<string>")), F.col("canonical"))
    profiles = table(spark, sf_dir, "profiles").where(wanted).select(
        F.col("entity_id").alias("row_id"), F.col("scope_ref").alias("scope"), "pii_type", F.explode(spelt).alias("spelling")
    )
    return name_attribution.entities(registry.unionByName(roster).unionByName(profiles))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_attribution.same_entity_pairs(cut(_entities(spark, sf_dir)))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named row with its entity."""
    return _entities(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "candidates").where(F.col("pii_type").isin(LOOK_TYPES))
    registry = table(spark, sf_dir, "registry").where(F.col("pii_type").isin(LOOK_KEY_TYPES))
    a = lookalike.same_look_pairs(candidates, ["fixture", "page_no", "pii_type"], "cand_id", "text")
    b = lookalike.same_look_pairs(registry, ["scope_ref", "pii_type"], "record_id", "normalized")
    return a.select(F.lit("candidates").alias("tbl"), "id_a", "id_b").unionByName(b.select(F.lit("registry").alias("tbl"), "id_a", "id_b"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its consistent form."""
    a = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("tbl"), F.col("cand_id").alias("id"), "text")
    b = table(spark, sf_dir, "registry").select(F.lit("registry").alias("tbl"), F.col("record_id").alias("id"), F.col("normalized").alias("text"))
    return lookalike.canonical_form(a.unionByName(b).distinct())


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").select(F.lit("search_hits").alias("tbl"), F.col("hit_id").alias("row_id"), F.col("line_text").alias("text"))
    remarks = table(spark, sf_dir, "candidates").where("source = 'manual' AND pii_type = 'UNCLASSIFIED_GROUP_VALUE'")
    rows = hits.unionByName(remarks.select(F.lit("candidates").alias("tbl"), F.col("cand_id").alias("row_id"), "text"))
    names = table(spark, sf_dir, "registry").where("pii_type = 'PERSON'").select(F.col("original").alias("name"))
    names = names.unionByName(table(spark, sf_dir, "roster").where("pii_type = 'PERSON'").select(F.col("original").alias("name")))
    names = names.unionByName(table(spark, sf_dir, "candidates").where("pii_type = 'PERSON'").select(F.col("text").alias("name")))
    return weak_spans.mentions(rows, names)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mentions(spark, sf_dir).select("tbl", "row_id", F.explode("found").alias("m"))
    return found.select("tbl", "row_id", "m.pii_type", "m.span_start", "m.span_end")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_spans.redacted(_mentions(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.encode(table(spark, sf_dir, "documents"))


def p7_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted once: the packing reads the sizes several times.
    sizes = cut(pair_index_bpe.token_counts(table(spark, sf_dir, "documents")))
    return bin_slack.requests(sizes, table(spark, sf_dir, "model_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.fill(p7_requests(spark, sf_dir), table(spark, sf_dir, "model_limits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censored_lengths.judged(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censored_lengths.by_source(censored_lengths.judged(table(spark, sf_dir, "documents")))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field limits of each source with their censoring posterior."""
    return censored_lengths.field_limits(table(spark, sf_dir, "documents").where("text is not null and source is not null"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_locations": p1_locations,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_entities": p3_entities,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_ids": p6_ids,
    "p7_requests": p7_requests,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
    "p8_limits": p8_limits,
}
ORACLES: dict[str, str] = {}
