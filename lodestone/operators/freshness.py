"""Freshness of candidates: time flags, correction chains, age windows and warnings.

Rows are keyed by a candidate set (``scope``): one per distinct filter and basis time. All
per-set facts are map-side combined aggregates that are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.operators.graph import chain_roots
from lodestone.operators.skew import hinted_join, is_small

SUPPORTED = list(fixed.MAX_AGE_DAYS)


def time_flags(candidates: DataFrame, scopes: DataFrame, zone: str = fixed.LOCAL_ZONE) -> DataFrame:
    """STR-06 / DAT-03: missing and future flags, age in local days, eligibility."""
    joined = hinted_join(candidates, scopes, ["scope"], is_small(scopes))
    supported = F.col("source_type").isin(SUPPORTED)
    missing = supported & F.col("effective_at").isNull()
    future = supported & F.coalesce(F.col("effective_at") > F.col("basis_at"), F.lit(False))
    return joined.withColumn("missing_time", missing).withColumn("future_time", future).withColumn(
        "eligible", ~missing & ~future
    ).withColumn("age_days", F.when(supported & ~missing & ~future, times.age_days("effective_at", "basis_at", zone)))


def active_corrections(flagged: DataFrame) -> DataFrame:
    """Edges from an active correction to the document it replaces."""
    return flagged.where(
        (F.col("source_type") == "disclosure") & F.col("eligible") & ~F.col("is_withdrawn")
        & F.col("is_correction") & F.col("correction_of").isNotNull()
    ).select("scope", F.col("document_id").alias("node"), F.col("correction_of").alias("parent")).distinct()


def drop_replaced(flagged: DataFrame, edges: DataFrame) -> DataFrame:
    """JOI-12: eligible rows that are neither withdrawn nor replaced by an active correction."""
    replaced = edges.select("scope", F.col("parent").alias("document_id")).distinct()
    kept = flagged.where(F.col("eligible") & ~((F.col("source_type") == "disclosure") & F.col("is_withdrawn")))
    return kept.join(replaced, ["scope", "document_id"], "left_anti")


def mismatched_targets(documents: DataFrame) -> DataFrame:
    """JOI-13: corrections whose target is not a disclosure of the same securities, or is themselves."""
    targets = documents.select(
        F.col("document_id").alias("correction_of"), F.col("source_type").alias("target_source"),
        F.array_sort("primary_security_ids").alias("target_ids"),
    )
    rows = documents.where(F.col("correction_of").isNotNull()).join(targets, "correction_of", "left")
    reason = (
        F.when(F.col("correction_of") == F.col("document_id"), F.lit("self"))
        .when(F.col("target_ids").isNull(), F.lit(None).cast("string"))
        .when(F.col("target_source") != "disclosure", F.lit("not_a_disclosure"))
        .when(F.array_sort("primary_security_ids") != F.col("target_ids"), F.lit("other_securities"))
    )
    return rows.select("document_id", "correction_of", reason.alias("reason")).where(F.col("reason").isNotNull())


def source_ages(flagged: DataFrame) -> DataFrame:
    """AGG-17: youngest eligible age per set and source, against the stale limits."""
    limits = F.create_map(*[part for name, days in fixed.STALE_AFTER_DAYS.items() for part in (F.lit(name), F.lit(days))])
    ages = flagged.where(F.col("eligible") & F.col("age_days").isNotNull()).groupBy("scope", "source_type").agg(
        F.min("age_days").alias("youngest")
    )
    return ages.withColumn("stale", F.coalesce(F.col("youngest") > F.try_element_at(limits, F.col("source_type")), F.lit(False)))


def disclosure_windows(visible: DataFrame) -> DataFrame:
    """AGG-18: number of recent disclosures per set and the age limit that follows from it."""
    recent = (F.col("source_type") == "disclosure") & F.col("age_days").between(0, fixed.MAX_AGE_DAYS["disclosure"])
    counts = visible.groupBy("scope").agg(F.countDistinct(F.when(recent, F.col("document_id"))).alias("recent_disclosures"))
    extended = F.col("recent_disclosures") < fixed.MIN_DISCLOSURES
    return counts.withColumn(
        "disclosure_max_age",
        F.when(extended, F.lit(fixed.DISCLOSURE_FALLBACK_DAYS)).otherwise(F.lit(fixed.MAX_AGE_DAYS["disclosure"])),
    )


def has_user_range() -> Column:
    return F.col("start_day").isNotNull() | F.col("end_day").isNotNull()


def terminals_per_root(retained: DataFrame, edges: DataFrame) -> DataFrame:
    """WIN-11: sets in which one root document ends in more than one retained correction."""
    roots, _ = chain_roots(edges, "scope")
    kept = retained.where(F.col("source_type") == "disclosure").select("scope", F.col("document_id").alias("node")).distinct()
    return roots.join(kept, ["scope", "node"], "left_semi").groupBy("scope", "root").agg(
        F.countDistinct("node").alias("terminals")
    )


def apply_freshness(candidates: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CMP-02: retained candidates, one summary row per set, and ordered warnings.

    ``candidates``: scope, evidence_id, document_id, source_type, effective_at, is_correction,
    has_subsequent_correction, is_withdrawn, correction_of. ``scopes``: scope, source_types,
    start_day, end_day, basis_at.
    """
    flagged = time_flags(candidates, scopes)
    edges = active_corrections(flagged)
    visible = drop_replaced(flagged, edges)
    small = is_small(scopes)
    windows = scopes.join(disclosure_windows(visible), "scope", "left").withColumn(
        "disclosure_max_age", F.coalesce("disclosure_max_age", F.lit(fixed.DISCLOSURE_FALLBACK_DAYS))
    )
    limits = F.create_map(*[
        part for name, days in fixed.MAX_AGE_DAYS.items() if name != "disclosure" for part in (F.lit(name), F.lit(days))
    ])
    max_age = F.when(F.col("source_type") == "disclosure", F.col("disclosure_max_age")).otherwise(
        F.try_element_at(limits, F.col("source_type"))
    )
    retained = hinted_join(visible, windows.select("scope", "disclosure_max_age"), ["scope"], small).where(
        has_user_range() | ~F.col("source_type").isin(SUPPORTED) | F.coalesce(F.col("age_days").between(0, max_age), F.lit(False))
    )

    is_disclosure = F.col("source_type") == "disclosure"
    # Retained disclosures are never replaced, so a later correction that is announced is an unseen one.
    open_end = is_disclosure & (F.col("has_subsequent_correction") | (F.col("is_correction") & F.col("correction_of").isNull()))
    kept = retained.groupBy("scope").agg(
        F.countDistinct(F.when(is_disclosure, F.col("document_id"))).alias("kept_disclosures"),
        F.max(F.when(is_disclosure, F.col("effective_at"))).alias("latest"), F.bool_or(open_end).alias("open_end"),
        F.count(F.lit(1)).alias("retained_count"),
    )
    split = terminals_per_root(retained, edges).groupBy("scope").agg((F.max("terminals") > 1).alias("split_root"))
    wants = F.array_contains("source_types", "disclosure")
    no = F.lit(False)
    summary = windows.join(kept, "scope", "left").join(split, "scope", "left").select(
        "scope", "source_types", has_user_range().alias("user_range"), wants.alias("wants_disclosure"),
        (wants & ~has_user_range() & (F.col("disclosure_max_age") > fixed.MAX_AGE_DAYS["disclosure"])).alias("extended"),
        (wants & ~has_user_range() & (F.coalesce("kept_disclosures", F.lit(0)) < fixed.MIN_DISCLOSURES)).alias("insufficient"),
        (F.coalesce("open_end", no) | F.coalesce("split_root", no)).alias("unresolved"),
        F.coalesce("retained_count", F.lit(0)).alias("retained_count"), "latest",
    ).withColumn("latest_disclosure_at", F.when(~F.col("unresolved"), F.col("latest"))).drop("latest")

    per_set = summary.select("scope", F.explode(F.array(
        F.when(F.col("extended"), F.lit("disclosure_window_extended")),
        F.when(F.col("insufficient"), F.lit("insufficient_disclosure_coverage")),
        F.when(F.col("unresolved") & F.col("wants_disclosure"), F.lit("unresolved_disclosure_correction")),
    )).alias("code")).where(F.col("code").isNotNull()).withColumn("source_type", F.lit("disclosure"))
    flags = flagged.groupBy("scope", "source_type").agg(
        F.bool_or("missing_time").alias("missing_published_at"), F.bool_or("future_time").alias("future_published_at")
    )
    timing = flags.select("scope", "source_type", F.explode(F.array(
        F.when(F.col("missing_published_at"), F.lit("missing_published_at")), F.when(F.col("future_published_at"), F.lit("future_published_at"))
    )).alias("code")).where(F.col("code").isNotNull())
    stale = hinted_join(source_ages(flagged).where("stale"), summary.select("scope", "user_range"), ["scope"], small).where(
        ~F.col("user_range")
    ).select("scope", "source_type", F.concat(F.lit("stale_"), "source_type").alias("code"))
    order = F.array(*[F.lit(code) for code in fixed.WARNING_ORDER])
    warnings = timing.unionByName(stale).unionByName(per_set).join(summary.select("scope", "source_types"), "scope").select(
        "scope", "source_type", "code", F.array_position("source_types", F.col("source_type")).alias("source_place"),
        F.array_position(order, F.col("code")).alias("code_place"),
    )
    return retained, summary, warnings
