"""Research report bundles, disclosure documents and event-window disclosures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.operators import topics
from lodestone.operators.skew import top_rows
from lodestone.operators.validation import permission_reason, reconcile


def event_window_disclosures(items: DataFrame, start: str, end: str) -> DataFrame:
    """FLT-13: filings inside the window, not superseded, with at least one topic in their name."""
    return items.where(
        F.col("submitted_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("correction_status") != "superseded")
    ).withColumn("topics", topics.title_topics("report_name")).where(F.size("topics") > 0)


def section_documents(manifests: DataFrame, sections: DataFrame, as_of_day: Column, separator: str = " - ") -> DataFrame:
    """PRJ-04: one document per section with joined title, age and stale flag."""
    joined = sections.join(manifests, "manifest_id")
    age = F.datediff(as_of_day, F.col("published_day"))
    title = F.when(F.col("section") == F.col("report_title"), F.col("report_title")).otherwise(F.concat("report_title", F.lit(separator), "section"))
    return joined.withColumn("title", title).withColumn("age_days", age).withColumn("is_stale_candidate", age > fixed.REPORT_STALE_DAYS)


def section_coverage(sections: DataFrame, minimum: int = fixed.MIN_REPORT_SECTIONS) -> DataFrame:
    """PRJ-10: sections and distinct pages per report, and whether there are enough."""
    counts = sections.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("sections"), F.countDistinct("page").alias("pages"))
    return counts.withColumn("ready", F.col("sections") >= minimum)


def bundle_problems(manifests: DataFrame, sections: DataFrame) -> DataFrame:
    """JOI-18: listed and present section ids, positions and parent keys; only problems."""
    listed = manifests.select("manifest_id", F.posexplode("documents").alias("place", "document_id"))
    found = reconcile(
        listed.withColumn("key", F.struct("manifest_id", "document_id")), sections.withColumn("key", F.struct("manifest_id", "document_id")), "key", "place"
    ).select("key.manifest_id", "key.document_id", "problem")
    parents = sections.join(manifests.select("manifest_id", F.col("security_id").alias("expected_security")), "manifest_id").where(
        F.col("security_id") != F.col("expected_security")
    ).select("manifest_id", "document_id", F.lit("other_security").alias("problem"))
    return found.unionByName(parents)


def bundle_coverage(manifests: DataFrame, sections: DataFrame, securities: DataFrame, as_of_day: Column) -> DataFrame:
    """AGG-12: valid bundles per security, zero where there is none."""
    broken = bundle_problems(manifests, sections).select("manifest_id").distinct()
    gate = permission_reason("usage_review_status", "corpus_ingest_allowed", "external_allowed")
    valid = manifests.where((F.col("published_day") <= as_of_day) & gate.isNull()).join(broken, "manifest_id", "left_anti")
    counts = valid.groupBy("security_id").agg(F.countDistinct("manifest_id").alias("valid_reports"))
    return securities.join(counts, "security_id", "left").select("security_id", F.coalesce("valid_reports", F.lit(0)).alias("valid_reports"))


def fact_reason(pages: str = "page_count", allowed: Sequence[str] | None = None) -> Column:
    """CMP-18: first broken rule of a fact row."""
    allowed = [*fixed.REQUIRED_FACT_CATEGORIES, *fixed.OPTIONAL_FACT_CATEGORIES] if allowed is None else allowed
    blank = lambda name: F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    return (
        F.when(blank("fact_id"), F.lit("fact_id")).when(blank("claim"), F.lit("claim"))
        .when(~F.coalesce(F.col("category").isin(list(allowed)), F.lit(False)), F.lit("category"))
        .when(~F.coalesce(F.col("confidence").isin(fixed.FACT_CONFIDENCE), F.lit(False)), F.lit("confidence"))
        .when(~F.col("verification_status").isin(fixed.FACT_VERIFIED, fixed.FACT_VERIFIED_WITH_NOTE), F.lit("verification"))
        .when(~F.coalesce((F.col("page") > 0) & (F.col("page") <= F.col(pages)), F.lit(False)), F.lit("page"))
        .when((F.col("verification_status") == fixed.FACT_VERIFIED_WITH_NOTE) & (F.size("notes") == 0), F.lit("missing_note"))
    )


def fact_coverage(facts: DataFrame, key: str = "document_id") -> DataFrame:
    """CMP-18: facts and required categories per document, and readiness."""
    required = F.col("category").isin(fixed.REQUIRED_FACT_CATEGORIES)
    counts = facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("facts"), F.countDistinct(F.when(required, F.col("category"))).alias("categories")
    )
    return counts.withColumn("ready", (F.col("facts") >= fixed.MIN_FACTS) & (F.col("categories") == len(fixed.REQUIRED_FACT_CATEGORIES)))


def facts_document(facts: DataFrame, key: str = "receipt_no") -> DataFrame:
    """PRJ-09: one disclosure text per receipt, its claims in fact order joined by newlines, with its marks.

    ``facts`` carries report_name and remark of the receipt.
    """
    marks = topics.report_markers("report_name", "remark")
    joined = facts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("fact_id", "claim"))).alias("lines"), F.min("report_name").alias("report_name"), F.min("remark").alias("remark")
    )
    return joined.select(
        key, F.concat(F.lit("disclosure:"), key).alias("document_id"), F.concat_ws("\n", F.transform("lines", lambda line: line["claim"])).alias("text"),
        F.size("lines").alias("fact_count"), marks["is_correction"].alias("is_correction"), marks["has_subsequent_correction"].alias("has_subsequent_correction"),
        marks["is_withdrawn"].alias("is_withdrawn"),
    )


def curated_news(rows: DataFrame) -> DataFrame:
    """PRJ-08: curated rows as documents: prefixed text, time band, hashed id, and the row's ``sequence``."""
    return rows.select(
        F.concat(F.lit("news:"), "security_id", F.lit(":"), F.sha2(F.concat_ws("|", "security_id", "document_id"), 256)).alias("document_id"),
        "security_id", F.trim("title").alias("title"), "published_at", "source_url",
        F.concat("security_name", F.lit(": "), F.trim("summary")).alias("text"), times.time_band("published_at").alias("time_band"), "sequence",
    )


def curate_by_rules(documents: DataFrame, rules: Sequence[dict], key: str = "security_id") -> DataFrame:
    """WIN-13: for each rule in turn, the best unused document of every security.

    ``rules``: dicts with event_id, time_band and terms, the same for all securities. A document is
    used up with its URL, title and time; a used host only counts against it. Each round keeps one
    row per security (cut before the shuffle) and drops the used rows by anti-joins against that one row.
    """
    from lodestone.functions import urls
    from lodestone.functions.text import contains_any, fold
    from lodestone.session import cut_lineage

    pool = documents.withColumn("title_key", fold("title")).withColumn("text_key", fold("text")).withColumn(
        "band", times.time_band("published_at")
    ).withColumn("host", urls.publisher_host("source_url"))
    pool = cut_lineage(pool)
    hosts = pool.select(key, "host").limit(0)
    chosen = None
    for place, rule in enumerate(rules):
        terms = [term.casefold() for term in rule["terms"]]
        in_title = contains_any("title_key", terms)
        fitting = pool.where((F.col("band") == rule["time_band"]) & (in_title | contains_any("text_key", terms)))
        known = hosts.distinct().withColumn("__used", F.lit(1))
        ranked = fitting.join(known, [key, "host"], "left")
        order = [F.when(in_title, 0).otherwise(1), F.col("published_at").desc(), F.coalesce("__used", F.lit(0)), F.col("document_id")]
        best = cut_lineage(top_rows(ranked, [key], order, 1).drop("__used").withColumn("event_id", F.lit(rule["event_id"])).withColumn("rule", F.lit(place)))
        chosen = best if chosen is None else chosen.unionByName(best)
        hosts = chosen.select(key, "host")
        left = pool
        for column in ("document_id", "source_url", "title_key", "published_at"):
            left = left.join(best.select(key, column), [key, column], "left_anti")
        pool = left
    return chosen.drop("title_key", "text_key", "band", "host")
