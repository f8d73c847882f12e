"""Citations: link, company, locator, URL and grounding checks of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import urls
from lodestone.functions.text import fold, grounding_tokens
from lodestone.operators.filters import scope_match
from lodestone.operators.skew import hinted_join, is_small


def claim_links(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """JOI-17: one row per (claim, evidence id); evidence columns are null when the id is unknown, the id when a claim names none."""
    rows = claims.select("claim_id", "request_id", "text", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"))
    return rows.join(evidence, "evidence_id", "left")


def locator_reason() -> Column:
    """CMP-07: what is wrong with the promoted locator fields of an evidence row, by source type."""
    source = F.col("source_type")
    blank = lambda name: F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    url, locator_url = F.col("source_url"), F.col("locator_url")
    differs = ~locator_url.eqNullSafe(url)
    safe = F.coalesce(urls.is_safe_url(url), F.lit(False))
    viewer = F.concat(F.lit(fixed.DISCLOSURE_VIEWER), "receipt_no")
    news = (
        F.when(blank("provider"), F.lit("invalid_locator")).when(differs, F.lit("unsafe_source_url"))
        .when(url.isNotNull(), F.when(~safe, F.lit("unsafe_source_url")))
        .when(F.col("locator_time").isNull() | F.coalesce(F.col("raw_index") < 0, F.lit(True)), F.lit("invalid_locator"))
    )
    disclosure = (
        F.when(blank("provider") | ~F.coalesce(F.col("receipt_no").rlike(r"^\d{14}$"), F.lit(False)), F.lit("invalid_locator"))
        .when(differs | F.coalesce(locator_url != viewer, F.lit(True)) | ~safe, F.lit("unsafe_source_url"))
    )
    numbered = F.col("page_basis").isin(fixed.PAGE_BASES_WITH_NUMBER)
    unnumbered = F.col("page_basis").isin(fixed.PAGE_BASES_WITHOUT_NUMBER)
    asset = F.col("source_asset_id")
    opaque = F.coalesce(asset.rlike(fixed.OPAQUE_ASSET_ID) & ~asset.isin(".", "..") & asset.rlike("[A-Za-z0-9]"), F.lit(False))
    report = (
        F.when(blank("manifest_id") | blank("section") | ~F.coalesce(numbered | unnumbered, F.lit(False)), F.lit("invalid_locator"))
        .when(F.coalesce(F.col("locator_document_id") != F.col("document_id"), F.lit(True)), F.lit("invalid_locator"))
        .when(numbered & ~F.coalesce(F.col("page") > 0, F.lit(False)), F.lit("invalid_locator"))
        .when(unnumbered & F.col("page").isNotNull(), F.lit("invalid_locator"))
        .when(asset.isNotNull() & ~opaque, F.lit("invalid_locator"))
        .when(url.isNotNull(), F.when(differs | ~safe, F.lit("unsafe_source_url")))
        .when(locator_url.isNotNull(), F.lit("unsafe_source_url")).when(~opaque, F.lit("invalid_locator"))
    )
    glossary = (
        F.when(blank("manifest_id") | blank("entry_id") | blank("section") | F.col("version").isNull(), F.lit("invalid_locator"))
        .when(differs | (url.isNotNull() & ~safe), F.lit("unsafe_source_url"))
    )
    return (
        F.when(source == "news", news).when(source == "disclosure", disclosure).when(source == "research_report", report)
        .when(source == "glossary", glossary).otherwise(F.lit("invalid_locator"))
    )


def claim_grounding(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """CMP-06: per claim, whether its evidence supports it.

    A claim found verbatim in its only evidence is grounded. Otherwise at least two of its tokens and
    30 % of them must occur in the evidence, and every evidence must share a token. Only cited
    evidence is read: the texts meet once by id and their tokens are intersected in the row.
    """
    links = claims.select(
        "claim_id", fold("text").alias("claim_text"), grounding_tokens("text").alias("asked"), F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")
    )
    texts = evidence.select("evidence_id", fold("snippet").alias("snippet_text"), grounding_tokens("snippet").alias("offered"))
    shared = F.array_intersect("asked", "offered")
    read = links.join(texts, "evidence_id").select(
        "claim_id", F.size(F.array_distinct("asked")).alias("wanted"), shared.alias("shared"), F.contains("snippet_text", "claim_text").alias("quoted")
    )
    # A claim names a handful of evidences, each with the claim's own tokens at most.
    rows = read.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("sources"), F.bool_or("quoted").alias("quoted"), F.max("wanted").alias("wanted"),
        F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).alias("overlap"), F.count_if(F.size("shared") > 0).alias("touched"),
    )
    enough = (
        (F.col("overlap") >= fixed.GROUNDING_MIN_SHARED) & (F.col("overlap") / F.greatest("wanted", F.lit(1)) >= fixed.GROUNDING_MIN_COVERAGE)
        & (F.col("touched") == F.col("sources"))
    )
    return rows.select("claim_id", (((F.col("sources") == 1) & F.col("quoted")) | enough).alias("grounded"))


def validate_citations(claims: DataFrame, requests: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CMP-05: citations of accepted claims, and the first failing reason of the others."""
    links = hinted_join(claim_links(claims, evidence), requests.select("request_id", "security_id"), ["request_id"], is_small(requests))
    unknown = F.col("document_id").isNull()
    company = ~F.coalesce(scope_match("security_id"), F.lit(False))
    row_reason = F.when(F.col("evidence_id").isNull(), F.lit(5)).when(unknown, F.lit(1)).when(company, F.lit(2)).when(F.col("locator_issue") == "invalid_locator", F.lit(3)).when(
        F.col("locator_issue") == "unsafe_source_url", F.lit(4)
    )
    judged = links.withColumn("locator_issue", locator_reason()).withColumn("row_reason", row_reason)
    worst = judged.groupBy("claim_id").agg(F.min("row_reason").alias("place"))
    grounded = claim_grounding(claims, evidence)
    names = F.array(*[F.lit(name) for name in fixed.REJECTION_ORDER])
    verdicts = worst.join(grounded, "claim_id", "left").withColumn(
        "place", F.coalesce("place", F.when(~F.coalesce("grounded", F.lit(False)), F.lit(5)))
    )
    rejections = verdicts.where(F.col("place").isNotNull()).select("claim_id", F.get(names, F.col("place") - 1).alias("code"))
    accepted = verdicts.where(F.col("place").isNull()).select("claim_id")
    citations = links.join(accepted, "claim_id", "left_semi").select("claim_id", "evidence_id", "document_id", "source_type", "title", "source_url")
    return citations, rejections
