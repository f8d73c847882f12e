"""Documents to evidence: attribution scope, snippets, disclosure facts, contracts and quarantine."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import urls
from lodestone.functions.text import BLANKS, ColumnLike, as_column, collapse

SNIPPET_CHARS = 500
NOT_BLANK = "[^" + BLANKS[1:-2] + "]"


def no_repeats(ids: ColumnLike) -> Column:
    value = as_column(ids)
    return F.size(value) == F.size(F.array_distinct(value))


def overlap(left: ColumnLike, right: ColumnLike) -> Column:
    """ARR-01: ids present on both sides."""
    return F.array_intersect(as_column(left), as_column(right))


def scope_of(primary_ids: ColumnLike) -> Column:
    count = F.size(as_column(primary_ids))
    return (
        F.when(count == 1, F.lit("company_specific")).when(count >= 2, F.lit("multi_company"))
        .otherwise(F.lit("industry_common"))
    )


def snippet_of(text: ColumnLike) -> Column:
    return F.substring(collapse(text), 1, SNIPPET_CHARS)


def document_reason(doc: Mapping[str, str] | None = None) -> Column:
    """VAL-01 for documents: first broken rule, null when the row is sound."""
    url = F.col("source_url")
    return (
        F.when(F.coalesce(F.trim("document_id"), F.lit("")) == "", F.lit("missing_document_id"))
        .when(F.coalesce(F.trim("source_type"), F.lit("")) == "", F.lit("missing_source_type"))
        .when(F.col("title").isNull() | F.col("text").isNull(), F.lit("missing_text"))
        .when((F.size("primary_security_ids") == 0) & (F.size("mentioned_security_ids") == 0), F.lit("no_security"))
        .when(~no_repeats("primary_security_ids") | ~no_repeats("mentioned_security_ids"), F.lit("repeated_security"))
        .when(F.size(overlap("primary_security_ids", "mentioned_security_ids")) > 0, F.lit("overlapping_security"))
        .when(url.isNotNull() & ~url.rlike("^https?://"), F.lit("invalid_source_url"))
        .when(~F.col("text").rlike(NOT_BLANK), F.lit("blank_text"))
    )


def evidence_reason() -> Column:
    """VAL-01 for evidence: set rules and the scope / subject-count rule."""
    subjects = F.size("subject_security_ids")
    scope = F.col("scope")
    return (
        F.when(~no_repeats("subject_security_ids") | ~no_repeats("mentioned_security_ids"), F.lit("repeated_security"))
        .when(F.size(overlap("subject_security_ids", "mentioned_security_ids")) > 0, F.lit("overlapping_security"))
        .when(~scope.isin("company_specific", "multi_company", "industry_common"), F.lit("invalid_scope"))
        .when((scope == "company_specific") & (subjects != 1), F.lit("invalid_scope"))
        .when((scope == "industry_common") & (subjects != 0), F.lit("invalid_scope"))
        .when((scope == "multi_company") & (subjects < 2), F.lit("invalid_scope"))
        .when(F.col("source_url").isNotNull() & ~F.col("source_url").rlike("^https?://"), F.lit("invalid_source_url"))
    )


def unsafe_reason(*text_columns: str, url_column: str = "source_url") -> Column:
    """FLT-12: what makes a row unfit for public output, null when nothing does."""
    leak = F.lit(False)
    control = F.lit(False)
    for name in text_columns:
        leak = leak | F.coalesce(urls.leaks_local_path(name), F.lit(False))
        control = control | F.coalesce(F.col(name).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(False))
    url = F.col(url_column)
    return (
        F.when(leak, F.lit("local_path"))
        .when(control, F.lit("control_character"))
        .when(url.isNotNull() & urls.authority(url).contains("@"), F.lit("user_info"))
        .when(url.isNotNull() & urls.has_credential_key(url), F.lit("credential_key"))
    )


def forbidden_keys(payload: ColumnLike, keys: list[str] | None = None) -> Column:
    """FLT-12: keys of a map column that must not be published."""
    banned = F.array(*[F.lit(key) for key in (fixed.FORBIDDEN_PUBLIC_KEYS if keys is None else keys)])
    return F.array_intersect(F.transform(F.map_keys(as_column(payload)), lambda key: F.lower(key)), banned)


def to_evidence(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ-02: one evidence row per sound document, and the quarantined documents with their reason."""
    checked = documents.withColumn("reason", document_reason())
    extra = [name for name in ("doc_id",) if name in documents.columns]
    accepted = checked.where(F.col("reason").isNull()).select(
        *extra,
        F.concat(F.lit("evidence:"), "document_id").alias("evidence_id"),
        "document_id", "source_type", "title", "source_url", "published_at",
        F.col("primary_security_ids").alias("subject_security_ids"),
        "mentioned_security_ids",
        scope_of("primary_security_ids").alias("scope"),
        snippet_of("text").alias("snippet"),
    )
    return accepted, checked.where(F.col("reason").isNotNull())


def flatten_facts(documents: DataFrame, labels: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """PRJ-03: one evidence row per verified disclosure fact, and the rejected facts.

    ``documents`` carries ``facts: ARRAY<STRUCT<fact_id, category, claim, section_path, ...>>``.
    A repeated fact id inside its document is rejected along with blank ids and claims.
    """
    labels = fixed.CATEGORY_LABELS if labels is None else labels
    names = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    ids = F.transform("facts", lambda fact: fact["fact_id"])
    rows = documents.withColumn("fact_ids", ids).select("*", F.posexplode("facts").alias("fact_index", "fact"))
    label = F.try_element_at(names, F.col("fact.category"))
    fact_id, claim = F.trim(F.col("fact.fact_id")), F.col("fact.claim")
    reason = (
        F.when(F.coalesce(fact_id, F.lit("")) == "", F.lit("missing_fact_id"))
        .when(F.coalesce(snippet_of(claim), F.lit("")) == "", F.lit("missing_claim"))
        .when(F.size(F.filter("fact_ids", lambda one: one == F.col("fact.fact_id"))) > 1, F.lit("repeated_fact_id"))
    )
    path = F.col("fact.section_path")
    sound_path = F.coalesce((F.size(path) > 0) & F.forall(path, lambda p: F.trim(p) != ""), F.lit(False))
    flat = rows.select(
        F.concat_ws(":", F.lit("evidence"), "document_id", fact_id).alias("evidence_id"),
        "document_id", "source_type",
        F.when(label.isNotNull(), F.concat_ws(" · ", F.trim("title"), label)).otherwise(F.trim("title")).alias("title"),
        "source_url", "published_at",
        F.col("primary_security_ids").alias("subject_security_ids"), "mentioned_security_ids",
        scope_of("primary_security_ids").alias("scope"),
        snippet_of(claim).alias("snippet"),
        F.when(sound_path, F.concat_ws(" > ", F.transform(path, lambda p: F.trim(p)))).alias("section"),
        fact_id.alias("fact_id"), F.col("fact.category").alias("category"), "fact_index",
        reason.alias("reason"),
    )
    return flat.where(F.col("reason").isNull()).drop("reason"), flat.where(F.col("reason").isNotNull())


def prompt_projection(evidence: DataFrame) -> DataFrame:
    """PRJ-01: the fields that count towards the context budget."""
    return evidence.select(
        "evidence_id", "source_type", "title", "published_at", "subject_security_ids", "mentioned_security_ids",
        "scope", "snippet",
    )
