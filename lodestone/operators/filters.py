"""Hard filters of evidence against requests.

Requests with equal filters form one *filter set*. Candidates are produced per filter set, not
per request, so a popular filter does not multiply the evidence by its number of requests.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.functions.text import ColumnLike, as_column, contains_any, fold
from lodestone.operators.skew import hinted_join, is_small

FILTER_COLUMNS = ["security_id", "source_types", "start_day", "end_day", "as_of", "document_types"]


def as_of_match(instant: ColumnLike, as_of: ColumnLike) -> Column:
    """FLT-04: not after the cutoff; a missing time fails once a cutoff is set."""
    return as_column(as_of).isNull() | F.coalesce(as_column(instant) <= as_column(as_of), F.lit(False))


def day_range_match(instant: ColumnLike, start: ColumnLike, end: ColumnLike, zone: str = fixed.LOCAL_ZONE) -> Column:
    """FLT-05: inclusive local-day bounds; a missing time fails once a bound is set."""
    day = times.local_day(instant, zone)
    start, end = as_column(start), as_column(end)
    return (start.isNull() & end.isNull()) | F.coalesce(
        (start.isNull() | (day >= start)) & (end.isNull() | (day <= end)), F.lit(False)
    )


def type_match(values: Sequence[ColumnLike], wanted: ColumnLike) -> Column:
    """FLT-06: null accepts every type, an empty list accepts none."""
    wanted = as_column(wanted)
    shown = F.filter(F.array(*[as_column(v) for v in values]), lambda v: v.isNotNull() & (F.trim(v) != ""))
    return wanted.isNull() | F.coalesce(F.arrays_overlap(shown, wanted), F.lit(False))


def scope_match(target: ColumnLike, primary: ColumnLike | None = None, connected: Column | None = None) -> Column:
    """FLT-03: the evidence scope fits the target security."""
    target = as_column(target)
    subjects, mentioned, scope = F.col("subject_security_ids"), F.col("mentioned_security_ids"), F.col("scope")
    own_primary = F.lit(True) if primary is None else F.array_contains(as_column(primary), target)
    all_primary = F.lit(True) if primary is None else F.size(F.array_except(subjects, as_column(primary))) == 0
    related = F.array_contains(mentioned, target)
    if connected is not None:
        related = related | connected
    return (
        F.when(scope == "company_specific", (F.size(subjects) == 1) & (subjects[0] == target) & own_primary)
        .when(scope == "multi_company", F.array_contains(subjects, target) & all_primary)
        .when(scope == "industry_common", (F.size(subjects) == 0) & related)
        .otherwise(F.lit(False))
    )


def effective_time(evidence_time: ColumnLike, document_time: ColumnLike) -> Column:
    """FLT-07."""
    return F.coalesce(as_column(evidence_time), as_column(document_time))


def with_filter_sets(requests: DataFrame) -> DataFrame:
    """Add the id of the filter set each request belongs to."""
    packed = F.to_json(F.struct(*[F.col(name) for name in FILTER_COLUMNS]), {"ignoreNullFields": "false"})
    return requests.withColumn("filter_set", F.sha2(packed, 256))


def filter_sets(requests: DataFrame) -> DataFrame:
    return with_filter_sets(requests).select("filter_set", *FILTER_COLUMNS).dropDuplicates(["filter_set"])


def filter_documents(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """FLT-01: documents of each filter set (source, connected security, type, date)."""
    # JOI-02: set containment as an equi-join on the exploded ids (primary and mentioned do not overlap).
    linked = documents.withColumn(
        "security_id", F.explode(F.concat("primary_security_ids", "mentioned_security_ids"))
    )
    joined = hinted_join(linked, filter_sets(requests), ["security_id"], is_small(requests))
    return joined.where(
        F.array_contains("source_types", F.col("source_type"))
        & type_match(["document_type", "report_type", "content_level"], "document_types")
        & as_of_match("published_at", "as_of")
        & day_range_match("published_at", "start_day", "end_day")
    ).drop("source_types", "start_day", "end_day", "as_of", "document_types")


def link_documents(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """JOI-01: evidence with the document fields the filters read; orphans drop out."""
    linked = documents.select(
        "document_id",
        F.col("source_type").alias("document_source"),
        F.col("published_at").alias("document_time"),
        F.col("primary_security_ids").alias("document_primary"),
        F.concat("primary_security_ids", "mentioned_security_ids").alias("document_ids"),
        "document_type", "report_type", "content_level",
    )
    return evidence.join(linked, "document_id")


def orphans(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    return evidence.join(documents.select("document_id"), "document_id", "left_anti")


def reachable(linked: DataFrame) -> DataFrame:
    """Linked evidence that some request could get: one row per security that it is sound for, with its effective time."""
    ids = F.concat("subject_security_ids", "mentioned_security_ids")
    sound = linked.where(
        (F.col("source_type") == F.col("document_source"))
        & (F.size(F.array_except(ids, F.col("document_ids"))) == 0)
    ).withColumn("effective_at", effective_time("published_at", "document_time"))
    return sound.withColumn("security_id", F.explode(F.array_distinct("document_ids")))


def filter_linked(linked: DataFrame, requests: DataFrame, small: bool | None = None) -> DataFrame:
    """FLT-02 on evidence already linked to its documents."""
    small = is_small(requests) if small is None else small
    joined = hinted_join(reachable(linked), filter_sets(requests), ["security_id"], small)
    return joined.where(
        F.array_contains("source_types", F.col("source_type"))
        & scope_match("security_id", "document_primary", F.lit(True))
        & type_match(["document_type", "report_type", "content_level"], "document_types")
        & as_of_match("effective_at", "as_of")
        & day_range_match("effective_at", "start_day", "end_day")
    ).select("filter_set", "effective_at", *[c for c in linked.columns if not c.startswith("document_") or c == "document_id"])


def filter_evidence(evidence: DataFrame, requests: DataFrame, documents: DataFrame, small: bool | None = None) -> DataFrame:
    """FLT-02: evidence of each filter set, with link integrity, scope, type and date checks."""
    return filter_linked(link_documents(evidence, documents), requests, small)


def disclosure_text_match(wanted: ColumnLike, *fields: ColumnLike) -> Column:
    """FLT-08: blank query accepts all, else a folded substring of any field."""
    needle = F.coalesce(fold(wanted), F.lit(""))
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.coalesce(F.contains(fold(field), needle), F.lit(False))
    return (needle == "") | hit


def allow_external(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """FLT-09: report evidence only when its document allows external processing."""
    allowed = documents.where(F.col("external_allowed")).select("document_id", F.lit(True).alias("__allowed"))
    joined = evidence.join(allowed, "document_id", "left")
    return joined.where((F.col("source_type") != "research_report") | F.col("__allowed")).drop("__allowed")


def requested_sources(question: ColumnLike, markers: dict[str, list[str]] | None = None) -> Column:
    """Sources a question names, in fixed order."""
    markers = fixed.SOURCE_MARKERS if markers is None else markers
    folded = fold(question)
    return F.array_compact(
        F.array(*[F.when(contains_any(folded, words), F.lit(source)) for source, words in markers.items()])
    )


def keep_requested(evidence: DataFrame, questions: DataFrame, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """FLT-10: rows of the named sources, or all rows of a request when none of them match."""
    small = is_small(questions)
    named = questions.select("request_id", requested_sources("question", markers).alias("__named"))
    marked = hinted_join(evidence, named, ["request_id"], small).withColumn(
        "__match", F.array_contains("__named", F.col("source_type"))
    )
    any_match = marked.groupBy("request_id").agg(F.max("__match").alias("__any"))
    return hinted_join(marked, any_match, ["request_id"], small).where(F.col("__match") | ~F.col("__any")).drop(
        "__named", "__match", "__any"
    )


def focus_match(
    snippet: ColumnLike, focus: ColumnLike, calm: Sequence[str] | None = None, risky: Sequence[str] | None = None,
    folding: Callable[[ColumnLike], Column] = fold,
) -> Column:
    """FLT-14: under the risk focus a snippet must speak of risk and not play it down; words are sought in the snippet after ``folding``."""
    folded = folding(snippet)
    calm = fixed.CALM_RISK_PHRASES if calm is None else calm
    risky = fixed.RISK_WORDS if risky is None else risky
    return (as_column(focus) != "risk") | (~contains_any(folded, calm) & contains_any(folded, risky))


def comparable_terms(text: ColumnLike, generic: Sequence[str] | None = None, pattern: str = fixed.EVENT_LABEL_TOKEN) -> Column:
    generic = fixed.EVENT_LABEL_GENERIC if generic is None else generic
    words = F.transform(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(0)), lambda w: F.lower(w))
    stop = F.array(*[F.lit(word) for word in generic]) if generic else F.array().cast("array<string>")
    return F.array_except(F.filter(words, lambda w: ~w.rlike(r"^\d+$")), stop)


def relevant_to_event(query: ColumnLike, label: ColumnLike, generic: Sequence[str] | None = None) -> Column:
    """FLT-15: query and event label share a term that is neither generic nor a number."""
    return F.arrays_overlap(comparable_terms(query, generic), comparable_terms(label, generic))
