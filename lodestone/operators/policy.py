"""Source status and the evidence decision per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column

FAILED = ["invalid_query", "unauthorized", "rate_limited", "timeout", "provider_unavailable", "parse_error"]


def intent_table() -> tuple[Column, Column]:
    """Literal maps intent -> required sources and intent -> required evidence."""
    sources, needs = [], []
    for name, (source_types, evidence, _) in fixed.INTENT_MATRIX.items():
        sources += [F.lit(name), F.array(*[F.lit(s) for s in source_types]).cast("array<string>")]
        needs += [F.lit(name), F.array(*[F.lit(e) for e in evidence]).cast("array<string>")]
    return F.create_map(*sources), F.create_map(*needs)


def required_sources(intent: ColumnLike) -> Column:
    return F.try_element_at(intent_table()[0], as_column(intent))


def map_status(code: ColumnLike) -> Column:
    """SRC-03: provider code to status; unknown codes are unavailable, a missing one is a parse error."""
    table = F.create_map(*[F.lit(part) for pair in fixed.STATUS_CODES.items() for part in pair])
    code = as_column(code)
    return F.when(code.isNull(), F.lit("parse_error")).otherwise(
        F.coalesce(F.try_element_at(table, code), F.lit("provider_unavailable"))
    )


def source_status(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """SRC-11: per request and required source, ``ok`` with rows and ``no_data`` without.

    ``rows`` has the request key ``request_id`` and ``source_type``.
    """
    wanted = requests.select("request_id", F.explode("source_types").alias("source_type"))
    counts = rows.groupBy("request_id", "source_type").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, ["request_id", "source_type"], "left").select(
        "request_id", "source_type", F.coalesce("n", F.lit(0)).alias("document_count"),
        F.when(F.col("n") > 0, F.lit("ok")).otherwise(F.lit("no_data")).alias("status"),
    )


def coverage(required: ColumnLike, returned: ColumnLike) -> tuple[Column, Column]:
    """SET-03: satisfied and missing sources in plan order."""
    required, returned = as_column(required), as_column(returned)
    return F.array_intersect(required, returned), F.array_except(required, returned)


def decide(requests: DataFrame, statuses: DataFrame, warnings: DataFrame, hits: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """CMP-03: complete, partial, no_evidence, provider_failed or blocked.

    ``requests``: request_id, intent, required_sources, requires_clarification. ``statuses`` and
    ``hits`` are rows by source, ``warnings`` rows by source and code, ``diagnostics`` the retrieval status.
    """
    sources = F.array_sort(F.collect_set("source_type"))
    returned = hits.groupBy("request_id").agg(sources.alias("returned"))
    by_status = statuses.groupBy("request_id").agg(
        F.collect_set(F.when(F.col("status") == "no_data", F.col("source_type"))).alias("without_data"),
        F.collect_set(F.when(F.col("status").isin(FAILED), F.col("source_type"))).alias("failing"),
    )
    limiting = warnings.where(F.col("code").isin(fixed.LIMITING_WARNINGS)).groupBy("request_id").agg(sources.alias("limited"))
    empty = F.array().cast("array<string>")
    rows = (
        requests.join(diagnostics.select("request_id", F.col("status").alias("retrieval")), "request_id", "left")
        .join(returned, "request_id", "left").join(by_status, "request_id", "left").join(limiting, "request_id", "left")
        .select(
            "request_id", "intent", "required_sources", "requires_clarification", "retrieval",
            *[F.coalesce(name, empty).alias(name) for name in ("returned", "without_data", "failing", "limited")],
        )
    )
    covered = F.col("required_sources")
    for intent, names in fixed.COVERAGE_SOURCES.items():
        covered = F.when(F.col("intent") == intent, F.array(*[F.lit(name) for name in names])).otherwise(covered)
    rows = rows.withColumn("covered", covered).select(
        "*", F.array_intersect("required_sources", "returned").alias("satisfied_sources"),
        F.array_except("covered", "returned").alias("missing_sources"),
        F.array_intersect("covered", "without_data").alias("no_data_sources"),
        F.array_intersect("covered", "failing").alias("failed_sources"),
        F.arrays_overlap("covered", "limited").alias("limited_coverage"),
    )
    gaps = (
        (F.size("missing_sources") > 0) | (F.size("no_data_sources") > 0) | (F.size("failed_sources") > 0) | F.col("limited_coverage")
    )
    status = (
        F.when(F.col("requires_clarification"), F.when(F.col("intent") == "prohibited_advice", F.lit("blocked")).otherwise(F.lit("no_evidence")))
        .when(F.coalesce(F.col("retrieval"), F.lit("empty")) != "ok",
              F.when(F.size("failed_sources") > 0, F.lit("provider_failed")).otherwise(F.lit("no_evidence")))
        .when(gaps, F.lit("partial")).otherwise(F.lit("complete"))
    )
    return rows.select(
        "request_id", status.alias("status"), "satisfied_sources", "missing_sources", "no_data_sources", "failed_sources", "limited_coverage"
    )


def health(statuses: DataFrame, key: str = "request_id") -> DataFrame:
    """AGG-25: ok, degraded or error from per-source rows with expected counts."""
    good = (F.col("status") == "ok") & (F.col("document_count") == F.col("expected_count"))
    return statuses.groupBy(key).agg(F.bool_and(good).alias("all_good"), F.bool_or(good).alias("any_good")).select(
        key, F.when(F.col("all_good"), F.lit("ok")).when(F.col("any_good"), F.lit("degraded")).otherwise(F.lit("error")).alias("health")
    )
