"""Row contracts, cross-row integrity and set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column, contains_any, fold


def ordered_subsequence(outputs: DataFrame, inputs: DataFrame, key: str, item: str) -> DataFrame:
    """SET-07: per key, whether the output items stand in input order."""
    placed = outputs.join(inputs, [key, item], "left")
    spec = Window.partitionBy(key).orderBy("output_position")
    ok = F.coalesce(F.col("input_position") > F.lag("input_position").over(spec), F.col("input_position").isNotNull())
    return placed.select(key, ok.alias("ok")).groupBy(key).agg(F.bool_and("ok").alias("ordered"))


def foreign_rows(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """SET-06: number of output rows, with multiplicity, that the input does not contain."""
    return outputs.exceptAll(inputs.select(*outputs.columns)).agg(F.count(F.lit(1)).alias("foreign_rows"))


def matrix_difference(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """SET-04: rows missing from or surplus to the expected matrix."""
    columns = expected.columns
    observed = observed.select(*columns)
    return expected.exceptAll(observed).withColumn("problem", F.lit("missing")).unionByName(
        observed.exceptAll(expected).withColumn("problem", F.lit("surplus"))
    )


def missing_categories(facts: DataFrame, key: str, required: Sequence[str] | None = None) -> DataFrame:
    """SET-05: required categories a document lacks."""
    wanted = F.array(*[F.lit(name) for name in (fixed.REQUIRED_FACT_CATEGORIES if required is None else required)])
    # The collected set is bounded by the category vocabulary and combines on the map side.
    seen = facts.groupBy(key).agg(F.collect_set(F.when(F.array_contains(wanted, F.col("category")), F.col("category"))).alias("seen"))
    return seen.select(key, F.array_sort(F.array_except(wanted, F.col("seen"))).alias("missing"))


def permission_reason(status: ColumnLike, ingest_allowed: ColumnLike, external_allowed: ColumnLike) -> Column:
    """VAL-04: unapproved rows stay closed; external use needs approved ingest."""
    status, ingest, external = as_column(status), as_column(ingest_allowed), as_column(external_allowed)
    return (
        F.when(status.isin("synthetic", "pending", "rejected") & (ingest | external), F.lit("unapproved_open"))
        .when(external & ((status != "approved") | ~ingest), F.lit("external_without_approval"))
    )


def market_reason(rows: Mapping[str, str] | None = None) -> Column:
    """VAL-05: price invariants of a snapshot row, exact decimals with a fixed tolerance."""
    price, previous, change, percent = (F.col(name) for name in ("price", "previous_close", "change", "change_percent"))
    tolerance = F.lit(fixed.PRICE_TOLERANCE).cast("decimal(18,6)")
    local_day = F.to_date(F.from_utc_timestamp("observed_at", fixed.LOCAL_ZONE))
    return (
        F.when(F.col("currency") != "KRW", F.lit("currency"))
        .when((price <= 0) | (previous <= 0), F.lit("not_positive"))
        .when(F.abs(change - (price - previous)) > tolerance, F.lit("change"))
        .when(F.abs(percent - F.try_divide(change, previous) * 100) > tolerance, F.lit("change_percent"))
        .when(local_day != F.col("trading_date"), F.lit("trading_date"))
        .when(F.col("volume") < 0, F.lit("volume"))
    )


def observation_reason() -> Column:
    """VAL-06: allowed values and the routing / classifier combinations of a request observation."""
    routing, classifier = F.col("intent_routing"), F.col("intent_classifier_status")
    token = r"^[A-Za-z0-9_.:-]{1,128}$"
    statuses = F.map_values("provider_statuses")
    allowed = F.array(*[F.lit(status) for status in fixed.PROVIDER_STATUSES])
    return (
        F.when(~F.col("request_id").rlike(token), F.lit("request_id"))
        .when(~F.col("intent").rlike(token), F.lit("intent"))
        .when(F.col("security_id").isNotNull() & ~F.col("security_id").rlike(token), F.lit("security_id"))
        .when(F.size(F.array_except(statuses, allowed)) > 0, F.lit("provider_status"))
        .when(F.col("evidence_count") < 0, F.lit("evidence_count"))
        .when(~F.col("evidence_decision").isin(fixed.DECISION_STATUSES), F.lit("evidence_decision"))
        .when(F.isnan("total_latency_ms") | (F.col("total_latency_ms") < 0) | (F.col("total_latency_ms") == float("inf")), F.lit("latency"))
        .when(~F.col("llm_call_count").between(0, 2), F.lit("llm_call_count"))
        .when(~routing.isin(fixed.ROUTING_MODES), F.lit("intent_routing"))
        .when(
            ~classifier.isin(fixed.CLASSIFIER_STATUSES)
            | (routing.isin("deterministic", "cached") & (classifier != "not_called"))
            | ((routing == "hybrid_llm") & (classifier != "accepted"))
            | ((routing == "hybrid_fallback") & classifier.isin("not_called", "accepted")),
            F.lit("intent_classifier_status"),
        )
    )


def snapshot_reason(basis_at: Column) -> Column:
    """VAL-07: a corpus row must be attributed to one security, timed, not after the basis and typed by source."""
    source = F.col("source_type")
    return (
        F.when((F.size("primary_security_ids") != 1) | (F.size("mentioned_security_ids") != 0), F.lit("attribution"))
        .when(~source.isin("news", "disclosure", "research_report"), F.lit("source_type"))
        .when(F.col("published_at").isNull(), F.lit("missing_time"))
        .when(F.col("published_at") > basis_at, F.lit("after_basis"))
        .when((F.trim("title") == "") | (F.length("title") > 300), F.lit("title"))
        .when((source == "news") & (F.coalesce(F.col("document_type"), F.lit("")) == ""), F.lit("news_type"))
        .when((source == "research_report") & F.col("external_allowed"), F.lit("report_permission"))
        .when(F.col("source_url").isNull() | ~F.col("source_url").rlike("^https?://"), F.lit("source_url"))
    )


def provenance_reason() -> Column:
    """VAL-11: required reference fields; reference URL equals source URL; receipt, id and viewer URL agree."""
    receipt = F.col("receipt_no")
    viewer = F.concat(F.lit(fixed.DISCLOSURE_VIEWER), receipt)
    required = ["reference_title", "reference_publisher", "reference_url", "reference_published_at"]
    blank = F.lit(False)
    for name in required:
        blank = blank | (F.coalesce(F.trim(name), F.lit("")) == "")
    disclosure = F.col("source_type") == "disclosure"
    return (
        F.when(blank, F.lit("missing_reference"))
        .when(F.col("reference_url") != F.col("source_url"), F.lit("reference_url"))
        .when(F.try_to_timestamp("reference_published_at", F.lit("yyyy-MM-dd")).isNull(), F.lit("reference_date"))
        .when(disclosure & ~F.coalesce(receipt.rlike(r"^\d{14}$"), F.lit(False)), F.lit("receipt"))
        .when(disclosure & (F.col("document_id") != F.concat(F.lit("disclosure:"), receipt)), F.lit("document_id"))
        .when(disclosure & (F.col("source_url") != viewer), F.lit("viewer_url"))
    )


def overclaims(text: ColumnLike, phrases: Sequence[str] | None = None) -> Column:
    """VAL-08."""
    return contains_any(fold(text), fixed.OVERCLAIM_PHRASES if phrases is None else phrases)


def colliding_keys(keys: DataFrame, key: str = "lookup_key", owner: str = "owner") -> DataFrame:
    """VAL-02 / VAL-03: lookup keys claimed by more than one owner."""
    # Lowest and highest owner decide, so a hot key never gathers its owners.
    return (
        keys.groupBy(key).agg(F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"), F.count(F.lit(1)).alias("claims"))
        .where(F.col("first_owner") != F.col("last_owner"))
    )


def dangling_references(entries: DataFrame, entry_id: str, related: str) -> DataFrame:
    """JOI-19: related ids that are the entry itself, repeated, or unknown."""
    edges = entries.select(
        entry_id, F.explode(F.transform(F.array_distinct(related), lambda r: F.struct(
            r.alias("related_id"), (F.size(F.filter(F.col(related), lambda o: o == r)) > 1).alias("repeated")
        ))).alias("edge")
    ).select(entry_id, "edge.*")
    known = entries.select(F.col(entry_id).alias("related_id"), F.lit(True).alias("known")).distinct()
    joined = edges.join(known, "related_id", "left")
    reason = (
        F.when(F.col("related_id") == F.col(entry_id), F.lit("self"))
        .when(F.col("repeated"), F.lit("repeated")).when(F.col("known").isNull(), F.lit("dangling"))
    )
    return joined.select(entry_id, "related_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def reconcile(listed: DataFrame, present: DataFrame, key: str, order: str) -> DataFrame:
    """SRC-07 / JOI-18: ids listed in a manifest against ids present, with positions; only problems."""
    left = listed.groupBy(key).agg(F.count(F.lit(1)).alias("listed_times"), F.min(order).alias("listed_at"))
    right = present.groupBy(key).agg(F.count(F.lit(1)).alias("present_times"), F.min(order).alias("present_at"))
    both = left.join(right, key, "full_outer")
    problem = (
        F.when(F.col("present_times").isNull(), F.lit("missing")).when(F.col("listed_times").isNull(), F.lit("unlisted"))
        .when((F.col("listed_times") > 1) | (F.col("present_times") > 1), F.lit("repeated"))
        .when(F.col("listed_at") != F.col("present_at"), F.lit("out_of_order"))
    )
    return both.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def recomputation_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """VAL-10: stored rows that a recomputation does not give, and the other way round."""
    columns = stored.columns
    again = recomputed.select(*columns)
    return stored.exceptAll(again).withColumn("side", F.lit("stored_only")).unionByName(
        again.exceptAll(stored).withColumn("side", F.lit("recomputed_only"))
    )
