"""Ordering, caps and context budgets over ranked evidence.

Every limit is a ``row_number() <= k``, which Spark applies before the shuffle; after the caps a
request holds at most ten rows, so the prefix windows are tiny whatever the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column, contains_any, fold
from lodestone.operators.skew import hinted_join, is_small, keep_first, top_rows
from lodestone.session import cut_lineage

LAST = 1_000_000


def source_place(required: ColumnLike, source_type: ColumnLike, is_first: Column) -> Column:
    """Position of a source in the required list for its first row, else after all of them."""
    place = F.nullif(F.array_position(as_column(required), as_column(source_type)), F.lit(0))
    return F.when(is_first, F.coalesce(place, F.lit(LAST))).otherwise(F.lit(LAST))


def leading_rows(rows: DataFrame, order: list[Column], k: int, key: str = "request_id") -> DataFrame:
    """The rows that can appear among the first ``k`` after source diversification.

    Those are among the first ``k`` of their own source, so one map-side limit is enough;
    ``source_rank`` 1 marks the first row of a source.
    """
    return top_rows(rows, [key, "source_type"], order, k, "source_rank")


def diversify(rows: DataFrame, order: list[Column], k: int, required: str = "required_sources", key: str = "request_id") -> DataFrame:
    """WIN-06: first row of each required source in required order, then the rest by rank."""
    place = source_place(required, "source_type", F.col("source_rank") == 1)
    return top_rows(leading_rows(rows, order, k, key), [key], [place, *order], k, "place").drop("source_rank")


def cap_per_source(rows: DataFrame, order: list[Column], cap: int = fixed.BUDGET_PER_SOURCE, key: str = "request_id") -> DataFrame:
    """WIN-03."""
    return top_rows(rows, [key, "source_type"], order, cap)


def cap_total(rows: DataFrame, order: list[Column], cap: int = fixed.BUDGET_MAX_ROWS, key: str = "request_id") -> DataFrame:
    """WIN-04."""
    return top_rows(rows, [key], order, cap)


def conflicting_ids(rows: DataFrame, id_column: str, payload: Column) -> DataFrame:
    """WIN-08: ids that occur with different payloads."""
    return (
        rows.groupBy(id_column).agg(F.min(payload).alias("low"), F.max(payload).alias("high"))
        .where(F.col("low") != F.col("high")).select(id_column)
    )


def timestamp_text(instant: ColumnLike) -> Column:
    """ISO text of a UTC instant, fractions only when present."""
    value = as_column(instant)
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def projection_json() -> Column:
    """Compact JSON of the budgeted fields in fixed order, nulls kept."""
    return F.to_json(
        F.struct(
            "evidence_id", "source_type", "title", timestamp_text("published_at").alias("published_at"),
            "subject_security_ids", "mentioned_security_ids", "scope", "snippet",
        ),
        {"ignoreNullFields": "false"},
    )


def token_estimate(octets: ColumnLike) -> Column:
    """MTH-01: one token per three bytes, rounded up."""
    return F.floor((as_column(octets) + 2) / 3).cast("bigint")


def fitting_prefix(
    rows: DataFrame, order: list[Column], payload: Column, max_chars: int, max_tokens: int, reserved: int = 0, key: str = "request_id"
) -> DataFrame:
    """WIN-05: the longest prefix whose JSON array fits both limits (lengths only grow along it)."""
    spec = Window.partitionBy(key).orderBy(*order)
    running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # n elements add n - 1 commas and two brackets.
    overhead = F.count(F.lit(1)).over(running) + 1
    sized = (
        rows.withColumn("__json", payload)
        .withColumn("prefix_chars", F.sum(F.char_length("__json")).over(running) + overhead)
        .withColumn("prefix_bytes", F.sum(F.octet_length("__json")).over(running) + overhead)
        .drop("__json")
    )
    return sized.where(
        (F.col("prefix_chars") <= max_chars) & (F.lit(reserved) + token_estimate("prefix_bytes") <= max_tokens)
    )


LOCATOR_FIELDS = [
    "provider", "locator_url", "locator_time", "raw_index", "receipt_no", "manifest_id", "entry_id", "version", "section", "page_basis", "page",
    "locator_document_id", "source_asset_id",
]


LOCATED = (
    "document_id", "source_type", "title", "source_url", "published_at", "subject_security_ids", "mentioned_security_ids", "scope", "snippet",
)


def content_digest(columns: list[str]) -> Column:
    """Digest of all fields of an evidence but its id and score, locator fields among them where ``columns`` has these."""
    locator = [name for name in LOCATOR_FIELDS if name in columns]
    return F.sha2(F.to_json(F.struct(*LOCATED, *locator), {"ignoreNullFields": "false"}), 256)


def conflicting_evidence(rows: DataFrame) -> DataFrame:
    """request_id and evidence_id of evidence that comes with different contents in one request (WIN-08 within CMP-04)."""
    named = rows.withColumn("__content", content_digest(rows.columns)).groupBy("request_id", "evidence_id")
    return named.agg(F.min("__content").alias("low"), F.max("__content").alias("high")).where("low <> high").select("request_id", "evidence_id")


def budget_context(
    rows: DataFrame, requests: DataFrame, max_rows: int = fixed.BUDGET_MAX_ROWS, per_source: int = fixed.BUDGET_PER_SOURCE,
    max_chars: int = fixed.BUDGET_MAX_CHARS, max_tokens: int = fixed.BUDGET_MAX_TOKENS, reserved: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """CMP-04: content dedup, diversify, per-source cap, total cap, budget prefix; plus the drop counts.

    ``rows`` carries ``request_id``, ``position`` and the evidence fields. Rows are copies when all
    fields but id and score agree, locator fields among them where ``rows`` has these. A request in
    which one id has two contents fails closed: nothing is selected for it and it has no diagnostics
    row; ``conflicting_evidence`` names the ids.
    """
    # A request's hits are few and are read several times below.
    rows = cut_lineage(rows)
    broken = conflicting_evidence(rows).select("request_id").distinct()
    rows = rows.join(broken, "request_id", "left_anti").withColumn("__content", content_digest(rows.columns))
    order = [F.col("position"), F.col("evidence_id")]
    unique = keep_first(rows, ["request_id", "__content"], order).drop("__content")
    # Inside one source the priority order is the input order, so the source cap needs no reordering.
    capped = cap_per_source(unique, order, per_source)
    required = requests.select("request_id", F.coalesce("required_sources", F.array().cast("array<string>")).alias("__required"))
    by_source = Window.partitionBy("request_id", "source_type").orderBy(*order)
    placed = hinted_join(capped, required, ["request_id"], is_small(requests)).withColumn(
        "__place", source_place("__required", "source_type", F.row_number().over(by_source) == 1)
    )
    final = [F.col("__place"), *order]
    limited = cap_total(placed, final, max_rows)
    selected = fitting_prefix(limited, final, projection_json(), max_chars, max_tokens, reserved).withColumn(
        "place", F.row_number().over(Window.partitionBy("request_id").orderBy(*final))
    ).drop("__place", "__required")

    counts = rows.groupBy("request_id").agg(F.count(F.lit(1)).alias("input_count"))
    per = unique.groupBy("request_id", "source_type").agg(F.count(F.lit(1)).alias("n"))
    stage = per.groupBy("request_id").agg(
        F.sum("n").alias("unique_count"), F.sum(F.least("n", F.lit(per_source))).alias("capped_count")
    )
    chosen = selected.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("selected_count"), F.max("prefix_chars").alias("estimated_chars"),
        token_estimate(F.max("prefix_bytes")).alias("estimated_tokens"),
    )
    zero = F.lit(0).cast("bigint")
    joined = counts.join(stage, "request_id").join(chosen, "request_id", "left")
    after_total = F.least("capped_count", F.lit(max_rows)).cast("bigint")
    picked = F.coalesce("selected_count", zero)
    diagnostics = joined.select(
        "request_id", "input_count", "unique_count",
        (F.col("input_count") - F.col("unique_count")).alias("duplicate_drop_count"),
        (F.col("unique_count") - F.col("capped_count")).alias("source_cap_drop_count"),
        (F.col("capped_count") - after_total).alias("count_cap_drop_count"),
        (after_total - picked).alias("context_drop_count"),
        picked.alias("selected_count"),
        (F.lit(reserved) + F.coalesce("estimated_tokens", zero)).alias("estimated_context_tokens"),
        F.coalesce("estimated_chars", zero).alias("estimated_evidence_chars"),
        ((after_total > 0) & (picked == 0)).alias("budget_exhausted"),
    )
    return selected, diagnostics


def is_reconciled() -> Column:
    """Identity that every diagnostics row must satisfy."""
    drops = ["duplicate_drop_count", "source_cap_drop_count", "count_cap_drop_count", "context_drop_count", "selected_count"]
    return F.col("input_count") == sum((F.col(name) for name in drops[1:]), F.col(drops[0]))


def answer_limit(question: ColumnLike, intent: ColumnLike, focus: ColumnLike) -> Column:
    """TOP-06: how many evidences an answer shows, from its wording and focus."""
    folded, focus = fold(question), as_column(focus)
    limit = (
        F.when((focus == "disclosure") & contains_any(folded, fixed.SHORT_DISCLOSURE_MARKERS), F.lit(2))
        .when((as_column(intent) == "research_report_summary") & contains_any(folded, fixed.EASY_MARKERS), F.lit(2))
        .when(contains_any(folded, fixed.SHORT_MARKERS), F.lit(3))
    )
    for name, rows in fixed.FOCUS_LIMITS.items():
        limit = limit.when(focus == name, F.lit(rows))
    return limit.otherwise(F.lit(6))


def prioritize(rows: DataFrame, limit: ColumnLike = "answer_limit") -> DataFrame:
    """TOP-06: category order for disclosures, overview-first for reports, input order otherwise."""
    categories = F.create_map(*[F.lit(part) for pair in fixed.CATEGORY_PRIORITY.items() for part in pair])
    category = F.coalesce(F.try_element_at(categories, F.col("category")), F.lit(fixed.OTHER_CATEGORY_PRIORITY))
    overview = F.when(contains_any("snippet", fixed.OVERVIEW_MARKERS), F.lit(0)).otherwise(F.lit(1))
    numbers = F.regexp_count(F.col("snippet"), F.lit(r"\d+(?:\.\d+)?"))
    is_disclosure = F.col("answer_focus") == "disclosure"
    is_report = ~is_disclosure & (F.col("intent") == "research_report_summary")
    key = F.struct(
        F.when(is_disclosure, category).when(is_report, overview).otherwise(F.lit(0)).alias("first"),
        F.when(is_report, numbers).otherwise(F.lit(0)).alias("second"),
        F.col("position").alias("third"),
    )
    ranked = top_rows(rows, ["request_id"], [key], 6, "answer_rank")
    return ranked.where(F.col("answer_rank") <= as_column(limit))


def prefix_text(rows: DataFrame, key: str, order: list[Column], piece: str, max_chars: int = fixed.MEMORY_CHARS) -> DataFrame:
    """WIN-15: pieces joined by newlines up to ``max_chars``, the crossing piece cut.

    Every piece but the first costs at least two characters with its newline, so the pieces that can
    fit are few and are cut out before the shuffle.
    """
    head = top_rows(rows.where(F.length(piece) > 0), [key], order, (max_chars + 1) // 2, "__rank")
    running = Window.partitionBy(key).orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.length(piece) + F.when(F.col("__rank") == 1, F.lit(0)).otherwise(F.lit(1))).over(running)
    sized = head.withColumn("__used", used).withColumn(
        "__room", F.lit(max_chars) - F.col("__used") + F.length(piece)
    ).where(F.col("__room") > 0)
    cut = F.substring(F.col(piece), F.lit(1), F.least(F.col("__room"), F.length(piece)).cast("int"))
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__rank", cut.alias("text")))).alias("parts"))
    return listed.select(key, F.concat_ws("\n", F.transform("parts", lambda p: p["text"])).alias("memory_text"))


def recent_exchanges(exchanges: DataFrame, keep: int = fixed.KEPT_EXCHANGES, key: str = "session_id") -> DataFrame:
    """WIN-10: the last ``keep`` exchanges of a session with their revision number."""
    totals = exchanges.groupBy(key).agg(F.count(F.lit(1)).alias("__total"))
    last = top_rows(exchanges, [key], [F.col("ts").desc(), F.col("exchange_id").desc()], keep, "recency")
    return last.join(totals, key).withColumn("revision", F.col("__total") - F.col("recency") + 1).drop("__total")


def conversation_context(
    exchanges: DataFrame, max_exchanges: int = fixed.CONTEXT_EXCHANGES, max_chars: int = fixed.CONTEXT_CHARS, key: str = "session_id"
) -> DataFrame:
    """WIN-09: newest exchanges first under a character budget, the newest cut when it alone is too long."""
    last = top_rows(exchanges, [key], [F.col("ts").desc(), F.col("exchange_id").desc()], max_exchanges, "recency")
    block = F.concat(F.lit("User: "), "user_text", F.lit("\nAssistant: "), "assistant_text")
    running = Window.partitionBy(key).orderBy("recency").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = last.withColumn("block", block).withColumn("used", F.sum(F.length("block")).over(running))
    kept = sized.where((F.col("recency") == 1) | (F.col("used") <= max_chars))
    cut = F.substring("block", 1, max_chars)
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("at"), cut.alias("text")))).alias("parts"))
    return listed.select(key, F.concat_ws("\n\n", F.transform("parts", lambda p: p["text"])).alias("context"))
