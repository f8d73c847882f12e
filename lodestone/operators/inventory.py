"""Feed, disclosure and report inventories: normalize, reject with a reason, merge duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import hashing, times, urls
from lodestone.functions.text import as_column, clean_tags_first, contains_any, count_contained, first_offset, fold_case, let
from lodestone.operators import topics
from lodestone.operators.dedup import two_key_dedup
from lodestone.operators.skew import keep_first, spread_join, top_rows


Names = Mapping[str, Sequence[str]]


def _with_names(rows: DataFrame, **columns: Names | None) -> DataFrame:
    """``rows`` with an array column of case-folded names for their security, one per mapping; joined, so their number does not grow the plan."""
    for column, names in columns.items():
        listed = [(security, [name.casefold() for name in some]) for security, some in (names or {}).items()]
        table = rows.sparkSession.createDataFrame(listed, f"security_id string, `{column}` array<string>")
        rows = spread_join(rows, table, ["security_id"], "left")
    return rows


def _has_name(folded: Column, names: str) -> Column:
    return let(folded, lambda text: F.coalesce(F.exists(F.col(names), lambda name: F.contains(text, name)), F.lit(False)))


def _name_offset(folded: Column, names: str) -> Column:
    """Smallest 0-based offset of any of the names, null when none occurs."""
    return let(folded, lambda text: F.array_min(F.filter(F.transform(F.col(names), lambda name: F.position(name, text) - 1), lambda at: at >= 0)))


def match_basis(
    rows: DataFrame, title_aliases: Names, description_aliases: Names | None = None, topical: Names | None = None,
    max_offset: int = fixed.DESCRIPTION_ALIAS_MAX_OFFSET, entities: Mapping[str, str] | None = None,
) -> DataFrame:
    """CMP-12: ``match_basis`` of rows with security_id, title and description.

    A title alias; else an early description alias with a topical title, where a security allows it.
    Without description aliases or topics no description is read.
    """
    title = fold_case(F.col("title"))
    if not description_aliases or not topical:
        named = _with_names(rows, __aliases=title_aliases)
        return named.withColumn("match_basis", F.when(_has_name(title, "__aliases"), F.lit("title_alias"))).drop("__aliases")
    named = _with_names(rows, __aliases=title_aliases, __early=description_aliases, __topics=topical)
    description = fold_case(clean_tags_first("description", entities))
    early = F.coalesce(_name_offset(description, "__early") <= max_offset, F.lit(False)) & _has_name(title, "__topics")
    basis = F.when(_has_name(title, "__aliases"), F.lit("title_alias")).when(early, F.lit("provider_description_alias"))
    return named.withColumn("match_basis", basis).drop("__aliases", "__early", "__topics")


def merge_duplicates(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """AGG-14: keep the first row, unite provenance, and let a title match win.

    Provenance is made distinct before it is listed, so a hot URL lists each origin once.
    """
    first = keep_first(rows, keys, [F.col(order)])
    origins = rows.select(*keys, F.explode("provenance").alias("origin")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("origin")).alias("provenance")
    )
    basis = rows.groupBy(*keys).agg(
        F.max(F.col("match_basis") == "title_alias").alias("by_title"), F.count(F.lit(1)).alias("copies")
    )
    return first.drop("provenance").join(origins, list(keys)).join(basis, list(keys)).withColumn(
        "match_basis", F.when(F.col("by_title"), F.lit("title_alias")).otherwise(F.col("match_basis"))
    ).drop("by_title")


def news_inventory(
    raw: DataFrame, title_aliases: Mapping[str, Sequence[str]], start: str, end: str,
    description_aliases: Mapping[str, Sequence[str]] | None = None, topical: Mapping[str, Sequence[str]] | None = None,
    entities: Mapping[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """CMP-11: inventory items and rejection counts. ``entities`` are decoded, all of HTML 5 by default.

    ``raw``: security_id, title, description, pub_date, originallink, link, provenance (array), ord.
    """
    parsed = raw.withColumn("title", clean_tags_first("title", entities)).withColumn("published_at", times.parse_feed_time("pub_date")).withColumn(
        "canonical_url", urls.canonical_url("originallink", "link")
    )
    in_window = F.col("published_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    reason = (
        F.when((F.coalesce("title", F.lit("")) == "") | F.col("published_at").isNull() | F.col("canonical_url").isNull(), F.lit("invalid_metadata"))
        .when(~in_window, F.lit("outside_window")).when(F.col("match_basis").isNull(), F.lit("security_not_established"))
    )
    judged = match_basis(parsed, title_aliases, description_aliases, topical, entities=entities).withColumn("reason", reason)
    sound = judged.where(F.col("reason").isNull()).drop("reason")
    merged = merge_duplicates(sound, ["security_id", "canonical_url"], "ord")
    items = merged.select(
        hashing.stable_id("news", "security_id", "canonical_url").alias("news_id"), "security_id", "title",
        urls.publisher_host("canonical_url").alias("publisher_host"), "published_at", "canonical_url", "match_basis", "provenance", "copies",
    )
    rejected = judged.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    totals = merged.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("copies"), F.lit(0)).alias("seen")).select(
        F.explode(F.array(
            F.struct(F.lit("retained").alias("reason"), F.col("kept").alias("n")),
            F.struct(F.lit("exact_url_duplicate").alias("reason"), (F.col("seen") - F.col("kept")).alias("n")),
        )).alias("row")
    ).select("row.*").where((F.col("n") > 0) | (F.col("reason") == "retained"))
    return items, rejected.unionByName(totals)


def disclosure_inventory(raw: DataFrame, registry: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """CMP-13: disclosure items and quarantined rows with their reason.

    ``raw``: security_id, receipt_no, corp_code, stock_code, corp_name, report_name, submitter, received, remark, ord.
    ``registry``: security_id, expected_corp, expected_stock, expected_name.
    """
    joined = raw.join(registry, "security_id", "left").withColumn("submitted_date", times.parse_compact_day("received"))
    rules = (
        F.when(~F.coalesce(F.col("receipt_no").rlike(r"^\d{14}$"), F.lit(False)), F.lit("receipt"))
        .when(F.col("expected_corp").isNull(), F.lit("unknown_security"))
        .when((F.col("corp_code") != F.col("expected_corp")) | (F.col("stock_code") != F.col("expected_stock")), F.lit("identity"))
        .when(~F.contains(F.col("corp_name"), F.col("expected_name")), F.lit("company_name"))
        .when((F.coalesce("report_name", F.lit("")) == "") | (F.coalesce("submitter", F.lit("")) == ""), F.lit("missing_text"))
        .when(F.col("submitted_date").isNull(), F.lit("date"))
        .when(~F.col("submitted_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit("outside_window"))
    )
    judged = joined.withColumn("reason", rules)
    sound = judged.where(F.col("reason").isNull())
    first = keep_first(sound, ["receipt_no"], [F.col("ord")])
    repeated = sound.join(first.select("receipt_no", F.col("ord")), ["receipt_no", "ord"], "left_anti").withColumn("reason", F.lit("repeated_receipt"))
    items = first.select(
        F.concat(F.lit("disclosure:"), "receipt_no").alias("disclosure_id"), "security_id", "receipt_no", "corp_code", "stock_code",
        F.col("corp_name").alias("company_name"), "report_name", "submitter", "submitted_date",
        times.day_available_at("submitted_date").alias("available_from"),
        F.concat(F.lit(fixed.DISCLOSURE_VIEWER), "receipt_no").alias("viewer_url"),
        topics.report_category("report_name").alias("report_category"),
        topics.correction_status("report_name", "remark").alias("correction_status"),
        hashing.lineage_key("security_id", "report_name").alias("lineage_key"), "remark",
    )
    return items, judged.where(F.col("reason").isNotNull()).unionByName(repeated)


def registry_check(expected: DataFrame, registry: DataFrame) -> DataFrame:
    """JOI-21: each expected identity against the official registry."""
    joined = expected.join(registry, "stock_code", "left")
    ok = (F.col("corp_code") == F.col("expected_corp")) & F.contains(F.col("corp_name"), F.col("expected_name"))
    return joined.select("security_id", F.coalesce(ok, F.lit(False)).alias("verified"))


def report_inventory(reports: DataFrame, cutoff: str) -> DataFrame:
    """CMP-17: report rows with extraction status, selection by cutoff, scope and stable id.

    ``reports``: security_id, publisher, title, published_date, source_url, content_hash, page_texts.
    """
    lengths = F.transform("page_texts", lambda page: F.length(F.trim(page)))
    filled = F.size(F.filter(lengths, lambda n: n > 0))
    status = (
        F.when(filled == 0, F.lit("image_only_visual_review_required")).when(filled == F.size("page_texts"), F.lit("text_extracted"))
        .otherwise(F.lit("partial_text_extracted"))
    )
    return reports.select(
        hashing.stable_id("report", "security_id", "publisher", F.col("published_date").cast("string"), "title", "content_hash").alias("report_id"),
        "security_id", "publisher", "title", "published_date", times.day_available_at("published_date").alias("available_from"), "source_url",
        F.size("page_texts").alias("page_count"), filled.alias("nonempty_pages"),
        F.aggregate(lengths, F.lit(0), lambda total, n: total + n).alias("characters"), status.alias("extraction_status"),
        F.when(contains_any(fold_case("title"), fixed.MARKET_STRATEGY_MARKERS), F.lit("market_strategy_with_company_focus"))
        .otherwise(F.lit("company_specific")).alias("report_scope"),
        F.when(F.col("published_date") <= F.lit(cutoff).cast("date"), F.lit("selected")).otherwise(F.lit("excluded_after_cutoff")).alias("selection_status"),
    )


def page_checksums(reports: DataFrame, key: str) -> DataFrame:
    """CMP-17: hash and length of every page with text."""
    pages = reports.select(key, F.posexplode("page_texts").alias("index", "page")).withColumn("page", F.trim("page"))
    return pages.where(F.length("page") > 0).select(
        key, (F.col("index") + 1).alias("page_number"), F.sha2("page", 256).alias("text_sha256"), F.length("page").alias("characters")
    )


def relevance_score(
    title: Column, aliases: Sequence[str] | str, event_terms: Sequence[str] | None = None, reject: Sequence[str] | None = None,
    broad: Sequence[str] | None = None, max_offset: int = fixed.CURATION_ALIAS_MAX_OFFSET,
) -> Column:
    """FLT-11 / CMP-20: 4 plus 2 per event term for a relevant title, null otherwise; ``aliases`` may name an array column."""
    events = [t.casefold() for t in (fixed.CURATION_EVENT_TERMS if event_terms is None else event_terms)]
    unwanted = [t.casefold() for t in (fixed.REJECT_TERMS if reject is None else reject)]
    unwanted += [t.casefold() for t in (fixed.BROAD_MARKET_TERMS if broad is None else broad)]
    folded = fold_case(title)
    offset = _name_offset(folded, aliases) if isinstance(aliases, str) else first_offset(folded, [alias.casefold() for alias in aliases])
    hits = count_contained(folded, events)
    relevant = F.coalesce(offset <= max_offset, F.lit(False)) & ~contains_any(folded, unwanted) & (hits > 0)
    return F.when(relevant, 4 + 2 * hits)


def capped_by_day(rows: DataFrame, order: Sequence[Column], daily: int = fixed.DAILY_CAP, period: int = fixed.PERIOD_CAP) -> DataFrame:
    """WIN-07: at most ``daily`` rows per local day, then ``period`` rows over the days in order."""
    by_day = top_rows(rows, ["security_id", "local_day"], order, daily, "day_rank")
    return top_rows(by_day, ["security_id"], [F.col("local_day"), F.col("day_rank")], period, "period_rank")


def curate_feed(
    items: DataFrame, aliases: Mapping[str, Sequence[str]], daily: int = fixed.DAILY_CAP, period: int = fixed.PERIOD_CAP,
    event_terms: Sequence[str] | None = None, reject: Sequence[str] | None = None, broad: Sequence[str] | None = None,
) -> DataFrame:
    """CMP-20: relevant titles, URL and title deduplicated in feed order, newest first under both caps.

    ``items``: security_id, title, published_at, source_url, ord.
    """
    score = relevance_score(F.col("title"), "__aliases", event_terms, reject, broad)
    relevant = _with_names(items, __aliases=aliases).withColumn("score", score).drop("__aliases").where(F.col("score").isNotNull())
    unique = two_key_dedup(
        relevant.withColumn("title_key", fold_case("title")), "security_id", "source_url", "title_key", "ord"
    ).withColumn("document_id", hashing.stable_id("feed", "source_url")).withColumn("local_day", times.local_day("published_at"))
    order = [F.col("published_at").desc(), F.col("score").desc(), F.col("document_id")]
    return capped_by_day(unique, order, daily, period)


def merge_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-01: rows of several query runs without those whose id or URL came earlier, and the run counts."""
    order = F.struct("run", "ord")
    merged = two_key_dedup(runs.withColumn("__order", order), "security_id", "document_id", "source_url", "__order")
    summary = runs.groupBy("security_id", "run").agg(F.count(F.lit(1)).alias("candidates"))
    return merged.drop("__order"), summary
