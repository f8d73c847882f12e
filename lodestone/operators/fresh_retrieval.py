"""BM25 over the evidence that is fresh at each request's basis time.

A piece of evidence is valid from its own time to its replacement, its withdrawal or its age limit.
How many valid pieces a request has to choose from, and how long they are, is therefore a matter of
interval stabbing: running counts along time, looked up at both ends of the request's window by
as-of joins. Documents with corrections, or with pieces of several times, are few and are counted
one by one. Evidence and requests meet only where they share a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.operators.filters import FILTER_COLUMNS, link_documents, reachable, scope_match, with_filter_sets
from lodestone.operators.freshness import SUPPORTED, has_user_range
from lodestone.operators.market import asof_join
from lodestone.operators.retrieval import MARKER, bm25_term, postings, ranked_hits, request_tokens
from lodestone.operators.skew import hinted_join, is_small
from lodestone.session import cut_lineage

GROUP = ["security_id", "source_type", "shown"]


def _instant(day: Column, days: Column | int) -> Column:
    """Start of the local day ``days`` after ``day``."""
    return F.to_utc_timestamp(F.date_add(day, F.lit(days) if isinstance(days, int) else days).cast("timestamp"), fixed.LOCAL_ZONE)


def fresh_sets(requests: DataFrame) -> DataFrame:
    """``requests`` with the id of their filters and basis time together: equal ones have the same fresh evidence."""
    named = with_filter_sets(requests)
    return named.withColumn("filter_set", F.sha2(F.concat_ws("|", "filter_set", F.coalesce(F.unix_micros("basis_at").cast("string"), F.lit("none"))), 256))


def windows(sets: DataFrame, disclosure_age: Column) -> DataFrame:
    """One row for each set and source: inclusive bounds ``first`` (null: none) and ``last`` of the times that are fresh, and whether pieces without a time are."""
    per_source = sets.withColumn("source_type", F.explode(F.array_distinct("source_types")))
    supported = F.col("source_type").isin(SUPPORTED)
    age = F.when(F.col("source_type") == "disclosure", disclosure_age)
    for name, days in fixed.MAX_AGE_DAYS.items():
        age = age if name == "disclosure" else age.when(F.col("source_type") == name, F.lit(days))
    oldest = F.when(supported & ~has_user_range(), _instant(times.local_day("basis_at"), -age))
    day_end = F.timestamp_micros(F.unix_micros(_instant(F.col("end_day"), 1)) - 1)
    return per_source.select(
        "filter_set", "security_id", "source_type", "document_types",
        F.greatest(_instant(F.col("start_day"), 0), oldest).alias("first"),
        F.least(F.col("as_of"), day_end, F.when(supported, F.col("basis_at")), F.lit("9999-01-01 00:00:00").cast("timestamp")).alias("last"),
        (~supported & F.col("as_of").isNull() & ~has_user_range()).alias("timeless"),
    )


def _wanted() -> Column:
    return F.col("document_types").isNull() | F.coalesce(F.arrays_overlap("shown", "document_types"), F.lit(False))


def _inside() -> Column:
    at = F.col("effective_at")
    timed = at.isNotNull() & (at <= F.col("last")) & (F.col("first").isNull() | (at >= F.col("first")))
    return timed | (at.isNull() & F.col("timeless"))


def stabbed(cells: DataFrame, asks: DataFrame) -> DataFrame:
    """filter_set, n and lengths: pieces of ``cells`` inside the windows of ``asks``, from running counts at the two bounds."""
    counted = cells.groupBy(*GROUP, "effective_at").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("lengths"))
    upto = Window.partitionBy(*GROUP).orderBy("effective_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.where("effective_at IS NOT NULL").select(
        *GROUP, F.col("effective_at").alias("at"), F.sum("n").over(upto).alias("n"), F.sum("lengths").over(upto).alias("lengths")
    )
    asked = asks.join(counted.select(*GROUP).distinct(), ["security_id", "source_type"]).where(_wanted())
    before = F.timestamp_micros(F.unix_micros("first") - 1)
    bounds = F.array_compact(F.array(
        F.struct(F.col("last").alias("bound"), F.lit(1).alias("sign")), F.when(F.col("first").isNotNull() & (F.col("first") <= F.col("last")), F.struct(before.alias("bound"), F.lit(-1).alias("sign"))),
    ))
    # A window that ends before it begins holds nothing.
    open_ = asked.where("first IS NULL OR first <= last")
    points = open_.select("filter_set", *GROUP, F.explode(bounds).alias("b")).select("filter_set", *GROUP, "b.bound", "b.sign")
    found = asof_join(points, running, GROUP, "bound", "at", ["n", "lengths"], 86_400)
    timed = found.select("filter_set", (F.col("sign") * F.col("n")).alias("n"), (F.col("sign") * F.col("lengths")).alias("lengths"))
    loose = asked.where("timeless").join(counted.where("effective_at IS NULL"), GROUP).select("filter_set", "n", "lengths")
    return timed.unionByName(loose).groupBy("filter_set").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("lengths"), F.lit(0)).alias("lengths"))


def fresh_bm25(
    evidence: DataFrame, documents: DataFrame, asked: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, small: bool | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the fresh (request, evidence) pairs that share a token, the query tokens and the statistics of each set.

    ``asked`` carries fresh sets. ``documents`` also has is_withdrawn, is_correction and correction_of.
    """
    small = is_small(asked, "query") if small is None else small
    tokens = request_tokens(asked)
    sets = cut_lineage(asked.select("filter_set", *FILTER_COLUMNS, "basis_at").dropDuplicates(["filter_set"]))
    flags = documents.select("document_id", F.coalesce("is_withdrawn", F.lit(False)).alias("gone"), F.when(F.col("is_correction"), F.col("correction_of")).alias("replaces"))
    linked = link_documents(evidence.drop("title", "snippet"), documents)
    shown = F.filter(F.array("document_type", "report_type", "content_level"), lambda v: v.isNotNull() & (F.trim(v) != ""))
    sound = cut_lineage(reachable(linked).where(scope_match("security_id", "document_primary", F.lit(True))).join(flags, "document_id").where(
        "NOT (source_type = 'disclosure' AND gone)"
    ).select("evidence_id", "document_id", "security_id", F.array_sort(F.array_distinct(shown)).alias("shown"), "effective_at", F.when(F.col("source_type") == "disclosure", F.col("replaces")).alias("replaces")))
    targets = sound.where("replaces IS NOT NULL").select(F.col("replaces").alias("document_id"), F.lit(True).alias("has_correction")).distinct()
    sound = sound.join(targets, "document_id", "left")
    marker = asked.select(F.lit(MARKER).alias("token")).distinct()
    rows = cut_lineage(postings(evidence, tokens.select("token").union(marker).distinct(), small).join(sound, "evidence_id"))
    pieces = rows.where(F.col("token") == MARKER).drop("token", "tf")

    # A document is replaced for a set by a correction that the set's own filters let through by its basis time.
    corrections = cut_lineage(pieces.where("replaces IS NOT NULL AND effective_at IS NOT NULL").select("security_id", "source_type", "shown", "effective_at", F.col("replaces").alias("document_id")).distinct())
    plain_windows = windows(sets.withColumn("__any", F.lit(None).cast("int")), F.col("__any"))
    replaced = cut_lineage(hinted_join(corrections, plain_windows, ["security_id", "source_type"], small).where(_wanted() & _inside()).select("filter_set", "document_id").distinct())
    # Documents that are counted one by one: corrected ones, and those with pieces of different times or types.
    uneven = pieces.groupBy("security_id", "document_id").agg(F.countDistinct(F.struct("effective_at", "shown")).alias("__kinds")).where("__kinds > 1")
    special = cut_lineage(corrections.select("security_id", "document_id").union(uneven.select("security_id", "document_id")).distinct())
    keys = ["security_id", "document_id"]
    even, odd = cut_lineage(pieces.join(special, keys, "left_anti")), cut_lineage(pieces.join(special, keys, "left_semi"))

    def counted_one_by_one(asks: DataFrame) -> DataFrame:
        met = hinted_join(odd, asks, ["security_id", "source_type"], small).where(_wanted() & _inside())
        return met.join(replaced, ["filter_set", "document_id"], "left_anti").select("filter_set", "document_id", "evidence_id", "length").distinct()

    # The disclosure window of a set is longer where it has few recent disclosures.
    recent = windows(sets.where(F.array_contains("source_types", "disclosure")), F.lit(fixed.MAX_AGE_DAYS["disclosure"])).where("source_type = 'disclosure'")
    one_each = even.where("source_type = 'disclosure'").groupBy(*keys, "source_type", "shown", "effective_at").agg(F.lit(0).cast("bigint").alias("length"))
    few = stabbed(one_each, recent).select("filter_set", "n").unionByName(counted_one_by_one(recent).groupBy("filter_set").agg(F.countDistinct("document_id").alias("n")))
    ages = few.groupBy("filter_set").agg(F.when(F.sum("n") >= fixed.MIN_DISCLOSURES, F.lit(fixed.MAX_AGE_DAYS["disclosure"])).alias("__age"))
    aged = sets.join(ages, "filter_set", "left").withColumn("__age", F.coalesce("__age", F.lit(fixed.DISCLOSURE_FALLBACK_DAYS)))
    asks = cut_lineage(windows(aged, F.col("__age")))

    single = counted_one_by_one(asks).groupBy("filter_set").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("lengths"))
    totals = cut_lineage(stabbed(even, asks).unionByName(single).groupBy("filter_set").agg(F.sum("n").alias("total"), F.sum("lengths").alias("lengths")).where("total > 0").select(
        "filter_set", "total", (F.col("lengths") / F.col("total")).alias("mean_length")
    ))
    asked_tokens = tokens.select("filter_set", "token").distinct().join(asks, "filter_set")
    met = hinted_join(rows.where(F.col("token") != MARKER), asked_tokens, ["security_id", "source_type", "token"], small).where(_wanted() & _inside())
    # ``replaced`` grows with the documents, however few the requests are, so it is not broadcast; only documents with a correction can be in it.
    left = met.where(F.col("has_correction")).join(replaced.hint("merge"), ["filter_set", "document_id"], "left_anti")
    fields = ["filter_set", "token", "evidence_id", "source_type", "length", "tf"]
    shared = cut_lineage(met.where(F.col("has_correction").isNull()).select(*fields).unionByName(left.select(*fields)).distinct())
    pair = ["filter_set", "token"]
    statistics = cut_lineage(
        shared.groupBy(*pair).agg(F.count(F.lit(1)).alias("df")).join(totals, "filter_set")
        .unionByName(totals.select("filter_set", F.lit(MARKER).alias("token"), F.col("total").alias("df"), "total", "mean_length"))
    )
    term = bm25_term("tf", "df", "total", "length", "mean_length", "query_tf", k1, b)
    scored = hinted_join(shared, tokens.join(statistics, pair), pair, small).groupBy("request_id", "evidence_id", "source_type").agg(F.sum(term).alias("raw"))
    return scored.select("request_id", "evidence_id", "source_type", F.bround("raw", fixed.SCORE_DIGITS).alias("score")), tokens, statistics


def fresh_retrieve(
    evidence: DataFrame, requests: DataFrame, documents: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
    floor: float = fixed.RELEVANCE_FLOOR, max_k: int = fixed.MAX_TOP_K,
) -> tuple[DataFrame, DataFrame]:
    """CMP-01 after CMP-02: ranked hits among the fresh evidence, and one diagnostics row per request.

    As ``bm25_retrieve`` over what ``apply_freshness`` retains at each request's ``basis_at``: stale,
    future, undated, withdrawn and replaced evidence is neither returned nor counted.
    """
    small = is_small(requests, "query")
    asked = cut_lineage(fresh_sets(requests).withColumn("effective_k", F.least("top_k", F.lit(max_k))))
    scores, tokens, statistics = fresh_bm25(evidence, documents, asked, k1, b, small)
    return ranked_hits(asked, evidence, scores, tokens, statistics, floor, max_k, small)
