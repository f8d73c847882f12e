"""Lexical BM25 retrieval for a table of requests over a table of evidence.

Candidate statistics (N, average length, document frequency) are kept per filter set. Only
tokens that occur in some query are counted, scores are summed per (request, evidence), and the
top-k cut happens before the ranking shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column, query_tokens, retrieval_tokens
from lodestone.operators.filters import (
    FILTER_COLUMNS, as_of_match, day_range_match, link_documents, reachable, scope_match, with_filter_sets,
)
from lodestone.operators.market import asof_join
from lodestone.operators.selection import leading_rows, source_place
from lodestone.operators.skew import hinted_join, is_small
from lodestone.session import cut_lineage

MARKER = ""


def idf(total: ColumnLike, frequency: ColumnLike) -> Column:
    total, frequency = as_column(total), as_column(frequency)
    return F.log(1 + (total - frequency + 0.5) / (frequency + 0.5))


def bm25_term(
    tf: ColumnLike, df: ColumnLike, total: ColumnLike, length: ColumnLike, mean_length: ColumnLike, query_tf: ColumnLike,
    k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
) -> Column:
    """TXT-06: the contribution of one query token."""
    tf, length, mean_length = as_column(tf), as_column(length), as_column(mean_length)
    norm = tf + k1 * (1 - b + b * length / mean_length)
    return idf(total, df) * (tf * (k1 + 1)) / norm * as_column(query_tf)


def evidence_tokens(evidence: DataFrame) -> DataFrame:
    """Token list and length of each evidence; title tokens count twice."""
    title = F.flatten(F.array_repeat(retrieval_tokens("title"), fixed.TITLE_WEIGHT))
    return evidence.select(
        "evidence_id", "source_type", F.concat(title, retrieval_tokens("snippet")).alias("tokens")
    ).withColumn("length", F.size("tokens"))


def request_tokens(requests: DataFrame) -> DataFrame:
    """Query tokens with their multiplicity, one row per (request, token)."""
    rows = requests.select("request_id", "filter_set", F.explode(query_tokens("query")).alias("token"))
    return rows.groupBy("request_id", "filter_set", "token").agg(F.count(F.lit(1)).alias("query_tf"))


def postings(evidence: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """AGG-02: occurrences of the query vocabulary per evidence, plus one marker row per evidence.

    Each text is tokenized once, whatever the number of filter sets it belongs to. The marker
    (the empty token) stands for the evidence itself, so N and the average length come out of the
    same rows as the document frequencies.
    """
    rows = evidence_tokens(evidence).select(
        "evidence_id", "source_type", "length", F.explode(F.concat(F.array(F.lit(MARKER)), "tokens")).alias("token")
    )
    kept = hinted_join(rows, vocabulary, ["token"], small, "left_semi")
    # Partitioned by evidence for the count here and for the join with the candidates next.
    return kept.repartition("evidence_id").groupBy("evidence_id", "source_type", "length", "token").agg(
        F.count(F.lit(1)).alias("tf")
    )


def term_statistics(rows: DataFrame) -> DataFrame:
    """AGG-01: document frequency per token, with N and average length of its filter set."""
    per_token = rows.groupBy("filter_set", "token").agg(
        F.sum(F.when(F.col("tf") > 0, 1)).alias("df"), F.sum("length").alias("lengths")
    )
    # One row per (filter set, query token): a small table whatever the evidence.
    spec = Window.partitionBy("filter_set")
    marker = F.col("token") == MARKER
    return (
        per_token.withColumn("total", F.max(F.when(marker, F.col("df"))).over(spec))
        .withColumn("mean_length", F.max(F.when(marker, F.col("lengths"))).over(spec) / F.col("total"))
        .drop("lengths")
    )


def bm25_scores(
    evidence: DataFrame, candidates: DataFrame, asked: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
    small: bool | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the (request, evidence) pairs sharing a token, the query tokens and the statistics."""
    tokens = request_tokens(asked)
    small = is_small(asked, "query") if small is None else small
    markers = asked.select("filter_set", F.lit(MARKER).alias("token")).distinct()
    wanted = tokens.select("filter_set", "token").union(markers).distinct()
    per_evidence = postings(evidence, wanted.select("token").distinct(), small)
    rows = per_evidence.join(candidates.select("evidence_id", "filter_set"), "evidence_id")
    statistics = term_statistics(rows)
    weighted = tokens.join(statistics, ["filter_set", "token"])
    # A frequent token may sit in a third of all evidence: beyond the broadcast bound the join
    # spreads it over salts.
    keys = ["filter_set", "token"]
    pairs = hinted_join(rows, weighted, keys, small)
    term = bm25_term("tf", "df", "total", "length", "mean_length", "query_tf", k1, b)
    scored = pairs.groupBy("request_id", "evidence_id", "source_type").agg(F.sum(term).alias("raw"))
    scores = scored.select(
        "request_id", "evidence_id", "source_type", F.bround("raw", fixed.SCORE_DIGITS).alias("score")
    )
    return scores, tokens, statistics


def candidate_totals(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Number and mean length of the candidates of each filter set, without a pair of the two.

    ``cells`` has security_id, source_type, shown types, effective_at and length of the candidates.
    Counts and lengths are summed up along time for each (security, source, types); a filter set
    looks them up at its two time bounds, and takes candidates without a time if it has no bound.
    """
    group = ["security_id", "source_type", "shown"]
    counted = cells.groupBy(*group, "effective_at").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("lengths"))
    timeless = counted.where("effective_at IS NULL").select(*group, F.col("n").alias("loose_n"), F.col("lengths").alias("loose_lengths"))
    upto = Window.partitionBy(*group).orderBy("effective_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.where("effective_at IS NOT NULL").select(
        *group, F.col("effective_at").alias("at"), F.sum("n").over(upto).alias("n"), F.sum("lengths").over(upto).alias("lengths")
    )
    kinds = counted.select(*group).distinct()
    per_source = sets.withColumn("source_type", F.explode(F.array_distinct("source_types")))
    wanted = F.col("document_types").isNull() | F.coalesce(F.arrays_overlap("shown", "document_types"), F.lit(False))
    asks = per_source.join(kinds, ["security_id", "source_type"]).where(wanted)
    # Local days as instants; bounds are kept a microsecond inside, so that "at or before" serves both.
    instant = lambda day, days: F.to_utc_timestamp(F.date_add(day, days).cast("timestamp"), fixed.LOCAL_ZONE)
    just_before = lambda at: F.timestamp_micros(F.unix_micros(at) - 1)
    latest = F.least(F.col("as_of"), just_before(instant("end_day", 1)), F.lit("9999-01-01 00:00:00").cast("timestamp"))
    bounds = F.array_compact(F.array(
        F.struct(latest.alias("bound"), F.lit(1).alias("sign")),
        F.when(F.col("start_day").isNotNull(), F.struct(just_before(instant("start_day", 0)).alias("bound"), F.lit(-1).alias("sign"))),
    ))
    points = asks.select("filter_set", *group, F.explode(bounds).alias("b")).select("filter_set", *group, "b.bound", "b.sign")
    found = asof_join(points, running, group, "bound", "at", ["n", "lengths"], 86_400)
    bounded = found.groupBy("filter_set").agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("lengths")).alias("lengths"))
    loose = asks.where("as_of IS NULL AND start_day IS NULL AND end_day IS NULL").join(timeless, group).groupBy("filter_set").agg(
        F.sum("loose_n").alias("n"), F.sum("loose_lengths").alias("lengths")
    )
    return bounded.unionByName(loose).groupBy("filter_set").agg(F.sum("n").alias("total"), F.sum("lengths").alias("lengths")).where("total > 0").select(
        "filter_set", "total", (F.col("lengths") / F.col("total")).alias("mean_length")
    )


def bm25_by_token(
    evidence: DataFrame, documents: DataFrame, asked: DataFrame, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, small: bool | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``bm25_scores`` over all evidence of ``documents``: evidence and filter sets meet only where they share a token.

    Hard filters are checked on the shared tokens, which gives document frequencies and scores;
    the number and mean length of all candidates come from sums along time.
    """
    tokens = request_tokens(asked)
    small = is_small(asked, "query") if small is None else small
    sets = asked.select("filter_set", *FILTER_COLUMNS).dropDuplicates(["filter_set"])
    marker = asked.select(F.lit(MARKER).alias("token")).distinct()
    # The filters need no text; narrow rows travel through the joins.
    linked = link_documents(evidence.drop("title", "snippet"), documents)
    shown = F.filter(F.array("document_type", "report_type", "content_level"), lambda v: v.isNotNull() & (F.trim(v) != ""))
    sound = reachable(linked).where(scope_match("security_id", "document_primary", F.lit(True))).select(
        "evidence_id", "security_id", F.array_sort(F.array_distinct(shown)).alias("shown"), "effective_at"
    )
    rows = cut_lineage(postings(evidence, tokens.select("token").union(marker).distinct(), small).join(sound, "evidence_id"))
    totals = candidate_totals(rows.where(F.col("token") == MARKER), sets)
    asked_tokens = tokens.select("filter_set", "token").distinct().join(sets, "filter_set")
    shared = hinted_join(rows.where(F.col("token") != MARKER), asked_tokens, ["security_id", "token"], small).where(
        F.array_contains("source_types", F.col("source_type"))
        & (F.col("document_types").isNull() | F.coalesce(F.arrays_overlap("shown", "document_types"), F.lit(False)))
        & as_of_match("effective_at", "as_of") & day_range_match("effective_at", "start_day", "end_day")
    ).select("filter_set", "token", "evidence_id", "source_type", "length", "tf")
    keys = ["filter_set", "token"]
    statistics = cut_lineage(
        shared.groupBy(*keys).agg(F.count(F.lit(1)).alias("df")).join(totals, "filter_set")
        .unionByName(totals.select("filter_set", F.lit(MARKER).alias("token"), F.col("total").alias("df"), "total", "mean_length"))
    )
    weighted = tokens.join(statistics, keys)
    term = bm25_term("tf", "df", "total", "length", "mean_length", "query_tf", k1, b)
    scored = hinted_join(shared, weighted, keys, small).groupBy("request_id", "evidence_id", "source_type").agg(F.sum(term).alias("raw"))
    scores = scored.select("request_id", "evidence_id", "source_type", F.bround("raw", fixed.SCORE_DIGITS).alias("score"))
    return scores, tokens, statistics


def bm25_retrieve(
    evidence: DataFrame, requests: DataFrame, documents: DataFrame | None = None,
    k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, floor: float = fixed.RELEVANCE_FLOOR, max_k: int = fixed.MAX_TOP_K,
    candidates: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """CMP-01: ranked, source-diverse hits and one diagnostics row per request.

    ``candidates`` may carry already filtered rows (``filter_set`` plus evidence columns), for
    example after the freshness stage. Ties keep the input order, fixed here by evidence id.
    """
    asked = with_filter_sets(requests).withColumn("effective_k", F.least("top_k", F.lit(max_k)))
    small = is_small(requests, "query")
    if candidates is None:
        scores, tokens, statistics = bm25_by_token(evidence, documents, asked, k1, b, small)
    else:
        scores, tokens, statistics = bm25_scores(evidence, candidates, asked, k1, b, small)
    return ranked_hits(asked, evidence, scores, tokens, statistics, floor, max_k, small)


def ranked_hits(
    asked: DataFrame, evidence: DataFrame, scores: DataFrame, tokens: DataFrame, statistics: DataFrame, floor: float, max_k: int, small: bool,
) -> tuple[DataFrame, DataFrame]:
    """The best ``effective_k`` scores of each request, first hits of its sources in front, and its diagnostics."""
    eligible = scores.where(F.col("score") >= floor)
    order = [F.col("score").desc(), F.col("evidence_id")]
    pool = leading_rows(eligible, order, max_k)
    required = F.when(F.size("source_types") > 1, F.col("source_types")).alias("required_sources")
    ranked = hinted_join(pool, asked.select("request_id", required, "effective_k"), ["request_id"], small)
    final = Window.partitionBy("request_id").orderBy(
        source_place("required_sources", "source_type", F.col("source_rank") == 1), *order
    )
    hits = (
        ranked.withColumn("position", F.row_number().over(final))
        .where(F.col("position") <= F.col("effective_k"))
        .select("request_id", "position", "evidence_id", "source_type", "score")
    )
    return hits, retrieval_diagnostics(asked, evidence, tokens, statistics, eligible, hits)


def retrieval_diagnostics(
    asked: DataFrame, evidence: DataFrame, tokens: DataFrame, statistics: DataFrame, eligible: DataFrame, hits: DataFrame
) -> DataFrame:
    """Status and stage counts per request, also for requests without any candidate."""
    total = evidence.agg(F.count(F.lit(1)).alias("input_count")).scalar()
    filtered = statistics.groupBy("filter_set").agg(F.max("total").alias("filtered"))
    queries = tokens.groupBy("request_id").agg(F.sum("query_tf").alias("query_tokens"))
    kept = eligible.groupBy("request_id").agg(F.count(F.lit(1)).alias("eligible"))
    returned = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("returned"))
    rows = (
        asked.select("request_id", "filter_set", "top_k", "effective_k")
        .withColumn("input_count", total)
        .join(filtered, "filter_set", "left").join(queries, "request_id", "left")
        .join(kept, "request_id", "left").join(returned, "request_id", "left")
    )
    zero = F.lit(0).cast("bigint")
    filtered_count = F.coalesce("filtered", zero)
    scored = (filtered_count > 0) & (F.coalesce("query_tokens", zero) > 0)
    return rows.select(
        "request_id",
        F.when(filtered_count == 0, F.lit("empty")).when(F.coalesce("eligible", zero) == 0, F.lit("low_relevance"))
        .otherwise(F.lit("ok")).alias("status"),
        "input_count", filtered_count.alias("filtered_count"),
        F.when(scored, filtered_count).otherwise(zero).alias("scored_count"),
        F.coalesce("eligible", zero).alias("eligible_count"),
        F.coalesce("returned", zero).alias("returned_count"),
        F.when(filtered_count == 0, zero).otherwise(F.coalesce("query_tokens", zero)).alias("query_token_count"),
        F.col("top_k").alias("requested_top_k"), F.col("effective_k").alias("effective_top_k"),
        F.lit(fixed.MAX_TOP_K).alias("max_top_k"), F.lit(fixed.RELEVANCE_FLOOR).alias("low_relevance_threshold"),
    )


def news_first(
    evidence: DataFrame, requests: DataFrame, documents: DataFrame, news_k: int = 6
) -> DataFrame:
    """TOP-08: price-move requests use their news hits when there are any, everything else runs in full."""
    moves = requests.where(F.col("intent") == "price_move")
    news_requests = moves.withColumn("source_types", F.array(F.lit("news"))).withColumn("top_k", F.lit(news_k))
    news_hits, _ = bm25_retrieve(evidence, news_requests, documents)
    served = news_hits.select("request_id").distinct()
    rest_hits, _ = bm25_retrieve(evidence, requests.join(served, "request_id", "left_anti"), documents)
    return news_hits.unionByName(rest_hits)
