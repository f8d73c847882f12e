"""Question classification and request planning as a table job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.functions.text import ColumnLike, as_column, bounded_contains, clean_entities_first, contains_any, fold, quote
from lodestone.operators.policy import intent_table
from lodestone.operators.skew import hinted_join, is_small

Lexicon = Mapping[str, Sequence[str]]
OUT_OF_SCOPE = "out_of_scope"


def classify_intent(folded: ColumnLike, lexicon: Lexicon | None = None) -> Column:
    """TXT-11: intent by ordered phrase groups over folded text."""
    words, text = fixed.PHRASES if lexicon is None else lexicon, as_column(folded)

    def has(name: str) -> Column:
        return contains_any(text, words[name])

    return (
        F.when(has("unsupported_market"), F.lit(OUT_OF_SCOPE))
        .when(has("price_move"), F.lit("price_move"))
        .when(has("term_cue") & has("term_marker"), F.lit("financial_term"))
        .when(has("risk"), F.lit("risk_factors"))
        .when(has("price"), F.lit("price"))
        .when(has("multi_source"), F.lit("multi_source_summary"))
        .when(has("disclosure"), F.lit("disclosure_summary"))
        .when(has("research_report"), F.lit("research_report_summary"))
        .when(has("issue") & has("technology") & ~has("recency"), F.lit("multi_source_summary"))
        .when(has("recent_issue"), F.lit("recent_issue"))
        .otherwise(F.lit(OUT_OF_SCOPE))
    )


def classify_focus(folded: ColumnLike, intent: ColumnLike, lexicon: Lexicon | None = None) -> Column:
    """TXT-12: what the answer should dwell on."""
    words, text, intent = fixed.PHRASES if lexicon is None else lexicon, as_column(folded), as_column(intent)

    def has(name: str) -> Column:
        return contains_any(text, words[name])

    return (
        F.when(intent == "financial_term", F.lit("term")).when(intent == "price", F.lit("price"))
        .when(intent == "price_move", F.lit("price_move"))
        .when(has("balanced"), F.lit("balanced")).when(has("outlook"), F.lit("outlook"))
        .when(intent == "risk_factors", F.lit("risk")).when(intent == "disclosure_summary", F.lit("disclosure"))
        .when(intent == "research_report_summary", F.lit("research_view")).when(intent == "recent_issue", F.lit("recent_events"))
        .when(has("positive"), F.lit("positive")).when(has("performance"), F.lit("performance"))
        .when(has("shareholder_return"), F.lit("shareholder_return")).when(has("business"), F.lit("business"))
        .when(has("technology"), F.lit("technology")).when(has("situation"), F.lit("balanced"))
        .otherwise(F.lit("general"))
    )


def is_prohibited(folded: ColumnLike, phrases: Sequence[str] | None = None, bounded: Sequence[str] | None = None) -> Column:
    """TXT-13: an advice phrase occurs; bounded ones only as a word of their own."""
    phrases = fixed.PHRASES["prohibited"] if phrases is None else phrases
    bounded = fixed.BOUNDED_PHRASES if bounded is None else bounded
    found = contains_any(folded, [phrase for phrase in phrases if phrase not in bounded])
    for phrase in bounded:
        if phrase in phrases:
            found = found | bounded_contains(folded, phrase)
    return found


def cue_group_count(folded: ColumnLike, lexicon: Lexicon | None = None) -> Column:
    """TXT-20: number of intent cue groups a question touches."""
    words, text = fixed.PHRASES if lexicon is None else lexicon, as_column(folded)
    groups = ["price_move", "risk", "price", "multi_source", "disclosure", "research_report", "recent_issue"]
    term = contains_any(text, words["term_cue"]) & contains_any(text, words["term_marker"])
    return sum((contains_any(text, words[name]).cast("int") for name in groups), term.cast("int"))


def needs_routing(
    folded: ColumnLike, intent: ColumnLike, has_security: ColumnLike, lexicon: Lexicon | None = None,
    markers: Mapping[str, Sequence[str]] | None = None,
) -> Column:
    """TXT-20: the rule intent is ambiguous enough for a second opinion."""
    words, text, intent = fixed.PHRASES if lexicon is None else lexicon, as_column(folded), as_column(intent)
    markers = fixed.SOURCE_MARKERS if markers is None else markers
    named = sum((contains_any(text, names).cast("int") for names in markers.values()), F.lit(0))
    situation = contains_any(text, words["price_word"]) & contains_any(text, words["situation"])
    return (
        as_column(has_security) & intent.isin(list(fixed.INTENT_MATRIX))
        & ~((intent == "multi_source_summary") & (named >= 2))
        & (
            (cue_group_count(text, words) >= 2)
            | (intent.isin("price", "multi_source_summary") & situation)
            | ((intent == "risk_factors") & contains_any(text, words["route_recency"]))
        )
    )


def expand_query(query: ColumnLike, focus: ColumnLike, terms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """TXT-19: the query followed by the terms of its focus."""
    terms = fixed.FOCUS_QUERY_TERMS if terms is None else terms
    pairs = [(F.lit(name), F.lit(" ".join(words))) for name, words in terms.items() if words]
    table = F.create_map(*[part for pair in pairs for part in pair])
    return F.concat_ws(" ", as_column(query), F.try_element_at(table, as_column(focus)))


def feed_query(query: ColumnLike, name: ColumnLike, aliases: Sequence[str], cleaned: ColumnLike | None = None) -> Column:
    """TXT-21: the cleaned query, led by the security name unless an alias occurs in it.

    ``cleaned`` may name a column that holds the cleaned query, which is then worked out once.
    """
    cleaned = clean_entities_first(query) if cleaned is None else as_column(cleaned)
    known = contains_any(fold(cleaned), aliases)
    return F.when(as_column(query).isNull(), as_column(name)).when(known, cleaned).otherwise(F.concat_ws(" ", as_column(name), cleaned))


def consists_of(text: ColumnLike, words: Sequence[str], between: str) -> Column:
    """The text is one of the words once all characters of the class ``between`` are left out; told at its beginning."""
    spread = "|".join("".join(f"{quote(char)}{between}*" for char in word) for word in words)
    return as_column(text).rlike(f"\\A{between}*(?:{spread})\\z")


def question_features(
    questions: DataFrame, extraction: DataFrame, securities: DataFrame, lexicon: Lexicon | None = None, content: str = "[가-힣]",
    bounded: Sequence[str] | None = None, today: Sequence[str] | None = None, recent: Sequence[str] | None = None,
) -> DataFrame:
    """What a question says on its own: intent, period, security, follow-up and switch marks.

    ``questions``: request_id, question, basis_day. ``securities``: security_id, ticker, security_name, corp_name.
    """
    words = fixed.PHRASES if lexicon is None else lexicon
    named = securities.select("security_id", F.array_distinct(F.array(
        fold("security_name"), fold("corp_name"), fold("ticker"), fold("security_id")
    )).alias("names"))
    joined = questions.join(extraction, "request_id").withColumn("folded", fold("question"))
    joined = hinted_join(joined, named, ["security_id"], is_small(securities), "left")
    remainder = F.aggregate(
        F.coalesce("names", F.array().cast("array<string>")), F.col("folded"), lambda text, name: F.replace(text, name, F.lit(" "))
    )
    period = times.parse_period("folded", "basis_day", words["today"] if today is None else today, words["recent"] if recent is None else recent, "__dated")
    speaks_of_period = contains_any("folded", words["same_period"]) & F.col("__dated").rlike(r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)|(?<!\d)\d{4}\s*년\s*\d+\s*월")
    rows = joined.withColumns({"remainder": remainder, "__dated": times.dated_text("folded")}).withColumn("period", period)
    intent = classify_intent("folded", words)
    return rows.select(
        "request_id", "question", "basis_day", "folded", "security_id", "multi_security", "unclear_security", intent.alias("rule_intent"),
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), F.col("period.explicit").alias("period_explicit"),
        is_prohibited("folded", words["prohibited"], bounded).alias("prohibited"),
        contains_any("folded", words["unsupported_market"]).alias("unsupported"),
        (F.col("security_id").isNotNull() & F.col("remainder").rlike(content)).alias("has_content"),
        (contains_any("folded", words["follow_up"]) | speaks_of_period).alias("follow_up"),
        consists_of("remainder", fixed.SWITCH_REMAINDERS, r"[\s?!.,~]").alias("switch"),
    )


def plan_requests(features: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """CMP-23: plan of each question without dialogue state."""
    needs = [name for name, (_, _, security) in fixed.INTENT_MATRIX.items() if security]
    security = F.col("security_id")
    oos = F.col("rule_intent") == OUT_OF_SCOPE
    intent = (
        F.when(F.col("folded") == "", F.lit(OUT_OF_SCOPE)).when(F.col("prohibited"), F.lit("prohibited_advice"))
        .when(F.col("multi_security"), F.lit(OUT_OF_SCOPE)).when(F.col("unclear_security"), F.col("rule_intent"))
        .when(oos & ~F.col("unsupported") & F.col("has_content"), F.lit("multi_source_summary")).otherwise(F.col("rule_intent"))
    )
    clarify = (
        (F.col("folded") == "") | F.col("prohibited") | F.col("multi_security") | F.col("unclear_security")
        | (intent == OUT_OF_SCOPE) | (intent.isin(needs) & security.isNull())
    )
    # A plain out-of-scope question carries no period, nor does a refused one.
    bare = (F.col("folded") == "") | F.col("prohibited") | (
        ~F.col("multi_security") & ~F.col("unclear_security") & (intent == OUT_OF_SCOPE) & ~F.col("unsupported")
    )
    planned = features.withColumn("intent", intent).withColumn("requires_clarification", clarify)
    move = ~clarify & (F.col("intent") == "price_move") & F.col("period_start").isNull()
    empty = F.array().cast("array<string>")
    sources, evidence = intent_table()
    return planned.select(
        "request_id", F.when(~clarify, security).alias("security_id"), "intent",
        F.when(~clarify, classify_focus("folded", "intent", lexicon)).alias("answer_focus"),
        F.when(~bare, F.when(move, F.col("basis_day")).otherwise(F.col("period_start"))).alias("start_day"),
        F.when(~bare, F.when(move, F.col("basis_day")).otherwise(F.col("period_end"))).alias("end_day"),
        F.when(clarify, empty).otherwise(F.coalesce(F.try_element_at(sources, F.col("intent")), empty)).alias("required_sources"),
        F.when(clarify, empty).otherwise(F.coalesce(F.try_element_at(evidence, F.col("intent")), empty)).alias("required_evidence"),
        "requires_clarification",
    )
