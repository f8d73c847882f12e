"""Claims of answers: safety, numbers, uniqueness and section order."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column, fold, numeric_tokens


def unsafe_flags(folded: ColumnLike, patterns: Mapping[str, str] | None = None) -> Column:
    """TXT-14: one flag per family of unsafe wording, over folded text."""
    text = as_column(folded)
    if patterns is not None:
        return F.struct(*[text.rlike(pattern).alias(name) for name, pattern in patterns.items()])
    # Plain searches for the words that a pattern begins with go first; without any of them it cannot match.
    begun = {name: reduce(or_, [text.contains(stem) for stem in stems]) for name, stems in fixed.UNSAFE_ANSWER_STEMS.items()}
    return F.struct(*[
        (begun[name] & text.rlike(pattern) if name in begun else text.rlike(pattern)).alias(name) for name, pattern in fixed.UNSAFE_ANSWER_PATTERNS.items()
    ])


def is_unsafe(folded: ColumnLike, patterns: Mapping[str, str] | None = None) -> Column:
    flags = unsafe_flags(folded, patterns)
    found = F.lit(False)
    for name in fixed.UNSAFE_ANSWER_PATTERNS if patterns is None else patterns:
        found = found | flags[name]
    return found


def numeric_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """CMP-08: per claim, whether every number of its text occurs in its evidence.

    Numbers are matched as rows, so neither a hot evidence nor a long claim gathers in one place.
    """
    tokens = claims.select("claim_id", "evidence_ids", F.explode_outer(numeric_tokens("text")).alias("token"))
    needed = tokens.where(F.col("token").isNotNull())
    asked = needed.select("claim_id", "token", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    offered = evidence.select("evidence_id", F.explode(numeric_tokens("snippet")).alias("token")).distinct()
    found = asked.join(offered, ["evidence_id", "token"]).groupBy("claim_id").agg(F.countDistinct("token").alias("found"))
    wanted = needed.groupBy("claim_id").agg(F.count(F.lit(1)).alias("wanted"))
    repeated = claims.select("claim_id", (F.size("evidence_ids") != F.size(F.array_distinct("evidence_ids"))).alias("repeated"))
    zero = F.lit(0).cast("bigint")
    return repeated.join(wanted, "claim_id", "left").join(found, "claim_id", "left").select(
        "claim_id",
        ((F.coalesce("wanted", zero) == 0) | (~F.col("repeated") & (F.coalesce("found", zero) == F.col("wanted")))).alias("numbers_supported"),
    )


def gate_answers(claims: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """CMP-09: verdict per answer from its claims (``answer_id, section, text, supported``).

    One unsafe claim blocks the answer. A two-sided answer needs an uncertainty claim, unless the
    same text stands in more than one section.
    """
    marked = claims.withColumn("folded", fold("text")).withColumn("unsafe", is_unsafe("folded", patterns))
    kept = F.col("supported")
    by_text = marked.where(kept).groupBy("answer_id", "folded").agg(
        F.min("section").alias("low"), F.max("section").alias("high")
    ).groupBy("answer_id").agg(F.bool_or(F.col("low") != F.col("high")).alias("repeats_across"))

    def any_of(section: str) -> Column:
        return F.coalesce(F.bool_or(kept & (F.col("section") == section)), F.lit(False))

    answers = marked.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(kept).alias("accepted"), F.bool_or("unsafe").alias("blocked"),
        any_of("positive_factors").alias("positive"), any_of("risk_factors").alias("risk"), any_of("uncertainty").alias("hedged"),
    ).join(by_text, "answer_id", "left")
    one_sided_gap = F.col("positive") & F.col("risk") & ~F.col("hedged") & ~F.coalesce("repeats_across", F.lit(False))
    verdict = (
        F.when(F.col("blocked"), F.lit("safety_blocked")).when(F.col("accepted") == 0, F.lit("nothing_accepted"))
        .when(one_sided_gap, F.lit("missing_uncertainty")).otherwise(F.lit("accepted"))
    )
    rejected = F.when(verdict.isin("safety_blocked", "missing_uncertainty"), F.col("claims")).otherwise(F.col("claims") - F.col("accepted"))
    return answers.select("answer_id", verdict.alias("verdict"), rejected.alias("rejection_count"), "accepted")


def structure_problems(claims: DataFrame) -> DataFrame:
    """CMP-10: per answer, whether claims are unique and sections start with one summary and keep their order.

    Order is checked on section bounds (last position of a section before the first of the next),
    which are a handful of rows per answer.
    """
    places = F.create_map(*[part for index, name in enumerate(fixed.ANSWER_SECTIONS) for part in (F.lit(name), F.lit(index))])
    rows = claims.withColumn("folded", fold("text")).withColumn("section_place", F.try_element_at(places, F.col("section")))
    repeats = rows.groupBy("answer_id", "folded", "evidence_ids").agg(F.count(F.lit(1)).alias("n")).groupBy("answer_id").agg(
        F.max("n").alias("most")
    )
    spread = rows.groupBy("answer_id", "folded").agg(F.min("section").alias("a"), F.max("section").alias("z")).groupBy("answer_id").agg(
        F.bool_or(F.col("a") != F.col("z")).alias("two_sections")
    )
    from pyspark.sql import Window

    bounds = rows.groupBy("answer_id", "section_place").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n")
    )
    previous = F.max("last").over(Window.partitionBy("answer_id").orderBy("section_place").rowsBetween(Window.unboundedPreceding, -1))
    ordered = bounds.withColumn("ok", F.coalesce(F.col("first") > previous, F.lit(True))).groupBy("answer_id").agg(
        F.bool_and("ok").alias("ordered"),
        F.coalesce(F.max(F.when(F.col("section_place") == 0, F.col("n"))), F.lit(0)).alias("summaries"),
    )
    joined = ordered.join(repeats, "answer_id").join(spread, "answer_id")
    return joined.select(
        "answer_id", ((F.col("most") == 1) & ~F.col("two_sections")).alias("unique_claims"),
        (F.col("ordered") & (F.col("summaries") == 1)).alias("sections_in_order"),
    )
