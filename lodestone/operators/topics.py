"""Disclosure names and facts: categories, correction marks, topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import ColumnLike, as_column, contains_any, fold_case, let, phrase_topics


def compact(name: ColumnLike) -> Column:
    return F.replace(as_column(name), F.lit(" "), F.lit(""))


def report_category(name: ColumnLike, categories: Sequence[tuple[str, Sequence[str]]] | None = None) -> Column:
    """TXT-15: first category whose terms occur in the name without blanks."""
    rules = fixed.REPORT_CATEGORIES if categories is None else categories
    label = F.when(F.lit(False), F.lit(""))
    for category, words in rules:
        label = label.when(contains_any(compact(name), words), F.lit(category))
    return label.otherwise(F.lit("other"))


def correction_status(name: ColumnLike, remark: ColumnLike) -> Column:
    """TXT-15: withdrawal, correction, superseded, original or unknown."""
    note = compact(F.coalesce(as_column(remark), F.lit("")))
    return (
        F.when(compact(name).contains(fixed.WITHDRAWN_NAME) | note.contains(fixed.WITHDRAWN_REMARK), F.lit("withdrawal"))
        .when(as_column(name).rlike(fixed.CORRECTION_PREFIX), F.lit("correction"))
        .when(note.contains(fixed.SUBSEQUENT_CORRECTION_REMARK), F.lit("superseded"))
        .when(as_column(name) != "", F.lit("original")).otherwise(F.lit("unknown"))
    )


def report_markers(name: ColumnLike, remark: ColumnLike, corrects: ColumnLike | None = None) -> Column:
    """TXT-16: struct of the first bracket mark and what it and the remark say."""
    mark = F.nullif(F.regexp_extract(as_column(name), r"\[([^\]]+)\]", 1), F.lit(""))
    note = F.coalesce(as_column(remark), F.lit(""))
    linked = F.lit(None).cast("string") if corrects is None else as_column(corrects)
    marked = F.coalesce(mark.isin(fixed.CORRECTION_MARKERS), F.lit(False))
    update = F.coalesce(mark.isin(fixed.UPDATE_MARKERS), F.lit(False))
    return F.struct(
        mark.alias("marker"),
        (marked | linked.isNotNull()).alias("is_correction"),
        F.when(marked, F.lit("report_marker")).when(linked.isNotNull(), F.lit("explicit_link")).alias("correction_type"),
        linked.alias("correction_of"),
        update.alias("is_update_variant"),
        F.when(update, mark).alias("update_variant_type"),
        F.coalesce(mark == fixed.CORRECTION_ORDER_MARKER, F.lit(False)).alias("has_correction_order"),
        F.coalesce(mark == fixed.CORRECTION_REQUEST_MARKER, F.lit(False)).alias("has_correction_request"),
        note.contains(fixed.SUBSEQUENT_CORRECTION_REMARK).alias("has_subsequent_correction"),
        note.contains(fixed.WITHDRAWN_REMARK).alias("is_withdrawn"),
    )


def fact_topics(category: ColumnLike, claim: ColumnLike, base: Mapping[str, Sequence[str]] | None = None) -> Column:
    """TXT-17: topics of the category plus quarters and phrases of the claim; none for an unknown category."""
    base = fixed.CATEGORY_TOPICS if base is None else base
    names = F.create_map(*[
        part for name, topics in base.items() for part in (F.lit(name), F.array(*[F.lit(topic) for topic in topics]))
    ])

    def topics(folded: Column) -> Column:
        quarters = F.regexp_extract_all(folded, F.lit(fixed.QUARTER_TOPIC), F.lit(0))
        return F.array_union(quarters, phrase_topics(folded, fixed.FACT_TOPIC_PHRASES))

    known = F.try_element_at(names, as_column(category))
    found = let(fold_case(F.coalesce(as_column(claim), F.lit(""))), topics)
    return F.when(known.isNull() | as_column(claim).isNull(), F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_union(known, found))
    )


def title_topics(name: ColumnLike, rules: Sequence[tuple[str, Sequence[str]]] | None = None) -> Column:
    """TXT-18: topics of every rule whose phrase occurs in the name without blanks."""
    rules = fixed.TITLE_TOPICS if rules is None else rules
    table = F.array(*[
        F.struct(F.lit(needle).alias("needle"), F.array(*[F.lit(topic) for topic in topics]).alias("topics")) for needle, topics in rules
    ])
    hits = F.filter(table, lambda rule: F.contains(compact(name), rule["needle"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda rule: rule["topics"]))))
