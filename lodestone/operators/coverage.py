"""Coverage reports: one pass of grouping sets instead of one counter per dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.functions.text import fold_case, collapse


def coverage(df: DataFrame, key: str, dimensions: Sequence[str], measures: Sequence[Column] = ()) -> DataFrame:
    """AGG-03 / AGG-06 / AGG-11: counts per key, and per key and each dimension, in long form.

    ``dimension`` names the grouping (``total`` for the key alone) and ``value`` its value.
    """
    sets = [[key]] + [[key, name] for name in dimensions]
    grouped = df.groupingSets(sets, key, *dimensions).agg(
        *[F.grouping(name).alias(f"__{name}") for name in dimensions], F.count(F.lit(1)).alias("n"), *measures
    )
    dimension, value = F.lit("total"), F.lit(None).cast("string")
    for name in dimensions:
        present = F.col(f"__{name}") == 0
        dimension = F.when(present, F.lit(name)).otherwise(dimension)
        value = F.when(present, F.col(name).cast("string")).otherwise(value)
    extra = [c for c in grouped.columns if c not in {key, "n", *dimensions} and not c.startswith("__")]
    return grouped.select(key, dimension.alias("dimension"), value.alias("value"), "n", *extra)


def shared_titles(items: DataFrame, key: str = "security_id", title_key: Column | None = None) -> DataFrame:
    """AGG-04: titles carried by more than one publisher, per key; titles are equal when their ``title_key`` is (case and blanks aside by default)."""
    title = collapse(fold_case("title")) if title_key is None else title_key
    groups = items.groupBy(key, title.alias("title_key")).agg(
        F.min("publisher_host").alias("low"), F.max("publisher_host").alias("high")
    )
    return groups.groupBy(key).agg(F.count_if(F.col("low") != F.col("high")).alias("shared_titles"))


def cumulative_at(items: DataFrame, checkpoints: Sequence[str], key: str = "security_id", time: str = "published_at") -> DataFrame:
    """AGG-05: items up to and including each checkpoint.

    Rows are first counted per key and first checkpoint they reach; the running sum then spans
    only the checkpoints.
    """
    marks = sorted(checkpoints)
    grid = F.array(*[F.lit(mark).cast("timestamp") for mark in marks])
    reached = F.size(F.filter(grid, lambda mark: mark < F.col(time)))
    counts = items.where(reached < len(marks)).groupBy(key, reached.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    keys = items.select(key).distinct()
    cells = keys.select(key, F.posexplode(grid).alias("place", "checkpoint")).join(counts, [key, "place"], "left")
    running = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.select(key, "checkpoint", F.sum(F.coalesce("n", F.lit(0))).over(running).alias("cumulative"))


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    """AGG-07: rows per rejection reason; accepted rows count as ``retained``."""
    return df.groupBy(F.coalesce(reason, F.lit("retained")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_coverage(documents: DataFrame) -> DataFrame:
    """AGG-08: documents, bands, facts and reports by source, and by source and security."""
    return documents.rollup("source_type", "security_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("band") == "pre_market").alias("pre_market"),
        F.count_if(F.col("band") == "intraday").alias("intraday"), F.sum("fact_count").alias("facts"),
        F.countDistinct("report_id").alias("reports"), F.grouping("source_type").alias("all_sources"),
        F.grouping("security_id").alias("all_securities"),
    )


def band_coverage(documents: DataFrame, key: str = "security_id", time: str = "published_at") -> DataFrame:
    """AGG-09: rows before and after the opening hour, and whether the set is ready."""
    rules = fixed.COVERAGE_READY
    early = times.time_band(time) == "pre_market"
    counts = documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(early).alias("pre_market"), F.count_if(~early).alias("intraday")
    )
    ready = (
        (F.col("total") >= rules["total"]) & (F.col("pre_market") >= rules["pre_market"]) & (F.col("intraday") >= rules["intraday"])
    )
    return counts.withColumn("ready", ready)


def window_summary(items: DataFrame, start: Column, end: Column, time: str = "published_at") -> DataFrame:
    """AGG-10: raw, valid, invalid and in-window counts with the time bounds."""
    value = F.col(time)
    return items.agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(value.isNotNull()).alias("valid"), F.count_if(value.isNull()).alias("invalid"),
        F.count_if(value.between(start, end)).alias("in_window"), F.min(value).alias("oldest"), F.max(value).alias("newest"),
    )


def entry_coverage(entries: DataFrame) -> DataFrame:
    """AGG-13: glossary entries by review status, and those fit for use."""
    status = F.col("usage_review_status")
    usable = (status == "approved") & F.col("corpus_ingest_allowed") & (F.col("content_origin") != "synthetic")
    return entries.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(usable).alias("approved_usable"),
        *[F.count_if(status == name).alias(name) for name in ("synthetic", "pending", "rejected")],
    )


def lineage_summary(members: DataFrame, key: str) -> DataFrame:
    """AGG-26: article lineage stays unknown until someone confirms it."""
    zero = F.lit(0).cast("bigint")
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("unknown_count")).select(
        key, zero.alias("confirmed_independent_count"), zero.alias("confirmed_republication_count"), "unknown_count"
    )
