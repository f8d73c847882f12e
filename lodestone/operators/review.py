"""Review lists of selected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_rows(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """JOI-22: every selected id with its document; a missing document, time or URL is a problem row."""
    found = documents.select("document_id", "published_at", "source_url", F.lit(True).alias("__found"))
    problem = (
        F.when(F.col("__found").isNull(), F.lit("no_document")).when(F.col("published_at").isNull(), F.lit("no_time"))
        .when(F.col("source_url").isNull(), F.lit("no_url"))
    )
    return selected.join(found, "document_id", "left").withColumn("problem", problem).drop("__found")
