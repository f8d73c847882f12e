"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): node and root, the smallest node it can reach, for each node that is not its own root.

    Self-loops and nulls are dropped. A round hangs the larger neighbours of every node on the
    smallest one, then the smaller ones; a chain of n edges needs about log2(n) rounds. Minima are
    combined before the shuffle, so a hub's neighbours never meet in one task, and the joins may be
    split by Spark.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = cut_lineage(clean)
    before = _state(held)
    while True:
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        held = cut_lineage(small.unionByName(least.withColumnRenamed("m", "b")).distinct())
        now = _state(held)
        if now == before:
            return held.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
