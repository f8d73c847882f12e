"""Audit of how filters interact, over every order in which they could be applied.

A document's failures are a mask of filters. In a given order it is removed by the first filter of
its mask, so all orders that begin with one prefix remove it at one step; in lexicographic order
those are one interval of ranks. Masks are counted, each count is added at the two ends of its
intervals, and a running sum over the ranks gives the totals of every order at once.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import spread_join
from lodestone.session import cut_lineage

MEASURES = ["removed", "good_lost", "toxic_lost"]


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank): the orders, by lexicographic rank, that remove a document of ``mask`` at ``step``.

    Filter i is bit i of a mask. Neighbouring intervals of one step are joined.
    """
    found: list[tuple[int, int, int, int]] = []

    def follow(mask: int, prefix: list[int], rank: int) -> None:
        left = [i for i in range(filters) if i not in prefix]
        width = math.factorial(len(left) - 1)
        for nth, choice in enumerate(left):
            # The Lehmer digit of a choice is its place among what is left.
            start = rank + nth * width
            if mask >> choice & 1:
                step = len(prefix) + 1
                if found and found[-1][:2] == (mask, step) and found[-1][3] == start:
                    found[-1] = (mask, step, found[-1][2], start + width)
                else:
                    found.append((mask, step, start, start + width))
            else:
                follow(mask, [*prefix, choice], start)

    for mask in range(1, 1 << filters):
        follow(mask, [], 0)
    return found


def order_totals(counts: DataFrame, letters: str) -> DataFrame:
    """Totals of every order and step for each part.

    ``counts`` has part, mask and the long columns n, good and toxic: documents with that mask, and
    those of them that count as good or toxic. Returns part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included; a part is there if
    ``counts`` has a row for it, also one of mask 0.
    """
    spark, filters = counts.sparkSession, len(letters)
    orders = math.factorial(filters)
    ends = [(mask, step, place, sign) for mask, step, first, end in removal_intervals(filters) for place, sign in ((first, 1), (end, -1))]
    table = spark.createDataFrame(ends, "mask int, step int, place int, sign int")  # depends on the number of filters alone
    counts = counts.groupBy("part", "mask").agg(*[F.sum(name).alias(name) for name in ("n", "good", "toxic")])
    fails = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    facts = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(fails(i), F.col("n")).otherwise(0)) for i in range(filters)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(filters)]).alias("alone"),
    )
    signed = [(F.col(one) * F.col("sign")).alias(name) for one, name in zip(("n", "good", "toxic"), MEASURES, strict=True)]
    changes = counts.join(F.broadcast(table), "mask").where(F.col("place") < orders).select("part", "step", "place", *signed)
    grid = facts.select("part", F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("place"), *[F.lit(0).cast("long").alias(name) for name in MEASURES]
    )
    changes = changes.unionByName(grid).groupBy("part", "step", "place").agg(*[F.sum(name).alias(name) for name in MEASURES])
    upto = Window.partitionBy("part", "step").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = changes.select("part", "step", "place", *[F.sum(name).over(upto).alias(name) for name in MEASURES])
    names = ["".join(order) for order in permutations(letters)]  # in lexicographic order of the places of the letters
    order = F.element_at(F.split(F.lit(",".join(names)), ","), F.col("place") + 1)
    rows = summed.withColumn("filter_order", order).withColumn("filter", F.expr(f"instr('{letters}', substring(filter_order, step, 1))"))
    gone = Window.partitionBy("part", "place").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("part", "filter")
    rows = rows.withColumns({"gone": F.sum("removed").over(gone), "shapley": F.sum("removed").over(every)})
    # One row a part: broadcast behind a check of their number.
    joined = spread_join(rows, facts, ["part"])
    return joined.select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), "removed",
        (F.element_at("fails", F.col("filter")) - F.col("removed")).alias("redundant"), F.element_at("alone", F.col("filter")).alias("unique_fails"),
        "good_lost", "toxic_lost", "shapley",
    )


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and the controls 9 to 13."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda word: word != "")


def text_failures(text: Column) -> Column:
    """Mask of the filters that look at one text: A short, B repetitive, C many capitals, D holds symbols of markup."""
    held = words(text)
    counts = F.struct(F.size(held).alias("words"), F.size(F.array_distinct(held)).alias("distinct"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    flags = [
        counts["words"] < 200, counts["distinct"] * 100 < counts["words"] * 50, capitals * 100 > F.length(text) * 3, text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags[1:], 1)), F.when(flags[0], 1).otherwise(0))


def with_earlier_copies(rows: DataFrame, text_key: str, row_id: str) -> DataFrame:
    """``rows`` with ``is_copy``: whether any row of a smaller ``row_id`` has the same ``text_key``.

    A row without an id is no copy and makes none. The first id of each text is found by a map-side
    combined minimum and marked by a join on text and id together, so a text of a third of all rows
    is dealt over all tasks.
    """
    firsts = rows.where(F.col(row_id).isNotNull()).groupBy(text_key).agg(F.min(row_id).alias(row_id)).withColumn("__first", F.lit(True))
    named = rows.where(F.col(row_id).isNotNull()).join(firsts, [text_key, row_id], "left")
    marked = named.withColumn("is_copy", F.col("__first").isNull()).drop("__first")
    return marked.unionByName(rows.where(F.col(row_id).isNull()).withColumn("is_copy", F.lit(False)))


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Interaction of five filters over whole texts of ``documents`` (doc_id, text, lang), by language.

    Filters fail a text that A: has under 200 words, B: has under half as many distinct words as
    words, C: has over 3 capitals in 100 characters, D: holds any of ``#$%&*|``, E: equals a text of
    a smaller doc_id. A null text is empty, a null lang is the empty part. Repeated rows count each;
    equal rows are no copies of each other, a row without doc_id is no copy and has no label.
    ``labels`` (doc_id, quality, toxic): a document is good or toxic if any of its label rows says 1.
    Texts are read once and not shuffled; keys, masks and a digest are. An empty table gives an
    empty result. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(documents.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    ))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # Repeated rows become one before the joins, so no id is hot.
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    copies = with_earlier_copies(rows, "digest", "doc_id")
    named = copies.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left")
    both = named.unionByName(copies.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    weight = lambda name: F.sum(F.col("n") * F.coalesce(F.col(name), F.lit(0)))
    counts = both.groupBy("part", (F.col("mask") + F.when(F.col("is_copy"), 16).otherwise(0)).alias("mask")).agg(
        F.sum("n").alias("n"), weight("good").alias("good"), weight("toxic").alias("toxic")
    )
    return order_totals(cut_lineage(counts), "ABCDE")
