"""Deduplication by two keys in sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.skew import keep_first, spread_join
from lodestone.session import cut_lineage


def two_key_dedup(rows: DataFrame, scope: str, first_key: str, second_key: str, order: str) -> DataFrame:
    """WIN-02 / SET-01: walk rows in ``order`` and keep one unless a kept row shares either key with it.

    A dropped row blocks nobody, so this is not two ``dropDuplicates``. The walk is done in rounds:
    a row that comes first for both of its keys is certainly kept, rows sharing a key with a kept one
    are certainly dropped, and the rest goes on. Copies with equal keys collapse beforehand, firsts
    are map-side combined minima, and no group is ever gathered. A null key is shared with nobody, a
    row without both keys is kept, a null scope is a scope of its own, and rows of equal order are
    walked in the order of their keys and then of a hash of the row.
    """
    spelled = lambda name: F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))

    def key(own: str, other: str) -> Column:
        # Without a key of its own a row is told apart by the other one, so it comes first for certain.
        named = F.to_json(F.array(spelled(scope), spelled(own)))
        return F.when(F.col(own).isNotNull(), named).otherwise(F.to_json(F.array(spelled(scope), F.lit("-"), spelled(other))))

    keyless = F.col(first_key).isNull() & F.col(second_key).isNull()
    keyed = rows.where(~keyless).withColumns({"__first": key(first_key, second_key), "__second": key(second_key, first_key)})
    # The pair of keys is unique here, so places never tie and every round has a winner: the very first row.
    place = F.struct(F.min(order).alias("at"), F.first("__first").alias("first"), F.first("__second").alias("second"))
    left = cut_lineage(keyed.groupBy("__first", "__second").agg(place.alias("__at")))
    kept = None
    while not left.isEmpty():
        per_first = left.groupBy("__first").agg(F.min_by("__second", "__at").alias("__second"), F.min("__at").alias("__at"))
        per_second = left.groupBy("__second").agg(F.min_by("__first", "__at").alias("__first"), F.min("__at").alias("__at"))
        winners = cut_lineage(per_first.join(per_second, ["__first", "__second", "__at"]).select("__first", "__second"))
        if winners.isEmpty():
            raise RuntimeError("a round of the two-key walk kept no row")
        kept = winners if kept is None else kept.unionByName(winners)
        rest = spread_join(left, winners.select("__first"), ["__first"], "left_anti")
        left = cut_lineage(spread_join(rest, winners.select("__second"), ["__second"], "left_anti"))
    alone = rows.where(keyless)
    if kept is None:
        return alone
    chosen = keyed.join(kept, ["__first", "__second"], "left_semi")
    return keep_first(chosen, ["__first", "__second"], [F.col(order), F.xxhash64(*rows.columns)]).select(*rows.columns).unionByName(alone)
