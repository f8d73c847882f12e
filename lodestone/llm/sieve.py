"""Bit sieves of ids: rows that surely have no partner are told before their texts cross a shuffle.

A sieve has one fixed size whatever the corpus. It never decides a result: what it lets through is
joined exactly, and where ids fill it up it only lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

# 8 MB of bits; at most a million 64-bit words reach the driver.
SIEVE_BITS = 1 << 26


def slot(column: str) -> Column:
    """The bit of an id; null for a null id."""
    return F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(SIEVE_BITS)))


def sieve(ids: DataFrame, column: str) -> np.ndarray:
    """The bits of all ids, by words of 64."""
    at = ids.select(slot(column).alias("at")).where("at IS NOT NULL")
    words = at.groupBy(F.expr("CAST(at DIV 64 AS int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS int)))").alias("bits"))
    found = words.toArrow()
    bits = np.zeros(SIEVE_BITS // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def caught(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def may_hold(bits: np.ndarray, column: str) -> Column:
    """False where the id is surely not among those of the sieve, and for a null id."""

    @F.pandas_udf("boolean")
    def look(slots: pd.Series) -> pd.Series:
        held = slots.notna().to_numpy()
        out = np.zeros(len(slots), dtype=bool)
        out[held] = caught(bits, slots.to_numpy()[held].astype(np.int64))
        return pd.Series(out)

    return look(slot(column))


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose ``column`` is null or not among ``ids`` (a column of that name), repeated rows kept.

    Only ids cross a shuffle, and the whole rows of the few that the sieves cannot settle: rows caught by
    the sieve of ``ids`` without being one of them, told by a second sieve of just these.
    """
    gone = cut_lineage(ids.select(F.col(column).cast("long").alias("__gone")).where("__gone IS NOT NULL").distinct())
    first = may_hold(sieve(gone, "__gone"), column)
    spared = rows.where(first).select(F.col(column).cast("long").alias("__id")).distinct()
    spared = cut_lineage(spared.join(gone, F.col("__id") == F.col("__gone"), "left_anti"))
    clear = rows.where(~first)
    if spared.isEmpty():
        return clear
    unsettled = rows.where(first).where(may_hold(sieve(spared, "__id"), column))
    return clear.unionByName(unsettled.join(spared, F.col(column).cast("long") == F.col("__id"), "left_semi"))
