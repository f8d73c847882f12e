"""Unions of collection runs and corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_runs(runs: Sequence[DataFrame], keys: Sequence[str], calls: str = "api_calls") -> DataFrame:
    """SET-02: bag union of runs with their row and call totals."""
    rows = reduce(lambda left, right: left.unionByName(right), runs)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_total"), F.sum(calls).alias("calls"))


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """SRC-12: base rows plus extra rows whose id the base lacks."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))
