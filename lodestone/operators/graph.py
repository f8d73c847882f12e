"""Iterative graph steps: roots of correction chains by pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


def chain_roots(edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """JOI-14: root of every node that corrects another, per ``scope``; and the nodes on or into a cycle.

    ``edges`` has ``scope``, ``node``, ``parent`` with one parent per node. Each round doubles the
    distance covered, so a chain of n edges needs log2(n) rounds; whatever still moves after that
    is caught in a cycle.
    """
    state = cut_lineage(edges.select(scope, "node", F.col("parent").alias("top")).distinct())
    rounds = math.ceil(math.log2(max(state.count(), 1) + 1)) + 1
    moving = state.limit(0)
    for _ in range(rounds):
        # One row per node. The sizes Spark guesses for it come from the compressed files, so it is never left to broadcast it.
        hops = state.select(scope, F.col("node").alias("top"), F.col("top").alias("next_top"))
        jumped = cut_lineage(state.join(hops.hint("merge"), [scope, "top"], "left"))
        moving = jumped.where(F.col("next_top").isNotNull())
        state = jumped.select(scope, "node", F.coalesce("next_top", "top").alias("top"))
        if moving.isEmpty():
            return state.withColumnRenamed("top", "root"), moving.select(scope, "node")
    resolved = state.join(moving.select(scope, "node"), [scope, "node"], "left_anti")
    return resolved.withColumnRenamed("top", "root"), moving.select(scope, "node")
