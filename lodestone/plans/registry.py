"""Registry of the queries bound to the shared tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import prepare

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class BoundQuery:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, BoundQuery] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build`` under ``name``; ``sql`` is what DuckDB runs on the same tables."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = BoundQuery(name, run, sql)
        return build

    return register
