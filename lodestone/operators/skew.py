"""Building blocks that stay safe when one key holds a large share of all rows.

* ``keep_first`` / ``top_rows``: per-group limits that Spark cuts on the map side
  (``WindowGroupLimit``), so a hot key never reaches one task whole.
* ``spread_join``: broadcast only after the row bound was checked, else the salted join.
* ``salted_join``: equi-join whose hot left keys are spread over salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
DEFAULT_SALTS = 16


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of every group in ``order``; the rank column is kept when named."""
    name = rank_col or "__rank"
    spec = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(spec)).where(F.col(name) <= F.lit(k))
    return ranked if rank_col else ranked.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_rows(df, keys, order, 1)


def within_rows(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no further than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def is_small(df: DataFrame, text: str | None = None, max_rows: int = BROADCAST_ROWS, max_chars: int = 32_000_000) -> bool:
    """Size check of a whole input table in one cheap aggregate: rows and, when named, text volume.

    Tables derived row by row from it (its filters, its tokens) are then bounded as well.
    """
    chars = F.sum(F.length(text)) if text else F.lit(0)
    rows, volume = df.agg(F.count(F.lit(1)), chars).first()
    return rows <= max_rows and (volume or 0) <= max_chars


def hinted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool, how: str = "inner") -> DataFrame:
    """Broadcast when the caller has checked the size, else the salted join."""
    return left.join(F.broadcast(right), list(keys), how) if small else salted_join(left, right, keys, how)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """Equi-join on ``keys`` with hot left keys split over ``salts`` tasks.

    The right side is repeated once per salt, so it should hold few rows per key
    (one, when it is an aggregate or a lookup). The copies are shuffled whatever size Spark guesses
    for them: guesses come from compressed files and know nothing of the copies.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"salting does not preserve a {how} join")
    # Salting by the row content keeps retries of a lost task on the same salt.
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Broadcast ``right`` when its checked size allows it, else fall back to the salted join."""
    if within_rows(right, max_rows):
        return left.join(F.broadcast(right), list(keys), how)
    return salted_join(left, right, keys, how, salts)
