"""Stable ids, row fingerprints and table checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions.text import BLANKS, ColumnLike, as_column, fold_case


def sha256(*parts: ColumnLike, sep: str = "|") -> Column:
    """HSH-01: SHA-256 over the joined parts."""
    return F.sha2(F.concat_ws(sep, *[as_column(part) for part in parts]), 256)


def stable_id(kind: str, *parts: ColumnLike, sep: str = "|") -> Column:
    return F.concat(F.lit(kind + ":"), sha256(*parts, sep=sep))


def lineage_key(security_id: ColumnLike, report_name: ColumnLike, prefix: str = fixed.LINEAGE_PREFIX) -> Column:
    """HSH-02: one key for a filing and its corrections."""
    name = F.regexp_replace(fold_case(F.regexp_replace(as_column(report_name), prefix, "")), BLANKS, "")
    return stable_id("lineage", as_column(security_id), name)


def scoped_session(session_id: ColumnLike, checkpoint: ColumnLike, legacy: str = "legacy", prefix: str = "scoped-") -> Column:
    """HSH-03: session key bound to one market checkpoint."""
    scoped = F.concat(F.lit(prefix), sha256(session_id, checkpoint, sep="\n"))
    return F.when(as_column(checkpoint) == legacy, as_column(session_id)).otherwise(scoped)


def canonical_json(columns: Sequence[str]) -> Column:
    """JSN-01: JSON of the named columns in name order, nulls kept."""
    return F.to_json(F.struct(*[F.col(name) for name in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(columns: Sequence[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def table_checksum(df: DataFrame, volatile: Sequence[str] = (), row_hash: Column | None = None) -> DataFrame:
    """CHK-01: one order-free checksum of a table of any size.

    Every row hash is cut into eight 32-bit words that are summed exactly; the digest of the sums
    identifies the multiset of rows. Sums combine on the map side, so nothing is sorted or collected.
    """
    hashed = fingerprint([name for name in df.columns if name not in set(volatile)]) if row_hash is None else row_hash
    return hash_sums(df.select(hashed.alias("row_hash")).groupBy()).select("row_count", digest_of_sums().alias("checksum"))


def hash_sums(grouped: GroupedData) -> DataFrame:
    """Row count and the exact sums of the eight 32-bit words of ``row_hash``, per group."""
    words = [
        F.sum(F.conv(F.substring("row_hash", 1 + 8 * index, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{index}")
        for index in range(8)
    ]
    return grouped.agg(F.count(F.lit(1)).alias("row_count"), *words)


def digest_of_sums() -> Column:
    """The digest of the sums that ``hash_sums`` gives."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"w{index}"), F.lit(0)).cast("decimal(30,0)").cast("string") for index in range(8)]), 256)
