"""Sharding by sampled splitters, with DataFrame functions only.

Keys are drawn with weights proportional to row sizes, their quantiles cut the key space into
ranges, overfull ranges are subdivided, and exact sizes of the ranges place each row on one line of
bytes that is cut into shards. Only the sample and the range sizes, both bounded by parameters,
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

LEAST_KEY = -(2**63)


def _longs(values: list[int]) -> str:
    # The smallest long has no literal of its own.
    return "array(" + ", ".join(f"{v}L" if v != LEAST_KEY else "(-9223372036854775807L - 1L)" for v in values) + ")"


def splitters(sample: list[tuple[int, int]], parts: int) -> list[int]:
    """Distinct keys at the ``parts``-quantiles of a weighted sample; a row goes to the number of splitters at or below its key."""
    ordered = sorted(sample)
    total, cuts, seen = sum(weight for _, weight in ordered), [], 0
    for key, weight in ordered:
        before, seen = seen, seen + weight
        if before and (before * parts) // total != (seen * parts) // total and (not cuts or cuts[-1] != key):
            cuts.append(key)
    return cuts


def range_column(cuts: list[int], fan: int = 32) -> str:
    """SQL for the range of ``__key``: first among every ``fan``-th splitter, then among those that follow it."""
    if not cuts:
        return "0"
    coarse, groups = cuts[::fan], [cuts[i : i + fan] for i in range(0, len(cuts), fan)]
    step = f"size(filter({_longs(coarse)}, b -> b <= __key))"
    fine = "array(" + ", ".join(_longs(group) for group in groups) + ")"
    return f"CASE WHEN {step} = 0 THEN 0 ELSE ({step} - 1) * {fan} + size(filter(element_at({fine}, {step}), b -> b <= __key)) END"


def assign_shards(
    records: DataFrame, key: str, size: str, carried: list[str], shards: int = 40, ranges: int = 640, samples: int = 10_000
) -> DataFrame:
    """Shard and slot of every row so that the bytes of the shards are as near as whole rows allow.

    Returns ``carried`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each
    shard). ``key`` is a long; null keys come first. Rows with equal keys, or any range above twice
    its share, are subdivided by row, so no key is too hot. ``size`` is a positive long. An empty
    table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    base = cut_lineage(records.select(
        *carried, F.col(size).alias("__size"), F.coalesce(F.col(key), F.lit(LEAST_KEY)).alias("__key"),
        F.monotonically_increasing_id().alias("__row"),
    ))
    total = base.agg(F.sum("__size")).first()[0]
    if not total:
        return base.select(*carried, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    chance = F.pmod(F.xxhash64("__key", "__row"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    draws = F.floor(F.col("__size") * F.lit(samples / total) + chance)
    sample = [tuple(row) for row in base.select("__key", draws.alias("n")).where("n > 0").groupBy("__key").agg(F.sum("n")).collect()]
    ranged = base.withColumn("__range", F.expr(range_column(splitters(sample, ranges))))
    held = {row[0]: row[1] for row in ranged.groupBy("__range").agg(F.sum("__size")).collect()}
    share = max(1, total // ranges)
    pieces = [max(1, -(-held.get(i, 0) // (2 * share))) for i in range(max(held) + 1)]
    part = f"CAST(pmod(xxhash64(__row), element_at({_longs(pieces)}, __range + 1)) AS INT)"
    ranged = ranged.withColumn("__part", F.expr(part))
    line, bytes_before, rows_before = [], 0, 0
    for row in sorted(ranged.groupBy("__range", "__part").agg(F.sum("__size"), F.count(F.lit(1))).collect()):
        line.append((row[0], row[1], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + row[2], rows_before + row[3]
    # At most ``ranges`` + total / (2 x share) rows: bounded by the parameter.
    offsets = base.sparkSession.createDataFrame(line, "__range int, __part int, __bytes long, __rows long")
    inside = Window.partitionBy("__range", "__part").orderBy("__key", "__size", "__row").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"__upto": F.sum("__size").over(inside), "__nth": F.count(F.lit(1)).over(inside)})
    placed = placed.join(F.broadcast(offsets), ["__range", "__part"])
    middle = F.expr(f"((__bytes + __upto) * 2 - __size) * {shards} div {2 * total}")
    placed = cut_lineage(placed.select(*carried, middle.cast("int").alias("shard"), (F.col("__rows") + F.col("__nth") - 1).alias("__at")))
    counts, starts, before = dict(placed.groupBy("shard").count().collect()), [], 0
    for shard in range(shards):
        starts.append(before)
        before += counts.get(shard, 0)
    slot = F.col("__at") - F.expr(f"element_at({_longs(starts)}, shard + 1)")
    return placed.select(*carried, "shard", slot.alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Shards of near equal bytes (law ``bytes``) for ``documents`` (doc_id, text).

    A row weighs the UTF-8 bytes of its text plus 16; a null text weighs 16 and has checksum 0.
    Null and repeated doc_ids are rows like any other. Other columns are not read.
    """
    records = documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = assign_shards(records, "doc_id", "size", ["doc_id", "size", "text_crc32"], shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
