"""Inventories, bundles, quarantine and neighbours against plain re-statements."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import coverage, market
from lodestone.sources import sinks
from lodestone.streaming import flows

REGISTER = "source_type string, usage_review_status string, corpus_ingest_allowed boolean, external_llm_processing_allowed boolean"
DOCS = "document_id string, source_type string, security_id string, band string, fact_count int, report_id string, published_at timestamp, text string"
BASIS = "2024-01-02 00:00:00"


def inventory_rows():
    chance = random.Random(4)
    hot = [("a b+c:d/e", chance.randrange(9), chance.randrange(50), "ü\n\"x\"") for _ in range(300)]
    rest = [(f"k{i % 3}", i % 5, None if i % 7 == 0 else i, None) for i in range(60)]
    return [*hot, *rest, *rest[:10], (None, 1, 1, "")]


def test_inventory_bytes_do_not_depend_on_the_layout(spark, tmp_path):
    rows = inventory_rows()
    names = ["key", "day", "number", "note"]
    want = defaultdict(list)
    for row in rows:
        want[row[0]].append(row)
    seen = []
    for run, tasks in enumerate((1, 7)):
        path = str(tmp_path / f"run{run}")
        frame = spark.createDataFrame(rows if run else rows[::-1], "key string, day int, number int, note string").repartition(tasks)
        sinks.write_inventory(frame, path, "key", ["day", "number"], 40)
        seen.append({(row["key"], row["part"]): row["sha256"] for row in sinks.inventory_hashes(spark, path, "key").collect()})
    assert seen[0] == seen[1]
    expected = {}
    for key, group in want.items():
        lines = [json.dumps(dict(sorted(zip(names, row, strict=True))), ensure_ascii=False, separators=(",", ":")) for row in group]
        none_first = lambda value: (value is not None, value or 0)
        placed = [line for _, _, line in sorted((none_first(row[1]), none_first(row[2]), line) for row, line in zip(group, lines, strict=True))]
        for part in range(-(-len(placed) // 40)):
            text = "".join(line + "\n" for line in placed[part * 40 : part * 40 + 40])
            expected[("__HIVE_DEFAULT_PARTITION__" if key is None else key, part)] = hashlib.sha256(text.encode()).hexdigest()
    assert seen[0] == expected


def test_empty_inventory(spark, tmp_path):
    path = str(tmp_path / "none")
    sinks.write_inventory(spark.createDataFrame([], "key string, day int"), path, "key", ["day"])
    assert not glob.glob(f"{path}/key=*")


def test_changed_part_is_named(spark, tmp_path):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("v"), F.current_timestamp().alias("at"))
    empty = rows.where("id < 0")
    first = sinks.write_snapshot({"t": rows, "none": empty}, str(tmp_path / "a"), ["at"], parts=8)
    again = sinks.write_snapshot({"t": rows.repartition(5), "none": empty}, str(tmp_path / "b"), ["at"], parts=8)
    tree = lambda df: sorted(map(str, df.collect()))
    assert tree(first) == tree(again) and sinks.changed_parts(first, again).isEmpty()
    counts = {(row["level"], row["table_name"]): row["row_count"] for row in first.where("level <> 'part'").collect()}
    assert counts == {("table", "t"): 500, ("table", "none"): 0, ("bundle", None): 500}

    schemas = {"t": rows.schema, "none": empty.schema}
    assert sinks.altered_parts(spark, str(tmp_path / "a"), schemas, ["at"]).isEmpty()
    folder = str(tmp_path / "a" / "t" / "__part=3")
    held = spark.read.parquet(folder)
    spoiled = spark.createDataFrame([(row["id"], 99, row["at"]) if at == 0 else tuple(row) for at, row in enumerate(held.collect())], held.schema)
    spoiled.write.mode("overwrite").parquet(folder)
    found = sinks.altered_parts(spark, str(tmp_path / "a"), schemas, ["at"])
    assert [tuple(row) for row in found.collect()] == [("t", 3, "changed")]
    only = sinks.altered_parts(spark, str(tmp_path / "a"), {"t": rows.schema}, ["at"], parts=[3])
    assert [tuple(row) for row in only.collect()] == [("t", 3, "changed")]
    assert sinks.altered_parts(spark, str(tmp_path / "a"), {"t": rows.schema}, ["at"], parts=[2]).isEmpty()

    other = sinks.write_snapshot({"t": rows.where("id <> 17"), "none": empty}, str(tmp_path / "c"), ["at"], parts=8)
    assert sinks.changed_parts(first, other).count() == 1
    top = lambda df: df.where("level = 'bundle'").first()["checksum"]
    assert top(first) != top(other)


def bundle_inputs(spark, change=None):
    docs = [[f"d{i}", ("news", "disclosure")[i % 2], "KRX:1", "pre_market", i, "r", None, "text"] for i in range(6)]
    register = [["news", "approved", True, True], ["disclosure", "approved", True, False]]
    if change:
        change(docs, register)
    frame = spark.createDataFrame([tuple(row[:6]) + (row[7],) + (row[6],) for row in docs], DOCS.replace("published_at timestamp, text string", "text string, at string"))
    return frame.withColumn("published_at", F.col("at").cast("timestamp")).drop("at"), spark.createDataFrame([tuple(row) for row in register], REGISTER)


@pytest.mark.parametrize(
    ("reason", "change"),
    [
        ("after_basis", lambda docs, register: docs[0].__setitem__(6, "2024-01-02 00:00:01")),
        ("repeated_id", lambda docs, register: docs[0].__setitem__(0, "d1")),
        ("source_not_registered", lambda docs, register: docs[0].__setitem__(1, "glossary")),
        ("source_closed", lambda docs, register: register[0].__setitem__(slice(1, 4), ["pending", False, False])),
        ("unapproved_open", lambda docs, register: register[1].__setitem__(1, "pending")),
    ],
)
def test_bundle_is_refused(spark, tmp_path, reason, change):
    docs, register = bundle_inputs(spark, change)
    assert reason in {row["reason"] for row in sinks.bundle_problems(docs, register, BASIS).collect()}
    with pytest.raises(ValueError, match=reason):
        sinks.write_bundle(docs, register, str(tmp_path / "bundle"), BASIS)
    assert not os.path.exists(tmp_path / "bundle")


def test_bundle_holds_coverage_and_register(spark, tmp_path):
    docs, register = bundle_inputs(spark)
    path = str(tmp_path / "bundle")
    manifest = sinks.write_bundle(docs, register, path, BASIS, parts=4)
    assert {row["table_name"] for row in manifest.where("level = 'table'").collect()} == set(sinks.BUNDLE_TABLES)
    stored = spark.read.parquet(f"{path}/coverage").where("source_type = 'news' AND security_id = 'KRX:1'").first()
    assert (stored["documents"], stored["facts"]) == (3, 6)
    schemas = {"documents": docs.schema, "coverage": coverage.snapshot_coverage(docs).schema, "permissions": register.schema}
    assert sinks.altered_parts(spark, path, schemas).isEmpty()


def test_neighbours_against_all_pairs(spark):
    chance = random.Random(9)
    rows = [(i, "hot" if chance.random() < 0.6 else f"k{chance.randrange(5)}", chance.randrange(0, 40_000)) for i in range(400)]
    rows += [(1000 + i, "hot", 5_000) for i in range(30)] + [(2000, "hot", 5_000 + 3_600), (2001, "hot", 5_000 - 3_600), (2002, "hot", 5_000 + 3_601), (2003, "old", -10), (2004, "old", 10)]
    frame = spark.createDataFrame([*rows, (3000, None, 1), (3001, "hot", None)], "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {i: sum(other == key and abs(at - s) <= 3_600 for _, other, at in rows) - 1 for i, key, s in rows}
    for width in (600, 3_600, 100_000):
        got = market.neighbours_within(frame, "key", "ts", 3_600, width)
        assert got.columns == [*frame.columns, "neighbours"]
        assert {row["id"]: row["neighbours"] for row in got.collect()} == want
    assert market.neighbours_within(frame.where("id < 0"), "key", "ts").isEmpty()


def test_future_and_undated_rows_go_to_quarantine(spark, tmp_path):
    rows = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.timestamp_seconds(F.col("id"))).alias("published_at"), F.timestamp_seconds(F.lit(20)).alias("basis_at"))
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    accepted, quarantined = flows.run_split(flows.flag_times(stream), "time_flag")
    assert {row["id"] for row in accepted.collect()} == {i for i in range(21) if i % 4}
    assert Counter(row["time_flag"] for row in quarantined.collect()) == {"missing_published_at": 10, "future_published_at": sum(i % 4 > 0 for i in range(21, 40))}
    os.mkdir(tmp_path / "none")
    nothing = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "none"))
    assert all(side.isEmpty() for side in flows.run_split(flows.flag_times(nothing), "time_flag"))
