"""Sieves of ids against the plain anti join."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import sieve as module
from lodestone.llm.sieve import caught, sieve, slot, without_ids

SCHEMA = "doc_id long, text string, __gone string, slot int"


@pytest.mark.parametrize("bits", [64, 256, 1 << 26])
def test_without_ids_at_every_filling(spark, monkeypatch, bits):
    """Small sieves are full: all rows are joined, and the result is the same."""
    monkeypatch.setattr(module, "SIEVE_BITS", bits)
    rows = [(i, f"t{i}", "x", i) for i in range(200)] + [(7, "again", None, 0), (7, "again", None, 0), (8, None, None, 1), (None, "no id", "y", 2), (None, "no id", "y", 2), (-5, "", "", 3)]
    gone = [*range(0, 200, 3), 7, None, 7, 999]
    frame = spark.createDataFrame(rows, SCHEMA)
    left = without_ids(frame, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    assert left.columns == frame.columns
    assert Counter(map(tuple, left.collect())) == Counter(row for row in rows if row[0] is None or row[0] not in set(gone))


def test_empty_sides(spark):
    frame, none = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert without_ids(frame, none.select("doc_id")).count() == 2
    assert without_ids(none, frame.select("doc_id")).count() == 0


def test_every_id_is_caught(spark):
    ids = spark.range(-3000, 3000).withColumnRenamed("id", "doc_id")
    bits = sieve(ids.where("doc_id % 2 = 0"), "doc_id")
    rows = ids.select("doc_id", slot("doc_id").alias("at")).toPandas()
    held = caught(bits, rows["at"].to_numpy())
    even = rows["doc_id"].to_numpy() % 2 == 0
    assert held[even].all() and held[~even].mean() < 0.01
    assert np.bitwise_count(bits).sum() <= 3000 and ids.select(F.max(slot("doc_id"))).first()[0] < module.SIEVE_BITS
