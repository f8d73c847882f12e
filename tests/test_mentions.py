"""Dictionary matching: one automaton, the join for larger dictionaries, and plain containment."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mentions

WORDS = ["alpha", "al", "phage", "ha g", "beta", "b", "삼성전자", "삼성", "ge b", "zz"]


def plain(texts, terms):
    return sorted((key, term) for key, text in texts for term in terms if term and text and term in text)


@pytest.fixture
def texts():
    chooser = random.Random(4)
    rows = [(i, "".join(chooser.choice(["al", "pha", "ge", " ", "b", "eta", "삼성", "전자"]) for _ in range(chooser.randint(0, 30)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "alphage beta" * 5000), (3, rows[3][1])]


@pytest.mark.parametrize("largest", [200_000, 2])
def test_containing_finds_every_term(spark, texts, monkeypatch, largest):
    monkeypatch.setattr(mentions, "DICTIONARY_TERMS", largest)
    frame = spark.createDataFrame(texts, "id long, t string")
    terms = spark.createDataFrame([(word, i) for i, word in enumerate([*WORDS, "", "alpha"])], "term string, number int")
    got = mentions.containing(frame, "t", terms, keep_text=False)
    assert got.columns == ["id", "term", "number"]
    assert sorted((row["id"], row["term"]) for row in got.collect()) == plain(texts, [*WORDS, "alpha"])


@pytest.mark.parametrize("largest", [200_000, 2])
def test_attribution_of_title_and_description(spark, monkeypatch, largest):
    monkeypatch.setattr(mentions, "DICTIONARY_TERMS", largest)
    rows = [(1, "A", "alpha rises", "beta too"), (2, "A", "nothing", "alpha here"), (3, "A", "beta only", "alpha here"), (4, "B", None, None), (5, "B", "beta alpha", "")]
    items = spark.createDataFrame(rows, "id long, security_id string, title string, description string")
    aliases = spark.createDataFrame([("A", "alpha"), ("B", "beta"), ("A", "alfa")], "security_id string, term string")
    got = {row["id"]: (row["primary_security_ids"], row["mentioned_security_ids"]) for row in mentions.attribute(items, "id", aliases).collect()}
    assert got == {1: (["A"], ["B"]), 2: (["A"], []), 5: (["A", "B"], [])}
    same = mentions.attribute(items, "id", {"A": ["alpha", "alfa"], "B": ["beta"]})
    assert {row["id"]: (row["primary_security_ids"], row["mentioned_security_ids"]) for row in same.collect()} == got


def test_large_dictionary_and_long_texts(spark):
    terms = spark.range(100_000).select(F.concat(F.lit("name "), F.col("id"), F.lit(";")).alias("term"))
    texts = spark.range(8).select("id", F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 10, F.col("id") * 10 + 5000), lambda i: F.concat(F.lit("x name "), i, F.lit(";")))).alias("t"))
    found = mentions.containing(texts, "t", terms, keep_text=False)
    assert found.count() == 8 * 5001
    # The text is read where it lies: nothing but the terms is exchanged, and no term stands in the plan.
    plan = found._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "name 99999" not in plan and len(plan) < 20_000


def test_no_terms(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, t string")
    assert mentions.find_mentions(texts, "id", "t", {}).count() == 0
    assert mentions.containing(texts, "t", spark.createDataFrame([], "term string")).count() == 0
