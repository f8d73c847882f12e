"""The stages of the corpus pipeline, each against a plain re-statement on its own input."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.suffixes import LAST
from tests.llm.conftest import prose
from tests.llm.test_near_copies import components
from tests.llm.test_operators import near_copies

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are absent")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(make_documents, odd_texts):
    rows = [(key, text) for key, text in dict(odd_texts).items()] + [(100 + key, text) for key, text in near_copies(1)]
    rows += [(500 + i, prose(i, 40) + " " + prose(77, 15)) for i in range(6)]
    return make_documents(rows), rows


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]


def test_language_stage_keeps_texts_with_letters(spark, documents):
    frame, rows = documents
    kept = STAGE["language_id"](spark, frame, SF_DIR)
    assert kept.columns == frame.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(row) for row in frame.collect() if re.search(r"[^\W\d_]", row["text"] or ""))


def test_jaccard_stage_keeps_one_of_each_group(spark, documents):
    frame, rows = documents
    kept = STAGE["ngram_jaccard"](spark, frame, SF_DIR)
    assert kept.columns == frame.columns
    first = {key for key, _, component in components([row for row in rows if row[0] is not None]) if key == component}
    assert Counter(row["doc_id"] for row in kept.collect()) == Counter(key for key, _ in rows if key is None or key in first)


def test_suffix_stage_cuts_later_copies(spark, documents):
    frame, rows = documents
    kept = STAGE["suffix_dedup"](spark, frame, SF_DIR)
    assert kept.columns == frame.columns
    first: dict[bytes, int] = {}
    place = lambda key: LAST if key is None else key
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first[data[i : i + 50]] = min(first.get(data[i : i + 50], LAST), place(key))
    want = Counter()
    for key, text in rows:
        data = (text or "").encode()
        gone = [any(first[data[j : j + 50]] < place(key) for j in range(max(0, i - 49), min(i, len(data) - 50) + 1)) for i in range(len(data))]
        if not data or not all(gone):
            left = bytes(byte for byte, out in zip(data, gone, strict=True) if not out).decode(errors="ignore")
            want[(key, left, len(left))] += 1
    assert Counter((row["doc_id"], row["text"], row["n_chars"]) for row in kept.collect()) == want


def test_mixing_stage_repeats_whole_rows(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mixed = STAGE["mixing"](spark, frame, SF_DIR)
    assert mixed.columns == frame.columns
    assert mixed.exceptAll(mixed.distinct()).count() == mixed.count() - mixed.distinct().count()
    assert mixed.select("doc_id", "text").distinct().exceptAll(frame.select("doc_id", "text").distinct()).count() == 0
    # What the labels call clean stays.
    clean = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    lost = frame.join(clean, "doc_id").join(mixed.select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert lost <= 0.05 * clean.count()


def test_packing_stage_places_every_token(spark, documents):
    frame, rows = documents
    packed = STAGE["packing"](spark, frame, SF_DIR).collect()
    places = defaultdict(list)
    for row in packed:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(row["piece"] == 0 for row in packed) == len(rows)


def test_run_and_empty_documents(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name
