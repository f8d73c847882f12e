"""Retrieval over fresh evidence against the filters, the freshness stage and BM25 run one after another."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence as ev
from lodestone.operators import filters, freshness, retrieval
from lodestone.operators.fresh_retrieval import fresh_retrieve, fresh_sets

BASIS = dt.datetime(2024, 6, 1, 3)
DOCUMENT = (
    "document_id string, source_type string, primary_security_ids array<string>, mentioned_security_ids array<string>, title string, published_at timestamp, source_url string, text string, "
    "publisher string, document_type string, report_type string, content_level string, external_allowed boolean, is_withdrawn boolean, is_correction boolean, has_subsequent_correction boolean, correction_of string"
)
REQUEST = "request_id string, query string, security_id string, source_types array<string>, start_day date, end_day date, as_of timestamp, document_types array<string>, top_k int, basis_at timestamp"


def document(key, source="news", age=1.0, text="memory risk", security=("A",), kind=None, withdrawn=False, corrects=None, at=BASIS):
    when = None if age is None else at - dt.timedelta(days=age)
    return (key, source, list(security), [], "title", when, f"https://x.example.com/{key.replace(':', '/')}", text, "p", kind, "", "", True, withdrawn, corrects is not None, False, corrects)


def request(key="r", sources=("news",), query="memory risk", start=None, end=None, as_of=None, kinds=None, top=10, basis=BASIS, security="A"):
    return (key, query, security, list(sources), start, end, as_of, kinds, top, basis)


def tables(spark, documents, requests):
    docs = spark.createDataFrame(documents, DOCUMENT)
    accepted, _ = ev.to_evidence(docs)
    return accepted, docs, spark.createDataFrame(requests, REQUEST)


def one_after_another(evidence, documents, requests):
    """The chain of plain stages over all pairs."""
    asked = fresh_sets(requests)
    sets = asked.select("filter_set", *filters.FILTER_COLUMNS, "basis_at").dropDuplicates(["filter_set"])
    kept = filters.filter_evidence(evidence, requests, documents).select(
        F.col("filter_set").alias("plain"), "evidence_id", "document_id", "source_type", "effective_at"
    )
    named = filters.with_filter_sets(requests).select(F.col("filter_set").alias("plain"), "request_id").join(asked.select("request_id", "filter_set"), "request_id")
    candidates = kept.join(named.select("plain", F.col("filter_set").alias("scope")).distinct(), "plain").join(
        documents.select("document_id", "is_correction", "has_subsequent_correction", "is_withdrawn", "correction_of"), "document_id"
    )
    scopes = sets.select(F.col("filter_set").alias("scope"), "source_types", "start_day", "end_day", "basis_at")
    columns = ["scope", "evidence_id", "document_id", "source_type", "effective_at", "is_correction", "has_subsequent_correction", "is_withdrawn", "correction_of"]
    retained, _, _ = freshness.apply_freshness(candidates.select(*columns), scopes)
    fresh = retained.select("evidence_id", F.col("scope").alias("filter_set"))
    # The same scores, but with the sets told apart by their basis times.
    asked = asked.withColumn("effective_k", F.least("top_k", F.lit(10)))
    scores, tokens, statistics = retrieval.bm25_scores(evidence, fresh, asked)
    return retrieval.ranked_hits(asked, evidence, scores, tokens, statistics, 0.0, 10, True)


def shown(hits):
    return {(row["request_id"], row["position"], row["evidence_id"], round(row["score"], 5)) for row in hits.collect()}


def test_stale_items_are_removed_before_the_top(spark):
    docs = [document("news:current", text="memory risk current"), document("news:stale", age=31, text="memory risk memory risk memory risk")]
    evidence, documents, requests = tables(spark, docs, [request()])
    hits, diagnostics = fresh_retrieve(evidence, requests, documents, floor=0.0)
    assert [row["evidence_id"] for row in hits.collect()] == ["evidence:news:current"]
    assert diagnostics.first()["filtered_count"] == 1


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_the_stages_one_after_another(spark, seed):
    chooser = random.Random(seed)
    words = "memory risk chip plant market price order fab".split()
    docs = []
    for i in range(90):
        source = chooser.choice(["news", "disclosure", "disclosure", "research_report", "glossary"])
        docs.append(document(
            f"{source}:{i}", source, chooser.choice([None, -1, 0, 0.1, 0.13, 5, 29.9, 30.2, 60, 179, 180.2, 200, 364, 366]), " ".join(chooser.choices(words, k=chooser.randint(1, 9))),
            chooser.choice([("A",), ("B",), ("A", "B")]), chooser.choice([None, "x", "y"]), chooser.random() < 0.1,
        ))
    disclosures = [row for row in docs if row[1] == "disclosure"]
    docs += [document(f"disclosure:c{i}", "disclosure", chooser.choice([-1, 0, 3, 170, 300]), "memory correction", target[2], chooser.choice([None, "x"]), chooser.random() < 0.2, target[0])
             for i, target in enumerate(chooser.sample(disclosures, 12))]
    every = ["news", "disclosure", "research_report", "glossary"]
    requests = [
        request(f"r{i}", chooser.choice([every, ["disclosure"], ["news", "glossary"], ["glossary"]]), " ".join(chooser.choices(words, k=3)),
                *chooser.choice([(None, None), (None, None), (dt.date(2024, 1, 1), None), (dt.date(2024, 1, 10), dt.date(2024, 5, 20)), (None, dt.date(2024, 5, 1))]),
                chooser.choice([None, BASIS, BASIS - dt.timedelta(days=40)]), chooser.choice([None, None, ["x"], ["y", "z"], []]), 10,
                chooser.choice([BASIS, BASIS, BASIS - dt.timedelta(days=100)]), chooser.choice("ABC"))
        for i in range(40)
    ]
    evidence, documents, asked = tables(spark, docs, requests)
    hits, diagnostics = fresh_retrieve(evidence, asked, documents, floor=0.0)
    want, counts = one_after_another(evidence, documents, asked)
    assert shown(hits) == shown(want) and shown(hits)
    pick = lambda frame: {(row["request_id"], row["filtered_count"], row["returned_count"]) for row in frame.collect()}
    assert pick(diagnostics) == pick(counts)


def test_no_documents_or_requests(spark):
    evidence, documents, requests = tables(spark, [document("news:1")], [request()])
    assert fresh_retrieve(evidence.limit(0), requests, documents.limit(0))[0].count() == 0
    assert fresh_retrieve(evidence, requests.limit(0), documents)[0].count() == 0
