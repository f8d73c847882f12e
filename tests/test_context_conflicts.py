"""One evidence id with two contents closes its request; copies and other requests do not."""

from __future__ import annotations

from lodestone.operators.selection import budget_context, conflicting_evidence

SCHEMA = (
    "request_id string, position int, evidence_id string, document_id string, source_type string, title string, source_url string, published_at timestamp, "
    "subject_security_ids array<string>, mentioned_security_ids array<string>, scope string, snippet string, score double"
)


def row(request, position, key, snippet="text", score=1.0):
    return (request, position, key, f"doc:{key}", "news", "t", "https://x.example.com/", None, ["A"], [], "company_specific", snippet, score)


def test_conflicting_contents_fail_closed(spark):
    rows = spark.createDataFrame([
        row("bad", 1, "e1"), row("bad", 2, "e1", "other text"), row("bad", 3, "e2"),
        # The same content again, with another score, is a copy.
        row("good", 1, "e1"), row("good", 2, "e1", score=0.5), row("good", 3, "e3", "third"),
    ], SCHEMA)
    requests = spark.createDataFrame([("bad", None), ("good", None)], "request_id string, required_sources array<string>")
    assert {tuple(found) for found in conflicting_evidence(rows).collect()} == {("bad", "e1")}
    selected, diagnostics = budget_context(rows, requests)
    assert sorted((found["request_id"], found["evidence_id"]) for found in selected.collect()) == [("good", "e1"), ("good", "e3")]
    assert [(found["request_id"], found["input_count"], found["duplicate_drop_count"]) for found in diagnostics.collect()] == [("good", 3, 1)]
