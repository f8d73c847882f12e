"""What fresh retrieval sends to every task does not grow with the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.fresh_retrieval import fresh_retrieve
from tests.test_fresh_retrieval import document, one_after_another, request, shown, tables


def test_corrections_are_not_broadcast(spark, monkeypatch):
    """Each disclosure but every fourth is corrected; for few requests only what belongs to them may be broadcast."""
    plain, held = F.broadcast, []

    def told(frame):
        held[-1] = max(held[-1], frame.count())
        return plain(frame)

    monkeypatch.setattr(F, "broadcast", told)
    asked = [request("r0", ["disclosure"]), request("r1", ["disclosure", "news"], "risk")]
    for size in (12, 60):
        docs = [document(f"disclosure:{i}", "disclosure", 20 + i / 100, f"memory risk word{i}") for i in range(size)]
        docs += [document(f"disclosure:c{i}", "disclosure", 10 + i / 100, "memory correction", corrects=f"disclosure:{i}") for i in range(size) if i % 4]
        docs += [document(f"news:{i}", "news", 3, "risk") for i in range(4)]
        evidence, documents, requests = tables(spark, docs, asked)
        held.append(0)
        hits, diagnostics = fresh_retrieve(evidence, requests, documents, floor=0.0)
        monkeypatch.setattr(F, "broadcast", plain)
        want, counts = one_after_another(evidence, documents, requests)
        assert shown(hits) == shown(want) and shown(hits)
        pick = lambda frame: {(row["request_id"], row["filtered_count"], row["returned_count"]) for row in frame.collect()}
        assert pick(diagnostics) == pick(counts)
        monkeypatch.setattr(F, "broadcast", told)
    assert 0 < held[0] == held[1]
