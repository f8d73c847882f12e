"""Groups of candidates that are too large for one verifying task."""

from __future__ import annotations

import pytest

from lodestone.llm import jaccard
from tests.llm.test_near_copies import components


def own_words(name: str, count: int) -> str:
    return " ".join(f"{name}x{j}" for j in range(count))


@pytest.fixture
def sent(monkeypatch):
    """Rows of documents sent to verifying tasks, with few counters and small blocks."""
    seen, plain = [], jaccard.cut_lineage

    def told(frame):
        out = plain(frame)
        if "task" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", told)
    # Full counters tell no shingle from another, as in a large corpus.
    monkeypatch.setattr(jaccard, "COUNTERS", 64)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1_000)
    return seen


def linked(make_documents, rows):
    found = jaccard.link_documents(make_documents(rows), shingle=5, percent=80, rare=True)
    return {tuple(row) for row in found.select("doc_id", "n_shingles", "component_id").collect()}


def test_a_chain_of_passages_is_not_sent_block_by_block(make_documents, sent):
    """Each text shares a passage with the next, so that all are one group of some 25 blocks."""
    rows = [(i, f"{own_words(f'pass{i}', 60)} {own_words(f'own{i}', 200)} {own_words(f'pass{i + 1}', 60)}") for i in range(80)]
    rows += [(200 + i, text.replace(f"own{i}x7 ", "changed ")) for i, text in rows[:9]]
    assert linked(make_documents, rows) == components(rows)
    assert sum(sent) <= 2 * len(rows)


def test_linked_families_stay_whole(make_documents, sent):
    """A family of linked copies larger than a block, in a chain with others, and sets of few shingles."""
    chained = [(i, f"{own_words(f'pass{i}', 60)} {own_words(f'own{i}', 200)} {own_words(f'pass{i + 1}', 60)}") for i in range(30)]
    family = [(100 + i, chained[4][1].replace(f"own4x{9 * i} ", f"new{i} ")) for i in range(12)]
    short = [(200 + i, own_words("pass3", 9 + i % 4)) for i in range(6)] + [(300, ""), (301, None), (302, "one two")]
    rows = chained + family + short
    assert linked(make_documents, rows) == components(rows)


def test_holders_are_keyed_by_what_they_share():
    import numpy as np

    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 85).astype(np.uint64)
    sets = [np.append(shared, rng.integers(0, 2**63, 15).astype(np.uint64)) for _ in range(2)] + [rng.integers(0, 2**63, 100).astype(np.uint64)]
    tokens, counts = np.concatenate([np.sort(one) for one in sets]), np.array([100, 100, 100])
    holders = 1 + np.isin(tokens, shared).astype(np.int64)
    keys, owner = jaccard.set_keys(tokens, counts, 8, 80, holders=holders)
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert not (owner == 2).any()
