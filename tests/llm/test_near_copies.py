"""Near copies by five words and 0.8, as the pipeline takes them."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm.jaccard import candidate_edges, link_documents, set_keys, shingle_counts
from tests.llm.conftest import prose
from tests.llm.test_operators import near_copies


def components(rows, shingle=5, percent=80):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[key] = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({tuple(words)} if words else set())
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {(key, len(sets[key]), find(key)) for key in sets}


def spread_changes(words: int, changes: int, first: int) -> list[tuple[int, str]]:
    """A text, and the same with single words changed far from each other."""
    plain = [f"w{i}" for i in range(words)]
    changed = [f"new{i}" if i % (words // changes) == words // changes // 2 else word for i, word in enumerate(plain)]
    return [(first, " ".join(plain)), (first + 1, " ".join(changed))]


@pytest.mark.parametrize("seed", range(2))
def test_components_at_five_words_match_brute_force(make_documents, odd_texts, seed):
    rows = [(key, text) for key, text in dict(odd_texts).items() if key is not None] + [(100 + key, text) for key, text in near_copies(seed)]
    rows += spread_changes(460, 10, 400) + [(500 + i, prose(900 + seed, 70) + " " + prose(i, i)) for i in range(1, 24)]
    for rare in (False, True):
        linked = link_documents(make_documents(rows), shingle=5, percent=80, rare=rare)
        assert {tuple(row) for row in linked.select("doc_id", "n_shingles", "component_id").collect()} == components(rows)


def test_shared_passages_alone_bring_no_candidates(spark, make_documents):
    """Rare shingles are own words; the passage that all hold is in no list."""
    passage = prose(77, 120)
    rows = [(i, f"{passage} {' '.join(f'w{i}x{j}' for j in range(160))}") for i in range(40)]
    rows += [(100 + i, text.replace(f"w{i}x3", "changed")) for i, text in rows[:5]]
    texts = make_documents(rows).selectExpr("CAST(doc_id AS long) AS doc_id", "encode(text, 'UTF-8') AS data")
    counts = shingle_counts(texts, 5)
    assert counts.sum() == sum(size for _, size, _ in components(rows))
    edges = {tuple(sorted(row)) for row in candidate_edges(texts, 12, len(rows), 5, 80, counts).collect()}
    assert edges == {(i, 100 + i) for i in range(5)}


def test_counts_of_nothing(make_documents):
    assert not shingle_counts(make_documents([]).selectExpr("encode(text, 'UTF-8') AS data"), 5).any()
    assert link_documents(make_documents([]), shingle=5, percent=80, rare=True).count() == 0


def test_stage_takes_five_words_and_four_fifths(spark, make_documents, odd_texts):
    rows = list(dict(odd_texts).items()) + [(100 + key, text) for key, text in near_copies(1)] + spread_changes(460, 10, 400)
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, make_documents(rows), "")
    first = {key for key, _, component in components([row for row in rows if row[0] is not None]) if key == component}
    assert 400 in first and 401 not in first
    assert Counter(row["doc_id"] for row in kept.collect()) == Counter(key for key, _ in rows if key is None or key in first)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_have_a_common_key(percent):
    chooser = random.Random(percent)
    for size in [*range(4, 40), 100, 460, 3000]:
        for _ in range(6):
            tokens = np.random.default_rng(chooser.randrange(10**9)).integers(0, 2**63, 2 * size).astype(np.uint64)
            # As many own shingles on either side as a link allows.
            apart = size * 2 * (100 - percent) // (100 + percent)
            left = chooser.randint(0, apart)
            common = tokens[: size - left]
            one, two = np.sort(np.append(common, tokens[size : size + left])), np.sort(np.append(common, tokens[size + left : size + apart]))
            if 100 * len(common) < percent * (len(common) + apart) or not apart:
                continue
            rarity = np.random.default_rng(size).integers(0, 9, 64).astype(np.uint32)
            for light, counted in ((8, None), (12, None), (8, rarity), (12, rarity)):
                keys, owner = set_keys(np.concatenate([one, two]), np.array([len(one), len(two)]), light, percent, counted)
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (size, left, light)


def test_long_texts_are_not_gathered_by_empty_parts():
    sets = [np.sort(np.random.default_rng(i).integers(0, 2**63, 20_000).astype(np.uint64)) for i in range(4)]
    for percent in (80, 90):
        keys, owner = set_keys(np.concatenate(sets), np.array([len(one) for one in sets]), 12, percent)
        held = [set(keys[owner == i].tolist()) for i in range(4)]
        assert not any(held[i] & held[j] for i in range(4) for j in range(i))


def test_edges_do_not_grow_with_the_ranges(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 300)]
    rows = [(n, " ".join([*base, f"end{n}"])) for n in range(40)] + [(100 + n, " ".join(words[i] for i in rng.integers(0, 400, 60))) for n in range(20)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "encode(text, 'UTF-8') AS data").repartition(8)
    # As many ranges as a million documents have: 200.
    edges = [tuple(row) for row in candidate_edges(texts, 12, 1_000_000, 5, 80).collect()]
    assert {max(edge) for edge in edges} >= set(range(1, 40)) and all(max(edge) < 100 for edge in edges)
    assert len(edges) <= 8 * 40
