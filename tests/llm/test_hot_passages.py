"""A passage that most documents share, each between words of its own."""

from __future__ import annotations

from collections import Counter

import numpy as np

from lodestone.llm import suffixes
from lodestone.llm.suffixes import Segments, hot_seeds, remove_repeats
from tests.llm.conftest import prose
from tests.llm.test_operators import expected_repeats

PASSAGE = "the same twenty bytes in all"
LONG = "a longer passage that takes more than fifty bytes in every document"


def documents():
    rows = [(i, f"{prose(i, 12)} {PASSAGE} {prose(1000 + i % 40, 12)} {LONG} {prose(2000 + i, 5)}") for i in range(120)]
    return rows + [(None, rows[3][1] + " and more"), (None, prose(5000, 30)), (7, rows[8][1]), (400, None), (401, "")]


def test_hot_seeds_are_split_with_the_same_result(make_documents):
    rows = documents()
    frame = make_documents(rows).repartition(3)
    assert len(hot_seeds(frame, "text", 4, 60)) > 0
    assert len(hot_seeds(frame, "text", 4, suffixes.HOT_SEGMENTS)) == 0
    got = remove_repeats(frame, hot_segments=60).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == expected_repeats(rows)


def test_no_seed_keeps_many_segments():
    texts = [text.encode() for _, text in documents()[:120]]
    plain = Segments(texts)
    names = lambda found: Counter(seed for seed, _ in set(zip(found.seed.tolist(), found.name.tolist(), strict=True)))
    hot = np.array([seed for seed, n in names(plain).items() if n > 60], np.uint64)
    split = Segments(texts, np.sort(hot))
    assert max(names(plain).values()) > 100 and max(names(split).values()) <= 60
    assert split.windows.sum() == plain.windows.sum()


def test_rows_without_id_lie_in_many_groups(make_documents):
    frame = make_documents([(None, prose(i, 20)) for i in range(60)])
    assert suffixes.dealt(frame, "doc_id", "text", 8).select("__g").distinct().count() > 4


def test_windows_are_compared_seed_by_seed():
    seeds, sizes = np.array([1, 1, 2, 3, 3, 3, 9]), np.array([5, 5, 4, 30, 30, 30, 1])
    blocks = list(suffixes.seed_blocks(seeds, sizes, 20))
    # Whole seeds, at most 20 windows together unless one seed alone has more.
    assert blocks == [(0, 3), (3, 6), (6, 7)]
    text = bytes(range(65, 91)) * 3
    pieces, docs = [text[:60], text[:55], text[1:60]], np.array([7, 3, 5])
    size = np.array([len(piece) - 49 for piece in pieces])
    windows = [(piece[i : i + 50], doc) for piece, doc in zip(pieces, docs, strict=True) for i in range(len(piece) - 49)]
    expected = [any(other == window and less < doc for other, less in windows) for window, doc in windows]
    assert suffixes.repeated(pieces, size, docs).tolist() == expected and any(expected) and not all(expected)


def test_powers_do_not_outlive_the_cut():
    assert "_powers" not in vars(suffixes.Segments([b"x" * 200]))
