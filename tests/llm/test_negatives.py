"""Hard negatives against all pairs, and the pruning on its own."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import negatives
from lodestone.llm.common import ready
from lodestone.llm.negatives import Best, Bucket, hard_negatives, mine_embeddings, search


def expected(rows):
    """rows of (vec_id, embedding, label) by the contract of the query."""
    held = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((key, (label + 1) % 10 if key % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))
    held = list(dict.fromkeys(held))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = Counter()
    for anchor in held:
        if anchor[0] % 100:
            continue
        first = lambda some, k: sorted(some, key=lambda row: (-score(anchor, row), row[0]))[:k]
        for positive in first([row for row in held if row[1] == anchor[1] and row != anchor], 5):
            top = score(anchor, positive)
            fit = [row for row in held if row[1] != anchor[1] and 80 * top <= 100 * score(anchor, row) <= 100 * top]
            for rank, row in enumerate(first(fit, 5), 1):
                out[(anchor[0], positive[0], rank, row[0], top, score(anchor, row))] += 1
    return out


@pytest.fixture(scope="module")
def mined(spark):
    ready(spark)

    def run(rows):
        frame = spark.createDataFrame([(*row, "x", 1) for row in rows], "vec_id long, embedding array<float>, label int, rank string, hash int")
        return Counter(tuple(row) for row in mine_embeddings(frame).collect())

    return run


def some_rows(seed, count=420, width=8, spread=0.4):
    chooser = np.random.default_rng(seed)
    middle = chooser.normal(size=(4, width))
    for key in range(count):
        label = int(chooser.integers(4))
        yield key, (middle[label % 2] + spread * chooser.normal(size=width)).astype(np.float32).tolist(), label


@pytest.mark.parametrize("seed", range(2))
def test_random_rows_match_all_pairs(mined, monkeypatch, seed):
    rows = list(some_rows(seed))
    got = mined(rows)
    assert got == expected(rows) and len(got) > 40


def test_odd_rows(mined):
    rows = list(some_rows(5, 230)) + [
        (300, [0.0] * 8, 1), (400, [], 1), (401, [], 2), (500, [1.0] * 20, 3), (501, [1.0] * 3, 2), (600, None, 1), (601, [1.0, None], 1), (602, [float("nan")] * 8, 1),
        (603, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (700, [1.0] * 8, None), (800, [-3.0] * 8, 9), (801, [-3.0] * 8, 8), (100, [0.5] * 8, 2), (100, [0.5] * 8, 2),
    ]
    assert mined(rows) == expected(rows)


def test_a_hot_vector(mined):
    rows = list(some_rows(6, 300)) + [(1000 + i, [0.5, 0.25, 0.5, 0.0, 1.0, 0.5, 0.25, 0.125], i % 2) for i in range(260)]
    assert mined(rows) == expected(rows)


def test_empty_and_lonely(mined):
    assert mined([]) == Counter()
    assert mined([(1, [1.0], 1)]) == Counter() and mined([(0, [1.0], 1)]) == Counter()
    rows = [(0, [1.0], 1), (100, [1.0], 2), (1, [1.0], 2)]
    assert mined(rows) == expected(rows)


@pytest.mark.parametrize("sizes", [(16, 8, 3), (4096, 2048, 64)])
def test_sizes_of_buckets_parts_and_runs(spark, monkeypatch, sizes):
    ready(spark)
    chooser = np.random.default_rng(3)
    rows = [(key, int(chooser.integers(3)), [int(x) for x in chooser.integers(-40, 90, 5)]) for key in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, vec array<bigint>")
    for name, value in zip(("BUCKET_ROWS", "PART_ROWS", "RUN_BUCKETS"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, value)
    got = Counter(tuple(row) for row in hard_negatives(frame, negatives.F.col("vec_id") % 2 == 0, 3, 4, 60, 95).collect())
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=True))
    want = Counter()
    for anchor in rows[::2]:
        first = lambda some, k: sorted(some, key=lambda row: (-score(anchor, row), row[0]))[:k]
        for positive in first([row for row in rows if row[1] == anchor[1] and row is not anchor], 3):
            top = score(anchor, positive)
            fit = [row for row in rows if row[1] != anchor[1] and 60 * top <= 100 * score(anchor, row) <= 95 * top]
            want.update((anchor[0], positive[0], rank, row[0], top, score(anchor, row)) for rank, row in enumerate(first(fit, 4), 1))
    assert got == want


@pytest.mark.parametrize("scale", [1, 256, 3e8])
def test_pruning_loses_no_row(scale):
    chooser = np.random.default_rng(int(scale) % 97)
    vectors = np.floor(scale * chooser.normal(size=(400, 6))).astype(np.int64)
    bucket, dropped = Bucket(vectors, np.arange(400)[:, None]), 0
    for anchor in vectors[:40]:
        best = Best.empty(6)
        best.offer(np.sort(vectors[:30] @ anchor)[-6:], np.arange(6) + 1000, np.zeros(6, bool))
        least = best.bound
        rows = bucket.candidates(anchor.astype(float), float(np.sqrt((anchor.astype(float) ** 2).sum())), least)
        assert set(np.flatnonzero(vectors @ anchor >= least)) <= set(rows.tolist())
        dropped += 400 - len(rows)
        best = Best.empty(6)
        search(bucket, anchor, [best])
        assert best.scores.tolist() == sorted((vectors @ anchor).tolist(), reverse=True)[:6]
    assert scale < 256 or dropped > 0
