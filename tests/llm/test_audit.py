"""The audit of filters against a plain run of every order."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from lodestone.llm.audit import audit_filters, order_totals, removal_intervals
from tests.llm.conftest import prose

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def expected(rows, labels):
    """rows of (doc_id, text, lang), labels of (doc_id, quality, toxic)."""
    good = {key for key, quality, _ in labels if quality == 1 and key is not None}
    toxic = {key for key, _, toxic in labels if toxic == 1 and key is not None}
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    parts = defaultdict(list)
    for key, text, lang in rows:
        whole = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", whole)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", whole)) > 3 * len(whole) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", whole) else set()
        fails |= {"E"} if key is not None and first[whole] < key else set()
        parts[lang or ""].append((fails, key in good, key in toxic))
    out, shapley = {}, Counter()
    for part, held in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, letter in enumerate(order, 1):
                gone = [row for row in left if letter in row[0]]
                left = [row for row in left if letter not in row[0]]
                failing = sum(letter in row[0] for row in held)
                shapley[(part, letter)] += len(gone)
                out[(part, order, step)] = (
                    len(left), len(gone), failing - len(gone), sum(row[0] == {letter} for row in held), sum(row[1] for row in gone), sum(row[2] for row in gone),
                )
    return {key: (*values, shapley[(key[0], key[1][key[2] - 1])]) for key, values in out.items()}


def collected(frame):
    return {(row["part"], row["filter_order"], row["step"]): tuple(row[name] for name in COLUMNS) for row in frame.collect()}


@pytest.fixture(scope="module")
def make(spark):
    def build(rows, labels):
        # Columns that clash with the operator's own.
        documents = spark.createDataFrame([(key, text, lang, 7, "x", 1) for key, text, lang in rows], "doc_id long, text string, lang string, mask int, part string, n int")
        return documents, spark.createDataFrame([(*row, "y") for row in labels], "doc_id long, quality int, toxic int, part string")

    return build


def test_totals_of_odd_texts_match_every_order(make, odd_texts):
    rows = [(key, text, ("en", "de", None, "")[nth % 4]) for nth, (key, text) in enumerate(odd_texts)]
    rows += [(200 + i, prose(i % 3, 210 + i), "en") for i in range(6)] + [(300, "LOUD " * 250, "de"), (301, "LOUD " * 250, "en"), (302, "a | b " + prose(9, 230), "en"), (None, None, None)]
    labels = [(key, i % 2, i % 3 == 0) for i, (key, _, _) in enumerate(rows)] + [(200, 0, 1), (200, 1, 0), (None, 1, 1), (7, None, None), (9999, 1, 1)]
    labels = [(key, quality, None if toxic is None else int(toxic)) for key, quality, toxic in labels]
    assert collected(audit_filters(*make(rows, labels))) == expected(rows, labels)


def test_copies_of_a_hot_text(make):
    rows = [(i, "same text", "en") for i in range(400)] + [(3, "same text", "de")] * 30 + [(1000 + i, prose(i, 220), "fr") for i in range(20)]
    assert collected(audit_filters(*make(rows, [(0, 1, 0), (5, 1, 1)]))) == expected(rows, [(0, 1, 0), (5, 1, 1)])


def test_empty_tables(make):
    assert audit_filters(*make([], [])).count() == 0
    assert collected(audit_filters(*make([(1, "a", "en")], []))) == expected([(1, "a", "en")], [])


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_intervals_hold_each_order_once(filters):
    held = defaultdict(dict)
    for mask, step, first, end in removal_intervals(filters):
        for rank in range(first, end):
            assert rank not in held[mask]
            held[mask][rank] = step
    for mask in range(1, 1 << filters):
        plain = {rank: next(step for step, i in enumerate(order, 1) if mask >> i & 1) for rank, order in enumerate(permutations(range(filters)))}
        assert held[mask] == plain


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 4, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    rows = collected(order_totals(counts, "XYZ"))
    assert len(rows) == 18
    assert rows[("p", "XYZ", 1)] == (6, 2, 0, 0, 1, 1, 2 * 3) and rows[("p", "YXZ", 2)] == (6, 0, 2, 0, 0, 0, 6) and rows[("p", "XYZ", 3)][:2] == (5, 1)
