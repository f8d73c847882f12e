"""Coded files of token ids: code lengths against an exhaustive search, exact round trips, places against the tokenizer."""

from __future__ import annotations

import heapq
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import huffman
from lodestone.llm.common import new_folder, ready
from lodestone.llm.huffman import Code, code_lengths, decode_file, encode_file, encoded_documents, read_ids, token_ids, write_ids
from lodestone.llm.queries import tokenizer_path
from tests.llm.conftest import prose


def cheapest(counts, limit):
    """Least number of bits of a prefix code with at most ``limit`` bits a code, by trying all sorted lengths."""
    best = [None]

    def go(left, room, shortest, bits):
        if best[0] is not None and bits >= best[0]:
            return
        if not left:
            best[0] = bits
            return
        for length in range(shortest, limit + 1):
            span = 2 ** (limit - length)
            if span * len(left) <= room or span <= room:
                if span <= room and len(left) - 1 <= room - span:
                    go(left[1:], room - span, length, bits + left[0] * length)

    go(sorted(counts, reverse=True), 2**limit, 1, 0)
    return best[0]


@pytest.mark.parametrize("seed", range(6))
def test_lengths_are_the_best_within_the_limit(seed):
    chooser = random.Random(seed)
    counts = [chooser.choice([1, 1, 2, 3, 50, 1000]) * chooser.randint(1, 9) for _ in range(7)]
    for limit in (3, 4, 6):
        lengths = code_lengths(np.array([0, *counts, 0]), limit)
        assert lengths[0] == lengths[-1] == 0 and lengths.max() <= limit
        assert sum(2.0 ** -int(one) for one in lengths if one) == 1
        assert int((lengths[1:-1] * np.array(counts)).sum()) == cheapest(counts, limit)


def test_no_limit_felt_is_plain_huffman():
    counts = [random.Random(5).randint(1, 400) for _ in range(300)]
    heap, bits = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        bits += both
        heapq.heappush(heap, both)
    assert int((code_lengths(np.array(counts), 16).astype(int) * np.array(counts)).sum()) == bits


def test_few_or_too_many_ids():
    assert code_lengths(np.array([0, 0])).tolist() == [0, 0]
    assert code_lengths(np.array([0, 9])).tolist() == [0, 1]
    with pytest.raises(ValueError, match="do not fit"):
        code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("limit", [9, 16, 24])
def test_files_round_trip(monkeypatch, limit):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 700)
    chooser = np.random.default_rng(limit)
    ids = np.minimum(chooser.geometric(0.02, 20_000) - 1, 400).astype("<u4")
    code = Code(code_lengths(np.bincount(ids), limit), limit)
    sizes = np.array([0, 19_000, 1, 0, 999])
    content = encode_file(code, code.codes(), 3, 5, [None, -7, 2**62, 0, 9], sizes, ids)
    part, number, doc_ids, held, got = decode_file(content + b"\n")
    assert (part, number, doc_ids, held.tolist()) == (3, 5, [None, -7, 2**62, 0, 9], sizes.tolist())
    assert np.array_equal(got, ids)
    broken = bytearray(content)
    broken[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        decode_file(bytes(broken))
    with pytest.raises(ValueError, match="not a file"):
        decode_file(b"x" + content)


def test_documents_match_the_tokenizer(spark, make_documents, odd_texts, monkeypatch):
    from tokenizers import Tokenizer

    ready(spark)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = list(odd_texts) + [(20, "I'll don't O'Reilly's ÀÉ ''d 12,5% a_b-c×d ß KÅ <|endoftext|> a\x1cb"), (21, "!" * 90 + "b" * 80), (22, "aaaa aaaaaaa 'RE")]
    rows += [(30, prose(i, 25)) for i in range(40)]
    got = [tuple(row) for row in encoded_documents(make_documents(rows), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    want = {}
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert len(got) == len(rows)
    for key, held in want.items():
        assert sorted(row[2:] for row in got if row[0] == key) == sorted(held)
    upto = 0
    for key, start, tokens, _ in sorted(got, key=lambda row: row[1]):
        assert start == upto
        upto += tokens
    ordered = [row[0] for row in sorted(got, key=lambda row: row[1])]
    assert ordered == sorted(ordered, key=lambda key: (key is not None, key or 0))


def test_many_small_files_and_a_hot_id(spark, make_documents):
    ready(spark)
    rows = [(7, prose(i, 12)) for i in range(60)] + [(7, "same words")] * 30 + [(i, prose(i, 9)) for i in range(100, 160)]
    tokens = token_ids(make_documents(rows), tokenizer_path())
    folder = new_folder(spark, "ids-test")
    write_ids(tokens, folder, file_tokens=200)
    assert spark.read.format("binaryFile").load(folder).count() > 10
    held = read_ids(spark, folder, keep_ids=True).collect()
    plain = sorted((row["doc_id"], bytes(row["ids"])) for row in tokens.collect())
    assert sorted((row["doc_id"], bytes(row["ids"])) for row in held) == plain
    upto = 0
    for row in sorted(held, key=lambda row: row["start"]):
        assert row["start"] == upto and zlib.crc32(row["ids"]) == row["ids_crc32"]
        upto += row["n_tokens"]


def test_empty_table(spark, make_documents):
    ready(spark)
    assert encoded_documents(make_documents([]), tokenizer_path()).count() == 0
