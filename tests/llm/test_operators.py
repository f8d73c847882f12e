"""The corpus operators against plain re-statements on small tables, with odd rows and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import ready
from lodestone.llm.fingerprints import fingerprint_documents, likeness, sketches, spelled
from lodestone.llm.jaccard import choose_boundary, link_documents, set_keys, shingle_sets
from lodestone.llm.language import predict_languages
from lodestone.llm.mixing import TARGETS, mix, mixed_documents, quality_domains
from lodestone.llm.packing import pack_documents, plan
from lodestone.llm.quality import predict_quality
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.sharding import assign_shards, shard_documents
from lodestone.llm.suffixes import LAST, previous_factors, remove_repeats
from lodestone.llm.topk import ImpactIndex, nearest
from lodestone.llm.warc import archive_folder, archive_pages, read_archives, write_archives
from tests.llm.conftest import prose


@pytest.fixture(autouse=True)
def _ready(spark):
    ready(spark)


def near_copies(seed: int) -> list[tuple[int, str]]:
    chooser, rows = random.Random(seed), []
    for family in range(6):
        words = prose(100 + family, chooser.choice([9, 12, 19, 21, 45, 120])).split()
        for _ in range(7):
            changed = list(words)
            for _ in range(chooser.choice([0, 0, 1, 2])):
                place = chooser.randrange(len(changed))
                changed[place : place + chooser.choice([0, 1])] = [prose(chooser.randrange(10**6), 1)] * chooser.choice([0, 1])
            rows.append((len(rows) * 3 + 1, " ".join(changed)))
    return rows


# 1: repeated passages


def expected_repeats(rows):
    first: dict[bytes, int] = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            first[data[i : i + 50]] = min(first.get(data[i : i + 50], LAST), LAST if key is None else key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < (LAST if key is None else key):
                gone[i : i + 50] = b"\1" * 50
        left = bytes(byte for byte, out_ in zip(data, gone, strict=True) if not out_)
        spans = sum(1 for i, out_ in enumerate(gone) if out_ and (i == 0 or not gone[i - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_repeats_match_brute_force(make_documents, odd_texts):
    passage = prose(7, 12)
    rows = [*odd_texts, *((100 + i, prose(i, 20) + " " + passage[i : 80 + i] + " " + prose(50 + i, 15)) for i in range(12))]
    rows += [(200 + key, text) for key, text in near_copies(3)] + [(300, "ab" * 400), (301, "ab" * 300 + "c"), (302, "z" + "ab" * 30)]
    got = remove_repeats(make_documents(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == expected_repeats(rows)


def test_repeats_of_nothing(make_documents):
    assert remove_repeats(make_documents([])).count() == 0


def test_previous_factors_match_brute_force():
    chooser = np.random.default_rng(5)
    windows, docs = chooser.integers(97, 99, (200, 8)).astype(np.uint8), chooser.integers(0, 30, 200)
    found = previous_factors(windows, docs, 3)
    for i in range(len(windows)):
        prefixes = [next((k for k in range(8) if windows[i][k] != windows[j][k]), 8) for j in range(len(windows)) if docs[j] < docs[i]]
        longest = max(prefixes, default=0)
        assert found[i] == (longest if longest >= 3 else 0)


# 2: top-k


def expected_nearest(rows, k=5):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    clean = [(i, list(v)) for i, v in {(i, tuple(v)) for i, v in clean}]
    out = set()
    for q, v in clean:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in clean if i != q)[:k]
            out |= {(q, nth + 1, i, -s) for nth, (s, i) in enumerate(scored)}
    return out


def test_nearest_with_ties_and_odd_vectors(spark):
    chooser = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in chooser.normal(0, 0.3, 8)]) for i in range(140)]
    rows += [(200 + i, [0.5] * 8) for i in range(40)] + [(250, [0.5] * 8), (250, [0.5] * 8), (301, None), (302, [None] * 8), (303, [float("nan")] * 8)]
    rows += [(None, [0.1] * 8), (304, [float("inf")] * 8), (305, [0.5, 0.25]), (306, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(row) for row in nearest(frame).collect()} == expected_nearest(rows32)
    assert nearest(frame.limit(0)).count() == 0
    assert nearest(frame.where("vec_id = 50")).count() == 0


def test_index_returns_all_best_of_a_block():
    chooser = np.random.default_rng(3)
    vectors = chooser.integers(-120, 120, (3000, 24))
    index = ImpactIndex(vectors)
    for query in [*vectors[:20], np.zeros(24, dtype=int)]:
        rows, scores = index.search(query, 6)
        exact = vectors @ query
        assert sorted(scores)[-6:] == sorted(exact)[-6:]
        assert set(np.flatnonzero(exact > sorted(exact)[-6])) <= set(rows)


# 3: web archives


def test_archives_round_trip(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(4, "http://a/ b\r\nX: y", big), (2, "http://b", big), (2, "http://b", big), (9, None, big), (None, "http://n", big), (5, "u", "tiny"), (6, "u", "tiny")]
    rows += [(7, "u", None), (8, "u", ""), (10, "u", "z" * 100), (11, "u", "z" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99)]
    pages = spark.createDataFrame([(*row, "x") for row in rows], "page_id long, url string, html string, payload_digest string")
    got = Counter(tuple(row) for row in archive_pages(pages).collect())
    digest = lambda html: hashlib.sha256((html or "").encode()).hexdigest()
    firsts = {digest(big): 2, digest("z" * 100): 10}
    want = Counter()
    for page, _, html in rows:
        first = firsts.get(digest(html))
        revisit = first is not None and page is not None and page != first
        want[(page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want
    assert archive_pages(pages.limit(0)).count() == 0


def test_archives_are_warc(spark):
    import gzip
    import pathlib

    path = archive_folder(spark)
    write_archives(spark.createDataFrame([(1, "http://a", "h" * 120), (2, "http://b", "h" * 120)], "page_id long, url string, html string"), path)
    text = "".join(gzip.decompress(part.read_bytes()).decode() for part in sorted(pathlib.Path(path.removeprefix("file:")).glob("*.gz")))
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("\r\n\r\n")
    assert "WARC-Refers-To-Target-URI: http://a" in text and text.count("h" * 120) == 1
    assert {row["record_type"] for row in read_archives(spark, path).collect()} == {"response", "revisit"}


# 4: fingerprints


def test_fingerprints_follow_the_contract(make_documents, odd_texts):
    rows = odd_texts + [(100 + i, prose(i, 150)) for i in range(20)]
    got = Counter(tuple(row) for row in fingerprint_documents(make_documents(rows)).collect())
    ordered = sorted(((key, text or "") for key, text in rows), key=lambda row: (row[0] is not None, row[0] or 0, row[1].encode()))
    want = Counter()
    for place, (key, text) in enumerate(ordered):
        after = ordered[(place + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, changed, other = (sketches([one])[0] for one in (text, edited, after))
        want[(key, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelled(own), spelled(changed), likeness(own, changed), likeness(own, other))] += 1
    assert got == want
    assert fingerprint_documents(make_documents([])).count() == 0


def test_parsing_is_locally_consistent():
    text = prose(3, 900)
    assert likeness(*sketches([text, "some other beginning " + text])) > 0.85
    assert likeness(*sketches([text, prose(4, 900)])) < 0.1
    assert all((a == b).all() for a, b in zip(sketches([text, "", "aaa"]), [sketches([t])[0] for t in (text, "", "aaa")], strict=True))


# 5: mixing


def test_mixing_meets_its_targets(spark, make_documents):
    rows = [(i, prose(i, 80) + (" vile vile curse curse" * 8 if i % 5 == 0 else "") + (" %%% ###" * 12 if i % 7 == 0 else "")) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a"), (None, "b c")]
    labels = spark.createDataFrame(
        [(i, 0 if i % 7 == 0 else 1, 1 if i % 5 == 0 else 0) for i in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int"
    )
    documents = make_documents(rows)
    mixed = mix(documents, quality_domains(labels)).collect()
    assert len(mixed) == len(rows) and all(row["rate"] >= 0 and row["copies"] in (int(row["rate"]), int(row["rate"]) + 1) for row in mixed)
    totals = {domain: sum(row["tokens"] * row["rate"] * row[f"p_{domain}"] for row in mixed) for domain in TARGETS}
    for domain, weight in TARGETS.items():
        assert totals[domain] / sum(totals.values()) == pytest.approx(weight, abs=2e-3)
    assert {row["doc_id"]: row["domain"] for row in mixed}[10] == "toxic"
    taken = mixed_documents(documents, quality_domains(labels))
    assert taken.columns == documents.columns
    assert Counter(row["doc_id"] for row in taken.collect()) == Counter({row["doc_id"]: row["copies"] for row in mixed if row["copies"]})
    assert mix(documents, quality_domains(labels.limit(0))).count() == len(rows)
    assert mix(documents.limit(0), quality_domains(labels)).count() == 0


# 6: sharding


def test_shards_are_even_and_gapless(make_documents, odd_texts):
    rows = odd_texts + [(1000 + i, prose(i, 30 + i % 50)) for i in range(400)] + [(77, prose(5, 20))] * 200
    got = shard_documents(make_documents(rows)).collect()
    assert len(got) == len(rows)
    assert Counter((row["doc_id"], row["text_crc32"]) for row in got) == Counter((key, zlib.crc32((text or "").encode())) for key, text in rows)
    slots, loads = defaultdict(list), Counter()
    for row in got:
        slots[row["shard"]].append(row["slot"])
        loads[row["shard"]] += row["size"]
    assert set(slots) <= set(range(40)) and all(sorted(held) == list(range(len(held))) for held in slots.values())
    largest = max(row["size"] for row in got)
    assert all(abs(loads[shard] - sum(loads.values()) / 40) <= largest for shard in range(40))
    assert shard_documents(make_documents([])).count() == 0


def test_hot_key_is_subdivided(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("k"), F.lit(10).cast("long").alias("size"))
    counts = [row["count"] for row in assign_shards(rows, "k", "size", [], 8).groupBy("shard").count().collect()]
    assert counts == [625] * 8


# 7: languages


def test_languages_and_mixtures(make_documents, spark, odd_texts):
    sets = {"aa": "the of and to in is that was with this", "bb": "der die und das nicht ein zu ist mit auf", "cc": "les des une que dans est pour qui sur pas"}
    chooser, rows = random.Random(1), []
    for i in range(300):
        lang = sorted(sets)[i % 3]
        rows.append((i, " ".join(chooser.choice(sets[lang].split()) for _ in range(chooser.choice([3, 40, 200]))), lang))
    both = " ".join(chooser.choice(sets["aa"].split()) for _ in range(150)) + " " + " ".join(chooser.choice(sets["bb"].split()) for _ in range(100))
    documents = make_documents([(i, text) for i, text, _ in rows]).drop("lang").join(spark.createDataFrame([(i, lang) for i, _, lang in rows], "doc_id long, lang string"), "doc_id")
    odd = make_documents([*((900 + n, text) for n, (_, text) in enumerate(odd_texts)), (950, both), (None, "der die das")], lang=None)
    got = predict_languages(documents.unionByName(odd))
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)
    found = {row["doc_id"]: row for row in got.collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    for n, (_, text) in enumerate(odd_texts):
        letters = bool(re.search(r"[^\W\d_]", text or ""))
        assert (found[900 + n]["lang_pred"] == "und") == (not letters) and 0 <= found[900 + n]["score"] <= 1
    assert set(found[950]["languages"]) == {"aa", "bb"} and found[950]["languages"]["aa"] == pytest.approx(0.6, abs=0.1)
    assert found[950]["lang_pred"] == "aa"
    assert predict_languages(documents.limit(0)).count() == 0
    assert {row["lang_pred"] for row in predict_languages(odd).collect()} == {"und"}


# 8: quality


def test_quality_is_learned(make_documents, spark, odd_texts):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(["spam win cash now"] * 3) + prose(i, 30)) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    documents = make_documents(rows + [(900 + n, text) for n, (_, text) in enumerate(odd_texts)])
    got = {row["doc_id"]: row for row in predict_quality(documents, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in held) for i in range(240))
    assert sum(got[i]["predicted"] == i % 2 for i in held) >= 0.95 * len(held)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5) for row in got.values())
    assert got[905]["score"] == got[906]["score"]
    assert predict_quality(documents.limit(0), labels).count() == 0
    assert {row["score"] for row in predict_quality(documents, labels.limit(0)).collect()} == {0.5}


# 9: packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_piece(seed):
    chooser, counts = random.Random(seed), Counter()
    for _ in range([3000, 40, 700, 1][seed]):
        counts[min(2048, max(1, int(chooser.lognormvariate(6.3, 1.0)) if seed != 2 else chooser.randint(600, 1100)))] += 1
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, rank, each, number, first, offset in plan(dict(counts), 2048):
        ranks[length].append((rank, each * number))
        for i in range(number):
            bins[first + i] += [(offset + j * length, length) for j in range(each)]
    for length, held in ranks.items():
        at = 0
        for rank, number in sorted(held):
            assert rank == at
            at += number
        assert at == counts[length]
    assert set(ranks) == set(counts)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    least = sum(length * n for length, n in counts.items()) / 2048
    if seed == 0:
        assert len(bins) <= least * 1.01 + 1


def test_pieces_equal_the_tokenizer(make_documents, odd_texts):
    from tokenizers import Tokenizer

    pieces = pytest.importorskip("public_tokenizers") and tokenizer_path()
    tokenizer = Tokenizer.from_file(pieces)
    odd = ["İı ẞß can't 12,3", "a\x1cb\x1d", "<|endoftext|> x", "é ́", "word,. UPPER Été!!", "日本 ﬁ ½"]
    rows = odd_texts + [(300 + i, text) for i, text in enumerate(odd)] + [(400, prose(9, 2500)), (401, "same short text"), (402, "same short text")]
    got = pack_documents(make_documents(rows), pieces).collect()
    want = Counter()
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[(key, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(row)[:5] for row in got) == want
    places = defaultdict(list)
    for row in got:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        assert [offset for offset, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 2048
    assert pack_documents(make_documents([]), pieces).count() == 0


# 10: Jaccard join


def expected_components(rows):
    sets = {}
    for key, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets[key] = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) > 0:
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {(key, len(sets[key]), find(key)) for key in sets}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_brute_force(make_documents, odd_texts, seed):
    rows = [(key, text) for key, text in dict(odd_texts).items() if key is not None] + [(100 + key, text.upper() if key % 2 else text) for key, text in near_copies(seed)]
    got = {tuple(row) for row in link_documents(make_documents(rows)).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == expected_components(rows)


def test_rows_without_id_and_empty_tables(make_documents):
    got = link_documents(make_documents([(None, prose(1, 30)), (4, prose(1, 30)), (4, prose(1, 30)), (5, prose(1, 30))])).collect()
    assert Counter((row["doc_id"], row["component_id"]) for row in got) == Counter({(None, None): 1, (4, 4): 2, (5, 4): 1})
    assert link_documents(make_documents([])).count() == 0


def test_linked_sets_share_a_key_on_either_side_of_the_boundary():
    chooser = random.Random(4)
    for size in [9, 10, 14, 18, 19, 20, 21, 22, 40, 90, 300]:
        for _ in range(40):
            words = [str(chooser.randrange(10**9)) for _ in range(size + 2)]
            changed = list(words)
            for _ in range(chooser.choice([1, 1, 2, 3])):
                changed[chooser.choice([0, -1]) if size < 40 else chooser.randrange(len(changed))] = str(chooser.randrange(10**9))
            if chooser.random() < 0.5:
                changed += [str(chooser.randrange(10**9)) for _ in range(chooser.choice([1, 2]))]
            tokens, counts = shingle_sets([" ".join(words).encode(), " ".join(changed).encode()])
            first, second = set(tokens[: counts[0]].tolist()), set(tokens[counts[0] :].tolist())
            if first != second and 100 * len(first & second) >= 90 * len(first | second):
                for light in (8, 12, 19, 21):
                    keys, owner = set_keys(tokens, counts, light)
                    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert choose_boundary({10: 100, 12: 100, 25: 100, 40: 5}) == 12
