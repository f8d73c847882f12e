"""N-gram Jaccard join by size: subsets for light sets, inverted lists for heavy ones.

Two documents link when 100 x common shingles >= ``percent`` x shingles of either. A light set
enumerates its subsets of the sizes at which it could link. A heavy set differs from any linked one
in at most (a + b) x (100 - percent) / (100 + percent) shingles, a nineteenth of a + b at 90 and a
ninth at 80. A set dealt by hash into parts of which more than that are filled has one that is the
same in both: its lists are keyed by parts, which a shared passage alone seldom makes equal. At lower
percentages parts hold few shingles and passages do make them equal; with ``rare`` the lists are keyed by
the rarest shingles instead, of which linked sets share one whatever passages they hold. The size
that divides light from heavy is the one at which the keys cost least.

Keys give candidate groups, not pairs: lists are reduced to stars within a task and within a key
range, and stars to groups. In a large corpus single keys that meet by chance, or for a passage, chain
many documents to one group. Of groups too large for a task the documents are keyed once more, by the
shingles that fewest documents of the group hold, until that divides them no further. Within a group each distinct set scans the inverted lists of the sets
not reached yet, so every link between different texts is decided exactly and no pair is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, chunks, joined_bytes, lower_ascii, utf8, written
from lodestone.llm.components import connected_components
from lodestone.llm.sieve import caught, sieve, slot
from lodestone.operators.skew import salted_join
from lodestone.session import cut_lineage

SHINGLE = 3
# Common shingles of two linked sets, in hundredths of the shingles of either.
PERCENT = 90
# Shingles of one verifying task; larger groups are split into pairs of blocks.
BLOCK_SHINGLES = 1_500_000
# A list entry is sorted and its set verified; a subset is sorted.
LIST_COST = 4
# Groups are keyed again while a round leaves at most this share of the shingles that splitting them would send once more.
WORTH_ROUND = 0.75
MOST_LIGHT = 40
# Key entries of a task that are dealt out together.
DEALT_ENTRIES = 1_000_000
ROUNDS = 3
# Key ranges whose edges are reduced together, level by level; a document is in as many edges at most as ranges are left, this many.
MERGED_RANGES = 8
# Counters of shingles, by hash: 16 MB at any size of the corpus. They only order shingles, so that collisions lose no link.
COUNTERS = 1 << 22
COUNTER_SLICES = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles (of ``shingle`` words) of all texts, sorted within each, and how many each text has.

    Words are runs of bytes other than space and 9 to 13, with A-Z lowered; a text of fewer words
    than a shingle has the whole sequence as its shingle.
    """
    data, _, ends = joined_bytes(texts, b" ")
    data = lower_ascii(data)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data), _BASE))
        undo = np.cumprod(np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        word = _mix((sums[stops] - sums[starts]) * undo[starts])
        owner = np.searchsorted(ends, starts, side="right")
        count = np.bincount(owner, minlength=len(texts))
        size = np.minimum(count, shingle)[owner]
        left = np.cumsum(count)[owner] - np.arange(len(owner))
        first = np.flatnonzero(left >= size)
        held = _mix(word[first] + size[first].astype(np.uint64))
        for step in range(1, shingle):
            more = size[first] > step
            held[more] = _mix(held[more] + word[first[more] + step])
    owner = owner[first]
    order = np.lexsort((held, owner))
    held, owner = held[order], owner[order]
    fresh = np.ones(len(held), dtype=bool)
    fresh[1:] = (held[1:] != held[:-1]) | (owner[1:] != owner[:-1])
    return held[fresh], np.bincount(owner[fresh], minlength=len(texts))


def least_linked(percent: int) -> int:
    """The smallest set that can link with another than its equal."""
    return -(-percent // (100 - percent))


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any linked one, at least; also the smallest size of one."""
    return -(-percent * n // 100)


def size_classes(largest: int, percent: int = PERCENT) -> np.ndarray:
    """First sizes of classes such that linked sets lie in the same or in neighbouring classes."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(100 * firsts[-1] // percent + 1)
    return np.array([*firsts, 100 * firsts[-1] // percent + 1], dtype=np.int64)


def parts_of(firsts: np.ndarray, cls: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """One more than the shingles in which linked sets up to the class's largest size can differ."""
    return 2 * (firsts[cls + 1] - 1) * (100 - percent) // (100 + percent) + 1


def seats_of(firsts: np.ndarray, cls: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Parts that the sets of a class and of the one before are dealt into, so that mostly ``parts_of`` of them are filled."""
    need, smallest = parts_of(firsts, cls, percent), firsts[np.maximum(cls - 1, 0)]
    seats = need
    for _ in range(20):
        empty = seats * np.exp(-smallest / seats)
        seats = np.maximum(seats, need + (empty + 3 * np.sqrt(empty)).astype(np.int64))
    return np.minimum(seats, need + smallest)


def light_keys(n: int, percent: int = PERCENT) -> int:
    return sum(comb(n, out) for out in range(n - least_common(n, percent) + 1)) if n >= least_linked(percent) else 0


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size at which all keys together cost least; ``sizes`` counts the sets of each size up to ``MOST_LIGHT``."""
    firsts = size_classes(MOST_LIGHT + 2, percent)
    heavy = {n: 2 * int(seats_of(firsts, np.searchsorted(firsts, n, side="right") - 1, percent)) * LIST_COST for n in sizes}
    cost = {
        x: sum(m * (light_keys(n, percent) if n <= x else heavy[n]) for n, m in sizes.items()) for x in range(least_linked(percent) - 1, MOST_LIGHT + 1)
    }
    return min(cost, key=lambda x: (cost[x], x))


def shingle_counts(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many documents hold shingles of each counter (the low bits of the hash), over all ``texts`` (data)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in chunks(batches, "data"):
            tokens, _ = shingle_sets(batch.column("data").to_pylist(), shingle)
            np.add.at(seen, (tokens & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        # Small counts: planes of bytes, mostly zeros above the first, travel compressed.
        parts = [pa.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) for part in np.split(seen, COUNTER_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNTER_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = COUNTERS // COUNTER_SLICES
        total = np.zeros(width, np.int64)
        for batch in batches:
            for part in batch.column("counts"):
                data = pa.decompress(part.as_py(), 4 * width, "zstd", asbytes=True)
                total += np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        data = np.minimum(total, 2**32 - 1).astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["slice", "counts"])

    summed = texts.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    # One row a slice: 16 MB.
    found = np.zeros(COUNTERS, np.uint32)
    for row in summed.collect():
        np.split(found, COUNTER_SLICES)[row["slice"]][:] = np.frombuffer(row["counts"], "<u4")
    return found


def rare_keys(tokens: np.ndarray, counts: np.ndarray, sets: np.ndarray, ranks: np.ndarray, percent: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of ``sets`` by ``ranks`` (of all tokens) and hash, as many as make linked sets share one, for either class of sizes.

    Of these, those with a rank under ``least`` are left out.
    """
    counts, first = counts[sets], (np.cumsum(counts) - counts)[sets]
    begin = np.cumsum(counts) - counts
    nth = np.arange(counts.sum()) - np.repeat(begin, counts)
    at, place = nth + np.repeat(first, counts), np.repeat(np.arange(len(sets)), counts)
    own = tokens[at]
    # Tokens stand in one hash's order within a set and the sort is stable, so that all sets (of a group) order them alike.
    order = np.argsort((place << 32) | ranks[at], kind="stable")
    few = order[nth < np.repeat(counts - -(-percent * counts // 100) + 1, counts)]
    few = few[ranks[at[few]] >= least]
    cls = np.searchsorted(size_classes(int(counts.max(initial=1)), percent), counts, side="right") - 1
    with np.errstate(over="ignore"):
        keys = [_mix(own[few] ^ _mix((cls[place[few]] + above + 1).astype(np.uint64))) for above in (0, 1)]
    return np.concatenate(keys), np.tile(sets[place[few]], 2)


def set_keys(
    tokens: np.ndarray, counts: np.ndarray, light: int, percent: int = PERCENT, rarity: np.ndarray | None = None, holders: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets and the set each belongs to. Linked sets that differ have one key in common at least.

    Heavy sets are keyed by their rarest shingles where ``rarity`` counts them, or ``holders`` tells for each
    of ``tokens`` how many sets hold it at most (one set alone: no key), else by parts.
    """
    ranks = holders if rarity is None else rarity[(tokens & np.uint64(len(rarity) - 1)).astype(np.int64)]
    first = np.cumsum(counts) - counts
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero((counts <= light) & (counts >= least_linked(percent))):
            own = _mix(tokens[first[i] : first[i] + counts[i]])
            whole, n = own.sum(dtype=np.uint64), int(counts[i])
            for out in range(n - least_common(n, percent) + 1):
                # The sum of a subset is the whole less what is left out.
                gone = np.array([own[list(some)].sum(dtype=np.uint64) for some in combinations(range(n), out)], dtype=np.uint64)
                keys.append(_mix((whole - gone) ^ np.uint64(n - out)))
                owners.append(np.full(len(gone), i))
        firsts = size_classes(int(counts.max(initial=1)), percent)
        heavy = np.flatnonzero(counts >= max(least_linked(percent), least_common(light + 1, percent)))
        if ranks is not None:
            key, owner = rare_keys(tokens, counts, heavy, ranks, percent, 0 if holders is None else 2)
            keys.append(key)
            owners.append(owner)
        for above in (0, 1) if ranks is None else ():
            cls = np.searchsorted(firsts, counts[heavy], side="right") - 1 + above
            pending, need, seats = heavy, parts_of(firsts, cls, percent), seats_of(firsts, cls, percent)
            for number in range(ROUNDS):
                # The part of a shingle, and sums of mixed shingles per part in two exact halves.
                flat = np.repeat(first[pending] - np.insert(np.cumsum(counts[pending])[:-1], 0, 0), counts[pending]) + np.arange(counts[pending].sum())
                begin = np.cumsum(seats) - seats
                part = _mix(tokens[flat] + np.uint64(number + 1)) % np.repeat(seats, counts[pending]).astype(np.uint64)
                seat = part.astype(np.int64) + np.repeat(begin, counts[pending])
                mixed, total = _mix(tokens[flat] ^ _MIX[0]), int(seats.sum())
                low = np.bincount(seat, weights=(mixed & np.uint64(0xFFFFFFFF)).astype(float), minlength=total).astype(np.uint64)
                high = np.bincount(seat, weights=(mixed >> np.uint64(32)).astype(float), minlength=total).astype(np.uint64)
                filled = np.bincount(seat, minlength=total) > 0
                nth = np.arange(total) - np.repeat(begin, seats)
                label = (np.repeat(seats, seats) * ROUNDS + number).astype(np.uint64) * _MIX[1] + nth.astype(np.uint64)
                key = _mix(_mix(low + high * _BASE) ^ _mix(label))
                # An empty part says nothing; a set with too few filled ones is dealt again, the last time with empty parts.
                kept = filled
                if number == ROUNDS - 1:
                    kept = filled | np.repeat(np.add.reduceat(filled, begin, dtype=np.int64) < need, seats) if total else filled
                keys.append(key[kept])
                owners.append(np.repeat(pending, seats)[kept])
                again = np.add.reduceat(filled, begin, dtype=np.int64) < need if total else np.zeros(0, bool)
                pending, need, seats = pending[again], need[again], seats[again]
                if not len(pending):
                    break
    return np.concatenate(keys), np.concatenate(owners)


def stars(groups: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that each reaches through common groups, where that is another."""
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    ids, place = np.unique(nodes[order], return_inverse=True)
    edge = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    label = np.arange(len(ids))
    while len(edge):
        least = np.minimum.reduceat(label[place], edge)
        fresh = label.copy()
        np.minimum.at(fresh, place, np.repeat(least, np.diff(edge, append=len(groups))))
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def verified(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links enough to join all linked sets of a group: each set reached scans the lists of those not reached yet."""
    sets = len(counts)
    first = np.cumsum(counts) - counts
    _, token = np.unique(tokens, return_inverse=True)
    order = np.argsort(token, kind="stable")
    listed, members = token[order], np.repeat(np.arange(sets), counts)[order]
    kinds = int(token.max(initial=-1)) + 1
    begin = np.searchsorted(listed, np.arange(kinds + 1))
    waiting, alive = np.ones(sets, dtype=bool), sets
    for seed in range(sets):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        frontier = [seed]
        while frontier:
            mine = frontier.pop()
            own = token[first[mine] : first[mine] + counts[mine]]
            sizes = begin[own + 1] - begin[own]
            at = np.repeat(begin[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            common = np.bincount(members[at], minlength=sets)
            near = np.flatnonzero(waiting & (common > 0) & (100 * common >= percent * (counts[mine] + counts - common)))
            waiting[near] = False
            frontier.extend(near.tolist())
            yield from ((seed, int(other)) for other in near)
            if (left := int(waiting.sum())) <= alive // 2:
                # Reached sets leave the lists.
                kept = waiting[members]
                listed, members, alive = listed[kept], members[kept], left
                begin = np.searchsorted(listed, np.arange(kinds + 1))


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def candidate_edges(
    texts: DataFrame, light: int, rows: int, shingle: int = SHINGLE, percent: int = PERCENT, rarity: np.ndarray | None = None
) -> DataFrame:
    """Edges (a, b) that join all documents with a common key; ``texts`` has doc_id and data (binary), ``rows`` of them."""
    ranges = key_ranges(rows, percent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in chunks(batches, "data", 1_000_000):
            key, owner = set_keys(*shingle_sets(batch.column("data").to_pylist(), shingle), light, percent, rarity)
            held.append((key, batch.column("doc_id").to_numpy()[owner]))
            if sum(len(part) for part, _ in held) > DEALT_ENTRIES:
                yield dealt_out(*map(np.concatenate, zip(*held, strict=True)), ranges)
                held = []
        if held:
            yield dealt_out(*map(np.concatenate, zip(*held, strict=True)), ranges)

    return met_edges(texts.mapInArrow(deal, DEALT), ranges)


def key_ranges(rows: int, percent: int) -> int:
    # A document is named once in each range that holds one of its keys, so ranges are few; at 20,000
    # documents one holds some two million entries at 90, and parts are more at a lower percentage.
    return int(min(65_536, max(8, rows * (100 - percent) ** 2 // 2_000_000)))


DEALT = "r int, keys binary, docs binary"


def dealt_out(key: np.ndarray, node: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Entries of keys by range (of ``ranges``), and without keys the edges that stars of equal ones give here already."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    # Of a key's entries here only the smallest is sent to the others'; the rest hang on it.
    a, b = stars(np.cumsum(fresh), node)
    key, node = key[fresh], node[fresh]
    bucket = (key >> np.uint64(33)) % np.uint64(ranges)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(ranges + 1, dtype=np.uint64))
    kept = [(r, order[cuts[r] : cuts[r + 1]]) for r in range(ranges) if cuts[r] < cuts[r + 1]]
    ready = [int(bucket[0])] if len(a) else []
    return pa.RecordBatch.from_arrays([
        pa.array([r for r, _ in kept] + ready, pa.int32()),
        pa.array([_planes(key[at]) for _, at in kept] + [None] * len(ready), pa.binary()),
        pa.array([_planes(node[at]) for _, at in kept] + [_planes(np.concatenate([a, b]))] * len(ready), pa.binary()),
    ], names=["r", "keys", "docs"])


def met_edges(dealt: DataFrame, ranges: int) -> DataFrame:
    """Edges (a, b) that join all documents with a common key, from what ``dealt_out`` deals."""

    def meet(table: pa.Table) -> pa.Table:
        columns, ready, size = (table.column("keys"), table.column("docs")), [], 0
        # Filled in place, block by block, so that a range is held about once.
        key = np.empty(sum(data.nbytes for data in columns[1].chunks) // 8, np.uint64)
        node = np.empty(len(key), np.int64)
        for keys, docs in zip(*columns, strict=True):
            part = _unplaned(docs.as_py()).view(np.int64)
            if keys.is_valid:
                key[size : size + len(part)], node[size : size + len(part)] = _unplaned(keys.as_py()), part
                size += len(part)
            else:
                ready.append(part.reshape(2, -1))
        order = np.argsort(key[:size], kind="stable")
        key, node = key[:size][order], node[:size][order]
        del order
        same = key[1:] == key[:-1]
        often = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(key) else np.zeros(0, np.int64)
        found = np.concatenate([np.array(stars(key[often], node[often])).reshape(2, -1).astype(np.int64), *ready], axis=1)
        return packed(table, found)

    def packed(table: pa.Table, found: np.ndarray) -> pa.Table:
        return pa.table({"r": pa.array([table.column("r")[0].as_py()], pa.int32()), "edges": pa.array([pa.compress(_planes(found.reshape(-1)), "zstd", asbytes=True)], pa.binary()),
                         "n": pa.array([found.shape[1]], pa.int64())})

    def merged(table: pa.Table) -> np.ndarray:
        # A document hangs on another in every range that holds a common key of theirs; of these edges one is kept.
        parts = [
            _unplaned(pa.decompress(edges.as_py(), 16 * n.as_py(), "zstd", asbytes=True)).view(np.int64).reshape(2, -1) for edges, n in zip(table.column("edges"), table.column("n"), strict=True)
        ]
        ends = np.concatenate(parts, axis=1)
        return np.array(stars(np.tile(np.arange(ends.shape[1]), 2), ends.reshape(-1))).reshape(2, -1).astype(np.int64)

    def pairs(table: pa.Table) -> pa.Table:
        a, b = merged(table)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    edges = dealt.groupBy("r").applyInArrow(meet, "r int, edges binary, n long")
    while True:
        ranges = -(-ranges // MERGED_RANGES)
        joined = edges.withColumn("r", F.expr(f"r div {MERGED_RANGES}").cast("int")).groupBy("r")
        if ranges <= MERGED_RANGES:
            return joined.applyInArrow(pairs, "a long, b long")
        edges = joined.applyInArrow(lambda table: packed(table, merged(table)), "r int, edges binary, n long")


def packed_texts(texts: DataFrame, home: DataFrame) -> DataFrame:
    """``home`` with the texts of its doc_id in ``texts`` (doc_id, data) as zstd frames; other texts cross no shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            batch = batch.filter(pa.array(caught(wanted, batch.column("slot").to_numpy())))
            packed = pa.array([packer.compress(data) for data in batch.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], names=["doc_id", "data"])

    wanted = sieve(home, "doc_id")
    packed = texts.where("doc_id IS NOT NULL").withColumn("slot", slot("doc_id")).mapInArrow(squeeze, "doc_id long, data binary")
    return packed.join(home, "doc_id")


def frame_cuts(frames: list[bytes]) -> list[int]:
    """Where to cut zstd frames into runs of about ``CHUNK_BYTES`` of text."""
    sizes = np.cumsum([zstandard.frame_content_size(data) for data in frames]) // CHUNK_BYTES
    return [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(frames)] if frames else [0]


def large_groups(grouped: DataFrame) -> DataFrame:
    """Rows of groups with more shingles than one task verifies, and the blocks (``nb``) that they would be split into."""
    volume = grouped.groupBy("grp").agg(F.sum("n_shingles").alias("volume")).where(F.col("volume") > BLOCK_SHINGLES)
    # No more rows than all shingles hold blocks.
    return grouped.join(F.broadcast(volume.select("grp", F.ceil(F.col("volume") / F.lit(BLOCK_SHINGLES)).alias("nb"))), "grp")


def refined(grouped: DataFrame, texts: DataFrame, light: int, shingle: int, percent: int) -> DataFrame:
    """``grouped`` (rep, n_shingles, grp) with its large groups divided, as far as keys can; linked documents stay together.

    Their documents get candidates once more, by the shingles that fewest documents of the same group hold.
    Here every shingle is counted by itself, for which the counters of the whole corpus are too few.
    """
    held, before = None, None
    while True:
        large = cut_lineage(large_groups(grouped))
        rows, volume, again = large.agg(F.count(F.lit(1)), F.sum("n_shingles"), F.sum(F.col("n_shingles") * (F.col("nb") - 1))).first()
        if not rows or before is not None and again > WORTH_ROUND * before:
            return grouped
        before = again
        chunk = F.pmod(F.xxhash64("rep"), F.lit(-(-volume // BLOCK_SHINGLES))).cast("int").alias("chunk")
        home = large.select(F.col("rep").alias("doc_id"), "grp", chunk)
        found = packed_texts(texts, home) if held is None else held.select("doc_id", "data").join(home, "doc_id")
        held = written(found.select("chunk", "grp", "doc_id", "data"), "large-groups")
        finer = connected_components(group_edges(held, rows, volume, light, shingle, percent))
        divided = large.join(finer.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n_shingles", F.coalesce("root", "rep").alias("grp"))
        grouped = cut_lineage(grouped.join(large.select("rep"), "rep", "left_anti").unionByName(divided))


def group_edges(texts: DataFrame, rows: int, volume: int, light: int, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) that join all documents of one group with a common key; ``texts`` has chunk, grp, doc_id and data (zstd frames).

    The shingles of a chunk go to ranges of hashes, where their holders are counted, and only the numbers come back.
    Forty bits of a hash travel: a chance meeting makes a shingle less rare for all its holders, and loses no link.
    """
    ranges, counted = key_ranges(rows, percent), int(max(8, -(-volume // BLOCK_SHINGLES)))

    def sets(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = table.take(pc.sort_indices(table.column("doc_id")))
        frames, groups = table.column("data").to_pylist(), table.column("grp").to_numpy().astype(np.uint64)
        cuts, unpack = frame_cuts(frames), zstandard.ZstdDecompressor().decompress
        parts = [shingle_sets([unpack(data) for data in frames[start:end]], shingle) for start, end in zip(cuts, cuts[1:], strict=False)]
        tokens, counts = map(np.concatenate, zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *parts, strict=True))
        # Equal shingles of different groups differ; those of one group keep their order.
        with np.errstate(over="ignore"):
            return table, _mix(tokens ^ np.repeat(_mix(groups + _BASE), counts)), counts

    def by_range(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(tokens)
        bounds = (np.arange(1, counted, dtype=np.uint64) * np.uint64(2**64 // counted)).astype(np.uint64)
        return order, np.concatenate([[0], np.searchsorted(tokens[order], bounds), [len(tokens)]])

    def offer(table: pa.Table) -> pa.Table:
        table, tokens, _ = sets(table)
        order, cuts = by_range(tokens)
        kept = [r for r in range(counted) if cuts[r] < cuts[r + 1]]
        steps = [np.diff(tokens[order[cuts[r] : cuts[r + 1]]] >> np.uint64(24), prepend=np.uint64(0)) for r in kept]
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(kept), pa.int32()), "r": pa.array(kept, pa.int32()), "tokens": pa.array([_planes(part) for part in steps], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(_unplaned(data), dtype=np.uint64) for data in table.column("tokens").to_pylist()]
        _, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        numbers = np.split(n[place].astype(np.uint64), np.cumsum([len(part) for part in parts])[:-1])
        return pa.table({"chunk": table.column("chunk"), "r": table.column("r"), "holders": pa.array([pa.compress(_planes(part), "zstd", asbytes=True) for part in numbers], pa.binary()), "n": pa.array([len(part) for part in parts], pa.int64())})

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, tokens, counts = sets(table)
        answers = answers.take(pc.sort_indices(answers.column("r")))
        holders = np.empty(len(tokens), np.int64)
        told = [_unplaned(pa.decompress(data.as_py(), 8 * n.as_py(), "zstd", asbytes=True)) for data, n in zip(answers.column("holders"), answers.column("n"), strict=True)]
        holders[by_range(tokens)[0]] = np.concatenate([np.zeros(0, np.uint64), *told]).astype(np.int64)
        key, owner = set_keys(tokens, counts, light, percent, holders=holders)
        return pa.Table.from_batches([dealt_out(key, table.column("doc_id").to_numpy()[owner], ranges)])

    chunked = texts.groupBy("chunk")
    answers = chunked.applyInArrow(offer, "chunk int, r int, tokens binary").groupBy("r").applyInArrow(count, "chunk int, r int, holders binary, n long")
    return met_edges(chunked.cogroup(answers.groupBy("chunk")).applyInArrow(deal, DEALT), ranges)


def link_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rare: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents`` (doc_id, text), linked at ``percent`` (1 to 99).

    ``rare`` keys the lists of heavy sets by their rarest shingles, at the price of counting all
    shingles first; the result is the same.

    Texts without a word, and null texts, have no shingles and link with nothing; component_id is
    the smallest doc_id that links reach. Rows of one doc_id are one document's and count as linked.
    A null doc_id takes part in no link and has a null component. Other columns are not read.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "data"):
            tokens, counts = shingle_sets(batch.column("data").to_pylist(), shingle)
            ends = np.cumsum(counts)
            with np.errstate(over="ignore"):
                marks = []
                for salt in _MIX:
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(tokens ^ salt))])
                    marks.append(pa.array((sums[ends] - sums[ends - counts]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), *marks], names=["doc_id", "n_shingles", "mark", "check"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("data"))
    sizes = cut_lineage(texts.mapInArrow(describe, "doc_id long, n_shingles long, mark long, check long"))
    few = dict(sizes.where(f"n_shingles BETWEEN 1 AND {MOST_LIGHT}").groupBy("n_shingles").count().collect())
    light = choose_boundary(few, percent)
    rarity = shingle_counts(texts, shingle) if rare else None
    groups = connected_components(candidate_edges(texts.where("doc_id IS NOT NULL"), light, sizes.count(), shingle, percent, rarity))

    # Equal sets are one: their smallest document stands for them.
    same = ["mark", "check", "n_shingles"]
    known = sizes.where("doc_id IS NOT NULL AND n_shingles > 0")
    equal = cut_lineage(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    stood = salted_join(known, equal, same, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    stood = cut_lineage(stood)
    distinct = stood.where("doc_id = rep").select("rep", "n_shingles")
    grouped = distinct.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n_shingles", F.coalesce("root", "rep").alias("grp"))
    grouped = cut_lineage(grouped)
    if rare:
        grouped = refined(grouped, texts, light, shingle, percent)
    volume = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("volume")).where("m > 1")
    blocks = F.ceil(F.col("volume") / F.lit(BLOCK_SHINGLES)).cast("int")
    placed = grouped.join(volume.select("grp", blocks.alias("nb")), "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    # All pairs of blocks of a split group; a block goes to the others' tasks, not to one task for all.
    others = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda other: (other != F.col("block")) | (F.col("nb") == 1))
    seats = placed.select("rep", "grp", "block", F.explode(others).alias("other")).select(
        F.col("rep").alias("doc_id"), F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "grp"
    )
    home = cut_lineage(seats)
    tasks = int(min(100_000, max(8, home.count() // 2_000)))

    # Texts of candidate groups travel twice, to their documents' tasks and on to their groups'; both times as zstd frames.
    rows = packed_texts(texts, home).select("task", "grp", "doc_id", "data")
    rows = rows.repartition(tasks, "task").sortWithinPartitions("task", "grp", "doc_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided(held: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
            # Some texts at a time: the hashes of a byte take many times its room.
            cuts = frame_cuts([data for _, data in held])
            unpack = zstandard.ZstdDecompressor().decompress
            sets = [shingle_sets([unpack(data) for _, data in held[start:end]], shingle) for start, end in zip(cuts, cuts[1:], strict=False)]
            tokens, counts = map(np.concatenate, zip(*sets, strict=True))
            return [(held[i][0], held[j][0]) for i, j in verified(tokens, counts, percent)]

        held, task, found = [], None, []
        for batch in batches:
            for one, group, doc, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (one, group) != task:
                    found += decided(held) if len(held) > 1 else []
                    held, task = [], (one, group)
                held.append((doc, data))
        found += decided(held) if len(held) > 1 else []
        a, b = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())], names=["a", "b"])

    roots = connected_components(rows.mapInArrow(verify, "a long, b long"))
    linked = stood.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    result = linked.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    alone = sizes.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(alone)
