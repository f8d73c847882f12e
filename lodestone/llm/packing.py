"""Best-fit packing by linear grouping.

Tokenizing and cutting are Spark work; the plan needs only the histogram of piece lengths, which the
capacity bounds. Large lengths are rounded up within groups of equal cardinality, a linear program
over configurations of the few rounded sizes is solved by column generation, actual lengths take the
places of rounded ones, and everything left is placed by best fit. The plan is a short list of
rank intervals per length; each document finds its own place by its rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import gathered
from lodestone.llm.tokens import WordIds, ended_ids
from lodestone.session import cut_lineage

# Text that is encoded at once in a task.
ENCODED_BYTES = 4_000_000

Place = tuple[int, int, int, int, int, int]  # length, first rank, pieces per bin, bins, first sequence, offset


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Basic solution of the configuration program: patterns over ``sizes`` and how often each is used."""
    kinds = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(60 * kinds):
        prices = np.linalg.solve(basis.T, np.ones(kinds))
        best, choice = np.zeros(capacity + 1), np.full((capacity // int(sizes.min()) + 1, capacity + 1), -1)
        for step in range(1, len(choice)):
            tried = np.full((kinds, capacity + 1), -1.0)
            for kind, size in enumerate(sizes):
                tried[kind, size:] = best[: capacity + 1 - size] + prices[kind]
            top = tried.argmax(axis=0)
            value = tried[top, np.arange(capacity + 1)]
            choice[step] = np.where(value > best + 1e-12, top, -1)
            best = np.maximum(best, value)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(kinds), capacity
        for step in range(len(choice) - 1, 0, -1):
            if (kind := choice[step, room]) >= 0:
                column[kind] += 1
                room -= int(sizes[kind])
        level, change = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), level[j]) for j in range(kinds) if level[j] > 1e-9]


def plan(counts: dict[int, int], capacity: int, groups: int = 256, small: float = 1 / 3) -> list[Place]:
    """Places for ``counts`` pieces of each length; sequence numbers are gapless from 0."""
    places: list[Place] = []
    taken: dict[int, int] = {}
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of bins (first sequence, bins)

    def put(length: int, each: int, bins: int, first: int, room: int) -> None:
        rank = taken.get(length, 0)
        places.append((length, rank, each, bins, first, capacity - room))
        taken[length] = rank + each * bins
        rooms.setdefault(room - each * length, []).append((first, bins))

    if counts.get(capacity):
        put(capacity, 1, counts[capacity], 0, capacity)
        sequences = counts[capacity]
    left = {length: n for length, n in counts.items() if n and length < capacity}
    large = sorted((length for length in left if length > capacity * small), reverse=True)
    total = sum(left[length] for length in large)
    if total:
        share = -(-total // groups)
        runs: list[list[list[int]]] = [[]]  # of each group, from its largest length down
        room = share
        for length in large:
            n = left[length]
            while n:
                if not room:
                    runs.append([])
                    room = share
                part = min(n, room)
                runs[-1].append([length, part])
                n, room = n - part, room - part
        sizes = np.array([run[0][0] for run in runs])
        # Groups that begin with one length are one size.
        kinds = sorted(set(sizes.tolist()), reverse=True)
        of = {size: [run for group in runs if group[0][0] == size for run in group] for size in kinds}
        demand = np.array([float(sum(n for _, n in of[size])) for size in kinds])
        for pattern, level in configurations(np.array(kinds), demand, capacity):
            bins = int(level + 1e-6)
            if not bins:
                continue
            held = [(sequences, bins, capacity)]
            sequences += bins
            for kind in np.repeat(np.arange(len(kinds)), pattern):
                queue, after = of[kinds[kind]], []
                for first, n, free in held:
                    while n and queue:
                        length, there = queue[0]
                        part = min(n, there)
                        rank = taken.get(length, 0)
                        places.append((length, rank, 1, part, first, capacity - free))
                        taken[length], left[length] = rank + part, left[length] - part
                        after.append((first, part, free - length))
                        first, n = first + part, n - part
                        queue[0][1] -= part
                        if not queue[0][1]:
                            queue.pop(0)
                    if n:
                        after.append((first, n, free))
                held = after
            for first, n, free in held:
                rooms.setdefault(free, []).append((first, n))
    for length in sorted(left, reverse=True):
        n = left[length]
        room = length
        while n:
            while room < capacity and not rooms.get(room):
                room += 1
            if room < capacity or rooms.get(room):
                first, bins = rooms[room].pop()
            else:
                first, bins, room = sequences, -(-n // (capacity // length)), capacity
                sequences += bins
            each = room // length
            full = min(bins, n // each)
            if full:
                put(length, each, full, first, room)
                n -= each * full
                first, bins = first + full, bins - full
            if bins and n:
                put(length, n, 1, first, room)
                n, first, bins = 0, first + 1, bins - 1
            if bins:
                rooms.setdefault(room, []).append((first, bins))
    return places


def token_pieces(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids).

    A document is the ids of its whole text (null: empty) and then ``end_id``. The result has a row
    for each piece of each input row, so an empty text gives one piece of one token.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.shared(path)
        for batch in gathered(batches, "text", ENCODED_BYTES):
            data, bounds = ended_ids(encoder, batch.column("text"), end_id)
            sizes = np.diff(bounds)
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            view, first = memoryview(data).cast("B"), 4 * (bounds[owner] + start)
            sums = [zlib.crc32(view[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 256, rows_a_part: int = 5_000_000) -> DataFrame:
    """``pieces`` with sequence_id and offset: no sequence holds more than ``capacity``, and offsets in one are gapless.

    ``length`` must be 1 to ``capacity``. Ranks within one length are counted in parts, so a length
    that a third of all pieces share is spread. An empty table gives an empty result.
    """
    pieces = cut_lineage(pieces)
    counts = dict(pieces.groupBy("length").count().collect())  # at most ``capacity`` rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    parts = 64 + sum(counts.values()) // rows_a_part
    spread = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("length", "__part").count().select(
        "length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = spread.withColumn("__nth", F.row_number().over(inside)).join(sizes, ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__nth") - 1).drop("__part", "__nth", "__before")
    places = np.array(sorted(plan(counts, capacity, groups)), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {length: (places[places[:, 0] == length]) for length in np.unique(places[:, 0])}
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "__rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at, rows = np.flatnonzero(length == value), starts[value]
                row = rows[np.searchsorted(rows[:, 1], rank[at], side="right") - 1]
                nth = rank[at] - row[:, 1]
                sequence[at], offset[at] = row[:, 4] + nth // row[:, 2], row[:, 5] + nth % row[:, 2] * value
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{name}` {kind}" for name, kind in ranked.dtypes[:-1])
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048, groups: int = 256) -> DataFrame:
    """Tokenize, cut and pack ``documents`` (doc_id, text); other columns are not read."""
    packed = pack(token_pieces(documents, path, capacity), capacity, groups)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
