"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases whose ends depend on nearby symbols only: deterministic coin tossing
labels each symbol by the lowest bit in which it differs from its left neighbour, and phrases begin
at local maxima of the labels. Phrases are named by a hash of their symbols and parsed again, until
one name is left. Equal substrings get equal names in their interior, wherever they stand. The
fingerprint is the bottom-k sketch of the names from the third level on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sharding import LEAST_KEY, range_column, splitters

SKETCH = 64
LEVEL = 3
CHUNK_CHARS = 400_000
ROWS_A_RANGE = 4_000
MOST_RANGES = 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ONE = np.uint64(1)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX
    return values ^ (values >> np.uint64(27))


def _coin(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 128 that differ between neighbours, if symbols do; ``first`` has the first symbol of each text."""
    one = symbols.dtype.type(1)
    differ = np.empty_like(symbols)
    np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
    differ[first] = ~symbols.dtype.type(0)
    place = np.bitwise_count(~differ & (differ - one))
    return (place << np.uint8(1)) | ((symbols >> place.astype(symbols.dtype)) & one).astype(np.uint8)


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if len(self.up) < size:
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))]))


def _level(symbols: np.ndarray, first: np.ndarray, number: int, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of all texts, and the place of each text's first one."""
    fresh = np.empty(len(symbols), dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
    fresh[first] = True
    if not fresh.all():
        # A run of one symbol becomes one symbol of its own.
        starts = np.flatnonzero(fresh)
        length = np.diff(starts, append=len(symbols))
        symbols = symbols[starts].astype(np.uint64)
        runs = np.flatnonzero(length > 1)
        symbols[runs] = _mix(symbols[runs] + length[runs].astype(np.uint64) * _STEP)
        first = np.searchsorted(starts, first)
    labels = _coin(_coin(symbols, first), first)
    peak = np.zeros(len(labels), dtype=bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[first[1:] - 1] = False
    peak[first] = True
    starts = np.flatnonzero(peak)
    # The name is the sum of symbol x power over the phrase, taken back to the phrase's start.
    powers.grow(len(symbols))
    sums = np.cumsum((symbols + _ONE) * powers.up[: len(symbols)])
    upto = sums[np.append(starts[1:], len(symbols)) - 1]
    names = upto.copy()
    names[1:] -= upto[:-1]
    names *= powers.down[starts]
    return _mix(names + np.uint64(number) * _MIX), np.searchsorted(starts, first)


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The ``SKETCH`` smallest 32-bit names of each text in order: all names of level 3 and above, and its last name.

    An empty text has none; any other has one at least.
    """
    if not texts:
        return []
    symbols: np.ndarray = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    sizes = np.array([len(text) for text in texts])
    ids, kept, number, powers = np.flatnonzero(sizes), [np.zeros(0, np.uint64)], 0, _Powers()
    first = (np.cumsum(sizes) - sizes)[ids]
    with np.errstate(over="ignore"):
        while len(ids):
            number += 1
            symbols, first = _level(symbols, first, number, powers)
            sizes = np.diff(first, append=len(symbols))
            last = sizes == 1
            if number >= LEVEL:
                kept.append((np.repeat(ids, sizes).astype(np.uint64) << np.uint64(32)) | (symbols >> np.uint64(32)))
            elif last.any():
                kept.append((ids[last].astype(np.uint64) << np.uint64(32)) | (symbols[first[last]] >> np.uint64(32)))
            if last.any():
                symbols, ids, sizes = np.delete(symbols, first[last]), ids[~last], sizes[~last]
                first = np.cumsum(sizes) - sizes
    keys = np.unique(np.concatenate(kept))
    cuts = np.searchsorted(keys, np.arange(1, len(texts), dtype=np.uint64) << np.uint64(32))
    return [part[:SKETCH].astype(np.uint32) for part in np.split(keys, cuts)]


def spelled(sketch: np.ndarray) -> str:
    """A sketch as hexadecimal text, eight digits a name."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of common names among the smallest names of both sketches, 0 to 1; two empty ones are alike."""
    first, second = set(one.tolist()), set(other.tolist())
    union = sorted(first | second)[:SKETCH]
    return sum(name in first and name in second for name in union) / len(union) if union else 1.0


def with_next(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` in ranges of ascending doc_id: columns __range, __guest, doc_id, text, sorted.

    Each range ends with a guest, the first document of the next range (of the first, after the
    last), so that every document's follower lies in its partition. Texts are shuffled once; the
    driver gets a sample of ids and one id per range, both bounded.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST_KEY)).alias("__key"))
    ids = rows.select("__key")
    count = ids.count()
    parts = min(MOST_RANGES, -(-count // ROWS_A_RANGE)) or 1
    chance = F.pmod(F.xxhash64("__key"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, 64 * parts / max(count, 1))) + 1)
    sample = [tuple(row) for row in ids.where(chance).groupBy("__key").count().collect()]
    place = F.expr(range_column(splitters(sample, parts), fan=100)).cast("int")
    heads = sorted(ids.groupBy(place.alias("r")).agg(F.min("__key")).collect())
    # The head of each range is a guest of the range before it. At most MOST_RANGES rows.
    guests = [(row[1], heads[nth - 1][0]) for nth, row in enumerate(heads)]
    known = rows.sparkSession.createDataFrame(guests, "__key long, __host int")
    joined = rows.withColumn("__own", place).join(F.broadcast(known), "__key", "left")
    own = F.struct(F.col("__own").alias("__range"), F.lit(0).alias("__guest"))
    guest = F.struct(F.col("__host").alias("__range"), F.lit(1).alias("__guest"))
    seats = F.explode(F.when(F.col("__host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("__seat")
    seated = joined.select("doc_id", "text", seats).select("__seat.__range", "__seat.__guest", "doc_id", "text")
    return seated.repartition(parts, "__range").sortWithinPartitions("__range", "__guest", "doc_id", "text")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` (doc_id, text) and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in ascending doc_id; equal ids follow each other in the order of their
    texts, a null id comes first, a null text is empty. An empty text has an empty fingerprint.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next; an empty table gives an empty result. Other columns are not read.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, str]]:
        held: list[tuple[object, str]] = []
        size = 0
        for batch in batches:
            for guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if held and (guest or size > CHUNK_CHARS):
                    yield held, text
                    held, size = [], 0
                if not guest:
                    held.append((doc_id, text))
                    size += len(text)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, follower in runs(batches):
            texts = [text for _, text in held] + [follower]
            edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for text, after in zip(texts, texts[1:], strict=False)]
            prints = sketches(texts)
            changed = sketches(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([doc_id for doc_id, _ in held], pa.int64()), pa.array([len(text) for text in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for text in edited]),
                pa.array([spelled(sketch) for sketch in prints[:-1]]), pa.array([spelled(sketch) for sketch in changed]),
                pa.array([likeness(a, b) for a, b in zip(prints, changed, strict=False)]),
                pa.array([likeness(a, b) for a, b in zip(prints, prints[1:], strict=False)]),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(documents).mapInArrow(mark, fields)
