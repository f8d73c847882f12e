"""Token ids in binary files, coded by a canonical length-limited Huffman code.

Ids are counted over the whole corpus, code lengths come from package-merge, and codes are canonical,
so a file stores lengths only. A file holds documents in ascending order and their ids in blocks that
decode on their own; a block keeps the bit offset of every ``STEP``-th code, so decoding runs over all
these places side by side, each code by one look into a table.

A file, little-endian: ``MAGIC``; code-length limit (u1); number of ids (u4), size (u4) and bytes of
their zlib-packed lengths (u1 each); part and file number in it (i8 each); documents (u4), block count
(u4); doc ids (i8 each), whether null (u1 each), tokens (i8 each); then for each block its tokens,
payload bytes and checksum (u4 each), one bit offset (u4) for every ``STEP`` tokens, and the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import gathered, new_folder, written
from lodestone.llm.tokens import WordIds, ended_ids
from lodestone.operators.skew import spread_join
from lodestone.session import cut_lineage

MAGIC = b"IDSHUF1\n"
LIMIT = 16
MOST_LIMIT = 24
STEP = 256
BLOCK_TOKENS = 65_536
FILE_TOKENS = 4_000_000
ENCODED_BYTES = 4_000_000
MOST_PARTS = 20_000
HEAD = "<BII"
PLACE = "<qqII"
BLOCK = "<III"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths, at most ``limit``, of the best prefix code for ``counts`` occurrences; 0 for ids that do not occur.

    Package-merge: on each of ``limit`` levels the symbols are merged in order of weight with pairs of the
    level before. The cheapest 2n - 2 items of the last level are taken, and what their pairs are made of;
    a symbol's length is the number of levels on which it is taken.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    pairs, levels = np.zeros(0, np.int64), []
    for _ in range(limit):
        items = np.concatenate([weights, pairs])
        order = np.argsort(items, kind="stable")
        levels.append(order < len(weights))
        items = items[order]
        half = len(items) // 2
        pairs = items[: 2 * half : 2] + items[1 : 2 * half : 2]
    taken = 2 * (len(used) - 1)
    for symbols in reversed(levels):
        plain = int(symbols[:taken].sum())
        lengths[used[:plain]] += 1
        taken = 2 * (taken - plain)
    return lengths


@dataclass(frozen=True)
class Code:
    """A canonical code: shorter codes first, equal lengths by id; ``limit`` bits decide a code."""

    lengths: np.ndarray
    limit: int

    def sorted_ids(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    def codes(self) -> np.ndarray:
        """The code of each id, as a number of its length."""
        ids = self.sorted_ids()
        spans = np.int64(1) << (self.limit - self.lengths[ids].astype(np.int64))
        codes = np.zeros(len(self.lengths), dtype=np.uint32)
        codes[ids] = (np.cumsum(spans) - spans) >> (self.limit - self.lengths[ids].astype(np.int64))
        return codes

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every window of ``limit`` bits."""
        ids = self.sorted_ids()
        spans = np.int64(1) << (self.limit - self.lengths[ids].astype(np.int64))
        shown, held = np.zeros(1 << self.limit, dtype="<u4"), np.zeros(1 << self.limit, dtype=np.int64)
        shown[: spans.sum()], held[: spans.sum()] = np.repeat(ids, spans), np.repeat(self.lengths[ids], spans)
        return shown, held


def encode_file(code: Code, codes: np.ndarray, part: int, number: int, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents with ``sizes`` tokens each, ``ids`` all of them one after another."""
    packed = zlib.compress(code.lengths.tobytes(), 9)
    blocks = -(-len(ids) // BLOCK_TOKENS)
    out = [
        MAGIC, struct.pack(HEAD, code.limit, len(code.lengths), len(packed)), packed, struct.pack(PLACE, part, number, len(doc_ids), blocks),
        np.array([0 if doc_id is None else doc_id for doc_id in doc_ids], dtype="<i8").tobytes(),
        np.array([doc_id is None for doc_id in doc_ids], dtype=np.uint8).tobytes(), sizes.astype("<i8").tobytes(),
    ]
    for first in range(0, len(ids), BLOCK_TOKENS):
        some = ids[first : first + BLOCK_TOKENS]
        bits = code.lengths[some].astype(np.int64)
        ends = np.cumsum(bits)
        starts = ends - bits
        # Each code lies in four bytes: it is at most 24 bits long and begins in the first of them.
        word = codes[some].astype(np.uint32) << (32 - bits - (starts & 7)).astype(np.uint32)
        place, room = starts >> 3, int(ends[-1] + 7 >> 3) + 4
        payload = np.zeros(room, dtype=np.int64)
        for nth in range(4):
            # No two codes share a bit, so adding bytes is joining them.
            share = (word >> np.uint32(24 - 8 * nth)) & np.uint32(255)
            payload += np.bincount(place + nth, weights=share, minlength=room).astype(np.int64)
        data = payload[: room - 4].astype(np.uint8).tobytes()
        out += [struct.pack(BLOCK, len(some), len(data), zlib.crc32(data)), starts[::STEP].astype("<u4").tobytes(), data]
    return b"".join(out)


def decode_block(data: np.ndarray, offsets: np.ndarray, tokens: int, shown: np.ndarray, held: np.ndarray, limit: int) -> np.ndarray:
    """Ids of one block from its payload bytes and the bit offsets of every ``STEP``-th code."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    at, last, mask = offsets.astype(np.int64), 8 * len(data), (1 << limit) - 1
    out = np.zeros((len(offsets), STEP), dtype="<u4")
    for step in range(min(STEP, tokens)):
        window = (words[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32(mask)
        out[:, step] = shown[window]
        # The last place of a block may have fewer codes left; what it reads past them is cut below.
        at = np.minimum(at + held[window], last)
    return out.reshape(-1)[:tokens]


def decode_file(content: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """Part, file number, doc ids, tokens of each document and all ids of one file; a damaged file raises."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    limit, size, packed = struct.unpack_from(HEAD, content, at)
    at += struct.calcsize(HEAD)
    code = Code(np.frombuffer(zlib.decompress(content[at : at + packed]), dtype=np.uint8), limit)
    if len(code.lengths) != size:
        raise ValueError("a table of code lengths is cut short")
    at += packed
    part, number, documents, blocks = struct.unpack_from(PLACE, content, at)
    at += struct.calcsize(PLACE)
    keys, null, sizes = (np.frombuffer(content, dtype, documents, at + shift) for dtype, shift in (("<i8", 0), ("u1", 8 * documents), ("<i8", 9 * documents)))
    at += 17 * documents
    shown, held = code.table()
    parts = []
    for _ in range(blocks):
        tokens, room, check = struct.unpack_from(BLOCK, content, at)
        offsets = np.frombuffer(content, "<u4", -(-tokens // STEP), at + struct.calcsize(BLOCK))
        at += struct.calcsize(BLOCK) + offsets.nbytes
        if zlib.crc32(memoryview(content)[at : at + room]) != check:
            raise ValueError("a block of token ids is damaged")
        parts.append(decode_block(np.frombuffer(content, np.uint8, room, at), offsets, tokens, shown, held, limit))
        at += room
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    if len(ids) != sizes.sum():
        raise ValueError("a file of token ids is cut short")
    return part, number, [None if missing else key for key, missing in zip(keys.tolist(), null.tolist(), strict=True)], sizes, ids


def id_bytes(path: str) -> int:
    """Bytes that hold any id of the tokenizer at ``path``: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def token_ids(documents: DataFrame, path: str, end_id: int = 2, width: int = 4) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (little-endian, ``width`` bytes each) of every whole text, ``end_id`` last; a null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.shared(path)
        for batch in gathered(batches, "text", ENCODED_BYTES):
            data, bounds = ended_ids(encoder, batch.column("text"), end_id)
            stored = pa.py_buffer(data.astype(f"<u{width}"))
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(width * bounds), stored])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), ids.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, width: int = 4) -> dict[int, int]:
    """Occurrences of each id over all of ``tokens``; as many numbers as the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                some = np.bincount(np.frombuffer(data.as_buffer(), dtype=f"<u{width}"))
                if len(some) > len(held):
                    held, some = some.astype(np.int64), held
                held[: len(some)] += some
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()
    return {row[0]: row[1] for row in rows}


def write_ids(tokens: DataFrame, folder: str, limit: int = LIMIT, file_tokens: int = FILE_TOKENS, width: int = 4) -> Code:
    """Write ``tokens`` (doc_id, ids of ``width`` bytes each) as files in ascending doc_id order, null first; returns the code.

    Equal ids follow each other by a hash of their tokens, so one doc_id of any number of rows is
    dealt over many files. A file holds about ``file_tokens`` tokens, or one longer document. Spark's
    text writer, whose commit survives lost tasks, puts each file down as one record.
    """
    counts = id_counts(tokens, width)
    table = np.zeros(max(counts, default=0) + 1, dtype=np.int64)
    for one, n in counts.items():
        table[one] = n
    limit = max(limit, int(max(len(counts) - 1, 1)).bit_length())
    if limit > MOST_LIMIT:
        raise ValueError(f"{len(counts)} ids need codes of more than {MOST_LIMIT} bits")
    code = Code(code_lengths(table, limit), limit)
    codes = code.codes()
    parts = min(MOST_PARTS, max(1, -(-sum(counts.values()) // file_tokens)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number = context.partitionId() if context else 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            sizes = np.array([len(one) for one in held], dtype=np.int64)
            made = encode_file(code, codes, part, number, doc_ids, sizes, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(data.as_py(), dtype=f"<u{width}")
                if held and size + len(ids) > file_tokens:
                    yield flushed()
                    number, doc_ids, held, size = number + 1, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield flushed()

    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    placed = tokens.withColumn("place", F.xxhash64("ids"))
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    # Bytes pass through a string column unchanged; each file ends with the writer's line end, which no reader looks at.
    files = ranged.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    return code


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the files in ``folder``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if kept, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if not len(content.as_buffer()):
                    continue
                part, number, doc_ids, sizes, ids = decode_file(content.as_py())
                starts, count = np.cumsum(sizes) - sizes, len(doc_ids)
                view = memoryview(ids).cast("B")
                cuts = list(zip((4 * starts).tolist(), (4 * (starts + sizes)).tolist(), strict=True))
                columns = [
                    pa.array(np.full(count, part)), pa.array(np.full(count, number)), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes),
                    pa.array([zlib.crc32(view[a:b]) for a, b in cuts], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([bytes(view[a:b]) for a, b in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "file", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    kinds = "part long, file long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    rows = cut_lineage(spark.read.format("binaryFile").load(folder).select("content").mapInArrow(decode, kinds))
    sizes = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("__size"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.select("part", "file", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    # One number for each of at most ``MOST_PARTS`` parts.
    line, upto = [], 0
    for part, size in sorted(sizes.groupBy("part").agg(F.sum("__size")).collect()):
        line.append((part, upto))
        upto += size
    bases = spark.createDataFrame(line, "part long, __base long")
    joined = spread_join(rows, inside.join(F.broadcast(bases), "part"), ["part", "file"])
    start = F.col("__base") + F.col("__before") + F.col("at")
    return joined.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def encoded_documents(documents: DataFrame, path: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenize ``documents`` (doc_id, text), write their ids as coded files and read these back.

    One row for each row of ``documents``: a null or empty text has ``end_id`` alone; repeated rows
    each have their own place. An empty table gives an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "ids")
    width = max(id_bytes(path), 2 if end_id < 1 << 16 else 4)
    write_ids(written(token_ids(documents, path, end_id, width), "token-ids"), folder, width=width)
    return read_ids(spark, folder)
