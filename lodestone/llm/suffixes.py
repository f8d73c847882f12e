"""Removal of repeated passages by longest-previous-factor arrays.

A passage of ``LENGTH`` bytes that also starts in an earlier document is removed, the first copy
stays. Passages meet without shuffling a suffix per byte: each window of ``LENGTH`` bytes goes where
the smallest hash of its ``SEED``-byte substrings sends it, so equal windows meet, and neighbouring
windows travel as one segment. Equal segments are first reduced to their smallest document, within a
group of documents and then over all; the distinct segments of a meeting place are suffix-sorted, and
previous and next smaller documents in suffix order give each window's longest earlier match.
Windows of a seed with very many segments go on by their own hash, each as a segment, so that no seed
stands in one task.

Documents lie in groups that are dealt once; what comes back to a group is a list of segments, not
documents. All steps are one plan over shuffles, so a lost executor costs recomputing its part only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
SEED = 20
WINDOW = LENGTH - SEED + 1
GROUP_BYTES = 6_000_000
MOST_GROUPS = 32_768
# Segments of one seed that a task compares; the windows of a seed with more are dealt by their own hash.
HOT_SEGMENTS = 40_000
# Windows that are sorted and compared at once; only windows of one seed can be equal, so seeds are taken together up to this.
COMPARED_WINDOWS = 200_000
CHUNK_BYTES = 1_000_000
LAST = 2**63 - 1
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


class Segments:
    """All segments of some texts: ``seed`` and ``name`` hashes, ``text`` index, ``start`` byte and number of ``windows``."""

    def __init__(self, texts: list[bytes], hot: np.ndarray | None = None) -> None:
        """``hot``: seeds whose windows are segments of their own."""
        self._hot = hot if hot is not None and len(hot) else None
        found = []
        at = 0
        self._powers = [np.ones(1, np.uint64)] * 4
        with np.errstate(over="ignore"):
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
                    held += len(texts[end])
                    end += 1
                found.append(self._chunk(texts[at:end], at))
                at = end
        # The tables of powers take 32 bytes for each byte of a chunk; nothing after this needs them.
        del self._powers
        parts = list(zip(*found, strict=True)) if found else [[]] * 5
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
        self.seed, self.name, self.text, self.start, self.windows = (
            np.concatenate([*part, np.zeros(0, kind)]).astype(kind, copy=False) for part, kind in zip(parts, kinds, strict=True)
        )

    def _power(self, size: int) -> list[np.ndarray]:
        if len(self._powers[0]) < size:
            factors = [_BASES[0], np.uint64(pow(int(_BASES[0]), -1, 1 << 64)), _BASES[1], np.uint64(pow(int(_BASES[1]), -1, 1 << 64))]
            self._powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, factor)])) for factor in factors]
        return self._powers

    def _chunk(self, texts: list[bytes], offset: int) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(text) for text in texts], dtype=np.int64)
        long = np.flatnonzero(sizes >= LENGTH)
        data = np.frombuffer(b"".join([texts[i] for i in long]), dtype=np.uint8)
        if not len(data):
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        up, down, up_name, down_name = (power[: len(data)] for power in self._power(len(data)))
        letters = data.astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up)])
        least = _mix((sums[SEED:] - sums[:-SEED]) * down[: len(data) - SEED + 1])
        reach = 1
        while reach * 2 <= WINDOW:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < WINDOW:
            least = np.minimum(least[: len(least) - (WINDOW - reach)], least[WINDOW - reach :])
        # ``least`` has a window at every byte; those over the end of a text are no windows.
        ends = np.cumsum(sizes[long])
        begins = ends - sizes[long]
        cut = np.zeros(len(least) + 1, dtype=bool)
        cut[1:-1] = least[1:] != least[:-1]
        cut[begins] = True
        over = np.minimum(ends - LENGTH + 1, len(least))
        cut[over] = True
        starts = np.flatnonzero(cut[:-1])
        stops = np.append(starts[1:], len(least))
        # Runs of one hash, as in periodic text, are cut every ``WINDOW`` windows.
        pieces = -(-(stops - starts) // WINDOW)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(starts, pieces) + nth * WINDOW
            stops = np.minimum(starts + WINDOW, np.repeat(stops, pieces))
        owner = np.searchsorted(ends, starts, side="right")
        inside = starts + LENGTH <= ends[owner]
        starts, stops, owner = starts[inside], stops[inside], owner[inside]
        seeds = least[starts]
        if self._hot is not None and (split := np.isin(seeds, self._hot)).any():
            sizes_in = stops[split] - starts[split]
            single = np.repeat(starts[split] - np.cumsum(sizes_in) + sizes_in, sizes_in) + np.arange(sizes_in.sum())
            own = _mix(((sums[single + LENGTH] - sums[single]) * down[single]) ^ _MIX[0])
            starts, stops = np.concatenate([starts[~split], single]), np.concatenate([stops[~split], single + 1])
            owner, seeds = np.concatenate([owner[~split], np.repeat(owner[split], sizes_in)]), np.concatenate([seeds[~split], own])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up_name)])
        windows = stops - starts
        names = _mix(((sums[stops + LENGTH - 1] - sums[starts]) * down_name[starts]) ^ (windows.astype(np.uint64) * _MIX[1]))
        return seeds, names, long[owner] + offset, starts - begins[owner], windows


def _planes(values: np.ndarray) -> bytes:
    """Bytes of 64-bit values, all lowest bytes first, so that constant bytes compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def _first_of(seed: np.ndarray, name: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by segment and document, and where each distinct segment begins."""
    order = np.lexsort((doc, name, seed))
    seed, name, doc = seed[order], name[order], doc[order]
    fresh = np.ones(len(seed), dtype=bool)
    fresh[1:] = (seed[1:] != seed[:-1]) | (name[1:] != name[:-1])
    return seed, name, doc, fresh, *[column[order] for column in more]


def _found(keys: tuple[np.ndarray, np.ndarray], names: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Place of each (name, seed) in ``keys``, which are sorted by name; -1 where there is none."""
    if not len(keys[0]):
        return np.full(len(names), -1)
    place = np.minimum(np.searchsorted(keys[0], names), len(keys[0]) - 1)
    return np.where((keys[0][place] == names) & (keys[1][place] == seeds), place, -1)


def previous_factors(windows: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Length of the longest match of each window with one of a smaller document, 0 if under ``least``.

    ``windows`` is a matrix of bytes. Rows are taken in suffix order with the common prefixes of
    neighbours; a row's nearest smaller documents before and after it in that order, and the least
    prefix on the way there, give its longest previous factor.
    """
    count, width = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width}").reshape(-1), kind="stable")
    ranked = windows[order]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    # Between neighbours with a shorter prefix no match of ``least`` reaches across.
    near = common >= least
    inside = np.flatnonzero(np.append(near, False) | np.insert(near, 0, False))
    longest = np.zeros(count, dtype=np.int64)
    docs = doc[order]
    for ahead in (True, False):
        places = inside.tolist() if ahead else inside[::-1].tolist()
        stack: list[tuple[int, int]] = []  # smaller documents, each with the least prefix to the one below
        for at in places:
            shared = int(common[at - 1 if ahead else at]) if (at > 0 if ahead else at < count - 1) else 0
            if shared < least:
                stack.clear()
            mine = int(docs[at])
            while stack and stack[-1][0] >= mine:
                shared = min(shared, stack.pop()[1])
            if stack:
                longest[at] = max(longest[at], shared)
            stack.append((mine, shared if stack else 0))
    result = np.empty(count, dtype=np.int64)
    result[order] = longest
    return result


def seed_blocks(seeds: np.ndarray, sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of sorted ``seeds``, each of whole seeds, with about ``most`` windows or those of one seed; ``sizes`` counts the windows of each entry."""
    edges = np.append(np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1])), len(seeds))
    held = np.append(0, np.cumsum(sizes))
    begin = 0
    for edge, after in zip(edges[1:], [*edges[2:], None], strict=True):
        if after is None or held[after] - held[begin] > (COMPARED_WINDOWS if most is None else most):
            yield begin, int(edge)
            begin = int(edge)


def repeated(cut: list[bytes], size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each of the ``size`` windows of every piece of ``cut``: whether a smaller document has it as well."""
    data = np.frombuffer(b"".join(cut), np.uint8)
    begins = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    starts = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts]
    return previous_factors(windows, np.repeat(docs, size), LENGTH) >= LENGTH


def dealt(documents: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """__g, __doc (null keys last), __data and all columns in __rest; rows of one key, or of none, lie in many groups."""
    return documents.select(
        F.pmod(F.xxhash64(key, text), F.lit(groups)).cast("int").alias("__g"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__doc"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__data"), F.struct(*documents.columns).alias("__rest"),
    )


def hot_seeds(documents: DataFrame, text: str, pieces: int, most: int) -> np.ndarray:
    """All seeds with more than ``most`` segments, and some with more than half of it; at most twice the segments over ``most``.

    The texts are read in no more than ``pieces`` pieces. What a piece has less of than its half share
    of ``most`` is not told, which leaves out less than half of any seed's segments over ``most``.
    """
    least = max(1, most // (2 * pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(texts: list[bytes]) -> pa.RecordBatch:
            found = Segments(texts)
            order = np.lexsort((found.name, found.seed))
            seed, name = found.seed[order], found.name[order]
            fresh = np.append(True, (seed[1:] != seed[:-1]) | (name[1:] != name[:-1]))[: len(seed)]
            seed, n = np.unique(seed[fresh], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seed[n >= least].view(np.int64)), pa.array(n[n >= least].astype(np.int64))], names=["seed", "n"])

        held, size = [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(data)
                size += len(data)
                if size >= GROUP_BYTES:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    told = documents.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("data")).mapInArrow(count, "seed long, n long")
    found = told.groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") > most / 2).select("seed").collect()
    return np.sort(np.array([row["seed"] for row in found], dtype=np.int64).view(np.uint64))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, kept_text: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Columns ``keep`` (default: ``key``) of every row with n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` if ``kept_text``.

    Each byte covered by a 50-byte string that also starts in a row with a smaller ``key`` is
    removed; strings are judged on the input. Matches do not cross rows. A null text is empty; a
    null key is greater than all others, and rows of one key remove nothing from each other. Texts
    under 50 bytes stay whole. ``kept`` is what is left as text, without characters cut in part.
    """
    documents = documents.select(*dict.fromkeys([*(keep or [key]), key, text]))
    sizes = documents.select(F.octet_length(text).alias("__size"), F.spark_partition_id().alias("__part"))
    volume, last = sizes.agg(F.sum("__size"), F.max("__part")).first()
    hot = hot_seeds(documents, text, (volume or 0) // GROUP_BYTES + (last or 0) + 1, hot_segments)
    groups = min(MOST_GROUPS, max(8, -(-(volume or 0) // GROUP_BYTES)))
    # The text need not travel twice.
    named = [name for name in (keep or [key]) if name != text]
    base = dealt(documents, key, text, groups)
    base = base.withColumn("__rest", F.struct(*[F.col(f"__rest.{name}").alias(name) for name in named]))

    def local(table: pa.Table) -> tuple[list[bytes], np.ndarray, Segments]:
        texts = table.column("__data").to_pylist()
        return texts, table.column("__doc").to_numpy(), Segments(texts, hot)

    def offer(table: pa.Table) -> pa.Table:
        _, docs, found = local(table)
        seed, name, doc, fresh = _first_of(found.seed, found.name, docs[found.text])
        seed, name, doc = seed[fresh], name[fresh], doc[fresh]
        bucket = (seed >> np.uint64(33)) % np.uint64(groups)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(groups + 1, dtype=np.uint64))
        kept = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(groups) if cuts[b] < cuts[b + 1]]
        return pa.table({
            "bucket": pa.array([b for b, _ in kept], pa.int32()), "g": pa.array([table.column("__g")[0].as_py()] * len(kept), pa.int32()),
            "seeds": pa.array([_planes(seed[at]) for _, at in kept], pa.binary()), "names": pa.array([_planes(name[at]) for _, at in kept], pa.binary()),
            "docs": pa.array([_planes(doc[at]) for _, at in kept], pa.binary()),
        })

    def meet(asked: bool):
        def answer(table: pa.Table) -> pa.Table:
            columns = [[_unplaned(data) for data in table.column(name).to_pylist()] for name in ("seeds", "names", "docs")]
            holder = np.repeat(table.column("g").to_numpy(), [len(part) for part in columns[0]])
            seed, name, doc = (np.concatenate(parts) for parts in columns)
            seed, name, doc, fresh, holder = _first_of(seed, name, doc.astype(np.int64), holder)
            first = np.flatnonzero(fresh)
            least = np.repeat(doc[first], np.diff(first, append=len(doc)))
            if asked:
                # Places with several segments of several documents have to be compared by their bytes.
                edge = np.flatnonzero(np.append(True, seed[first][1:] != seed[first][:-1]))
                sizes = np.diff(edge, append=len(first))
                mixed = np.minimum.reduceat(doc[first], edge) != np.maximum.reduceat(doc[first], edge)
                kept = first[np.repeat((sizes > 1) & mixed, sizes)]
            else:
                kept = np.flatnonzero(doc > least)
            order = kept[np.lexsort((name[kept], holder[kept]))]
            targets, cuts = np.unique(holder[order], return_index=True)
            parts = np.split(order, cuts[1:]) if len(order) else []
            return pa.table({
                "g": pa.array(targets, pa.int32()), "names": pa.array([_planes(name[part]) for part in parts], pa.binary()),
                "seeds": pa.array([_planes(seed[part]) for part in parts], pa.binary()), "flags": pa.array([None] * len(parts), pa.binary()),
            })

        return answer

    def listed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        names = np.concatenate([np.zeros(0, np.uint64), *[_unplaned(data) for data in table.column("names").to_pylist()]])
        seeds = np.concatenate([np.zeros(0, np.uint64), *[_unplaned(data) for data in table.column("seeds").to_pylist()]])
        order = np.argsort(names, kind="stable")
        return names[order], seeds[order]

    def send(table: pa.Table, asked: pa.Table) -> pa.Table:
        texts, docs, found = local(table)
        at = np.flatnonzero(_found(listed(asked), found.name, found.seed) >= 0)
        place = at[np.lexsort((docs[found.text[at]], found.name[at], found.seed[at]))]
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = (found.seed[place][1:] != found.seed[place][:-1]) | (found.name[place][1:] != found.name[place][:-1])
        place = place[fresh]
        cut = [texts[found.text[i]][found.start[i] : found.start[i] + found.windows[i] + LENGTH - 1] for i in place]
        return pa.table({
            "bucket": pa.array(((found.seed[place] >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)),
            "g": pa.array(np.full(len(place), table.column("__g")[0].as_py() if table.num_rows else 0, np.int32)),
            "name": pa.array(found.name[place].view(np.int64)), "seed": pa.array(found.seed[place].view(np.int64)),
            "doc": pa.array(docs[found.text[place]]), "data": pa.array(cut, pa.binary()),
        })

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("seed")))
        cut = table.column("data").to_pylist()
        size = np.array([len(data) - LENGTH + 1 for data in cut])
        first = np.cumsum(size) - size
        docs, own = table.column("doc").to_numpy(), table.column("seed").to_numpy()
        flagged = np.zeros(int(size.sum()), np.uint8)
        for begin, end in seed_blocks(own, size):
            flagged[first[begin] : first[end - 1] + size[end - 1]] = repeated(cut[begin:end], size[begin:end], docs[begin:end])
        hit = np.flatnonzero(np.add.reduceat(flagged, first, dtype=np.int64))
        g = table.column("g").to_numpy()
        names, seeds = (table.column(column).to_numpy().view(np.uint64) for column in ("name", "seed"))
        targets = np.unique(g[hit])
        parts = [hit[g[hit] == target] for target in targets]
        return pa.table({
            "g": pa.array(targets, pa.int32()), "names": pa.array([_planes(names[part]) for part in parts], pa.binary()),
            "seeds": pa.array([_planes(seeds[part]) for part in parts], pa.binary()),
            # The number of windows of each segment, then a byte for each window.
            "flags": pa.array([
                size[part].astype("<u2").tobytes() + b"".join(flagged[first[i] : first[i] + size[i]].tobytes() for i in part) for part in parts
            ], pa.binary()),
        })

    def remove(table: pa.Table, news: pa.Table) -> pa.Table:
        texts, docs, found = local(table)
        marked = np.asarray(news.column("flags").is_valid())
        whole = listed(news.filter(pa.array(~marked)))
        doc = docs[found.text]
        # Segments that the group itself has in an earlier document, and those that another group has.
        order = np.lexsort((doc, found.name, found.seed))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (found.seed[order][1:] != found.seed[order][:-1]) | (found.name[order][1:] != found.name[order][:-1])
        first = np.flatnonzero(fresh)
        later = np.empty(len(order), dtype=bool)
        later[order] = doc[order] > np.repeat(doc[order][first], np.diff(first, append=len(order)))
        gone = later | (_found(whole, found.name, found.seed) >= 0)
        partly: dict[tuple[int, int], np.ndarray] = {}
        with_flags = news.filter(pa.array(marked))
        for names, seeds, flags in zip(*(with_flags.column(column).to_pylist() for column in ("names", "seeds", "flags")), strict=True):
            keys = list(zip(_unplaned(names).tolist(), _unplaned(seeds).tolist(), strict=True))
            sizes = np.frombuffer(flags, "<u2", count=len(keys)).astype(np.int64)
            partly |= zip(keys, np.split(np.frombuffer(flags, np.uint8, offset=2 * len(keys)), np.cumsum(sizes)[:-1]), strict=True)
        # Removed bytes of all texts in one line, with a byte between texts that is never removed.
        sizes = np.array([len(data) for data in texts], dtype=np.int64)
        bases = np.cumsum(sizes + 1) - sizes - 1
        at = bases[found.text] + found.start
        opens, closes = [at[gone]], [at[gone] + found.windows[gone] + LENGTH - 1]
        if partly:
            for i in np.flatnonzero(~gone & np.isin(found.name, np.array([name for name, _ in partly], dtype=np.uint64))):
                flags = partly.get((int(found.name[i]), int(found.seed[i])))
                if flags is not None:
                    hits = at[i] + np.flatnonzero(flags)
                    opens.append(hits)
                    closes.append(hits + LENGTH)
        total = int((sizes + 1).sum())
        change = np.zeros(total + 1, dtype=np.int32)
        np.add.at(change, np.concatenate(opens), np.int32(1))
        np.subtract.at(change, np.concatenate(closes), np.int32(1))
        removed = np.cumsum(change, dtype=np.int32, out=change)[:total] > 0
        edges = np.flatnonzero(removed[1:] > removed[:-1]) + 1 if total else np.zeros(0, np.int64)
        edges = np.append(0, edges) if total and removed[0] else edges
        n_removed = np.array([np.count_nonzero(removed[base : base + size]) for base, size in zip(bases, sizes, strict=True)], dtype=np.int64)
        n_spans = np.searchsorted(edges, bases + sizes) - np.searchsorted(edges, bases)
        left = [
            np.frombuffer(data, np.uint8)[~removed[base : base + len(data)]].tobytes() if n else data
            for data, base, n in zip(texts, bases, n_removed, strict=True)
        ]
        rest = table.column("__rest").combine_chunks()
        columns = {name: rest.field(name) for name in named} | {
            "n_bytes": pa.array(sizes), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans),
            "kept_sha256": pa.array([hashlib.sha256(data).hexdigest() for data in left]),
        }
        if kept_text:
            columns["kept"] = pa.array([data.decode("utf-8", errors="ignore") for data in left])
        return pa.table(columns)

    answer = "g int, names binary, seeds binary, flags binary"
    offers = base.groupBy("__g").applyInArrow(offer, "bucket int, g int, seeds binary, names binary, docs binary").groupBy("bucket")
    asked = offers.applyInArrow(meet(True), answer)
    segments = base.groupBy("__g").cogroup(asked.groupBy("g")).applyInArrow(send, "bucket int, g int, name long, seed long, doc long, data binary")
    news = offers.applyInArrow(meet(False), answer).unionByName(segments.groupBy("bucket").applyInArrow(compare, answer))
    fields = ", ".join(f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in named)
    fields += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if kept_text else "")
    return base.groupBy("__g").cogroup(news.groupBy("g")).applyInArrow(remove, fields)
