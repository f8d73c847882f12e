"""Token ids of whole texts: distinct words are cut and merged together, a batch at a time."""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words of these characters are cut as the tokenizer's own pattern does, piece by piece.
CUTTABLE = "^[!-~à-öø-ÿ]+$"
PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^a-zà-öø-ÿ0-9]+)"
# Separators to Arrow, but not white space to the tokenizer.
SEPARATORS = "[\x1c-\x1f]"
# A longer piece goes through the tokenizer's model alone.
LONG_BYTES = 64
CACHE_WORDS = 200_000
NEVER = np.int64(2**62)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [byte for byte in range(256) if 33 <= byte <= 126 or 161 <= byte <= 255 and byte != 173]
    spare = iter(range(256, 512))
    return [chr(byte) if byte in set(shown) else chr(next(spare)) for byte in range(256)]


def picked(starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the segments ``place``, in order, and the bounds of each segment among them."""
    held = sizes[place]
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])
    return np.repeat(starts[place] - upto[:-1], held) + np.arange(upto[-1]), upto


class Merges:
    """The merge ranks of a byte-level vocabulary, applied to many short pieces at once."""

    def __init__(self, tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.inner = np.array([vocabulary.get(letter, 0) for letter in letters], dtype=np.int64)
        self.last = np.array([vocabulary.get(letter + suffix, 0) for letter in letters], dtype=np.int64)
        merges = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in merges], dtype=np.uint64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, 2**64 - 1, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.keys[slot] != 2**64 - 1:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NEVER`` for one that does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots, found = self._slots(keys), np.full(len(keys), NEVER)
        rows = np.arange(len(keys))
        while len(rows):
            there = self.keys[slots]
            same = there == keys
            found[rows[same]] = self.ranks[slots[same]]
            more = ~same & (there != np.uint64(2**64 - 1))
            rows, keys, slots = rows[more], keys[more], (slots[more] + 1) & (len(self.keys) - 1)
        return found

    def __call__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty pieces, given as bytes one after another, and how many each has.

        In every round each piece merges its leftmost pair of lowest rank; pieces without one are done.
        """
        symbols = self.inner[data]
        symbols[starts + sizes - 1] = self.last[data[starts + sizes - 1]]
        ranks = np.full(len(symbols), NEVER)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[starts + sizes - 1] = NEVER
        who, done = np.arange(len(starts)), []
        while len(who):
            best = np.minimum.reduceat(np.where(ranks == NEVER, NEVER, (ranks << 32) | np.arange(len(ranks))), starts)
            open_ = best != NEVER
            if not open_.all():
                stay = np.repeat(open_, sizes)
                done.append((who[~open_], sizes[~open_], symbols[~stay]))
                moved = np.cumsum(np.where(open_, 0, sizes))
                # Places shift by what was taken out before them.
                best, moved = best[open_], moved[open_]
                symbols, ranks, who, sizes = symbols[stay], ranks[stay], who[open_], sizes[open_]
                starts = np.cumsum(sizes) - sizes
                at = (best & np.int64(0xFFFFFFFF)) - moved
            else:
                at = best & np.int64(0xFFFFFFFF)
            if not len(who):
                break
            symbols[at] = self.made[best >> 32]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            ranks[at] = ranks[at + 1]
            symbols, ranks = symbols[keep], ranks[keep]
            nth = np.arange(len(who))
            at, starts, sizes = at - nth, starts - nth, sizes - 1
            ends = starts + sizes - 1
            right = at[at < ends]
            ranks[right] = self.rank(symbols[right], symbols[right + 1])
            left = at[at > starts] - 1
            ranks[left] = self.rank(symbols[left], symbols[left + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, held, symbols = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(who)
        places, _ = picked(np.cumsum(held) - held, held, order)
        return symbols[places], held[order]


class WordIds:
    """Ids of texts, equal to ``encode(text, add_special_tokens=False)`` of the tokenizer at ``path``.

    Distinct words of white-space-separated text are cut into pieces and merged by the tokenizer's
    own merge ranks, all at once. Words of other alphabets, long pieces, texts with a ``<|`` mark,
    which may be a special token, and texts with a separator character that only one side takes
    for white space go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(self.tokenizer)
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """One encoder a Python worker process."""
        import tokenizers

        encoders = sys.modules[tokenizers.__name__].__dict__.setdefault("_word_ids", {})
        if path not in encoders:
            encoders[path] = cls(path)
        return encoders[path]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` by the tokenizer, kept in a bounded cache."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        made = []
        for word in words:
            if (ids := self.cache.get(word)) is None:
                ids = self._whole(word)
                if len(word) <= LONG_BYTES:
                    self.cache[word] = ids
            made.append(ids)
        return np.concatenate(made) if made else np.zeros(0, np.int64), np.array([len(ids) for ids in made], dtype=np.int64)

    def _segments(self, items: pa.Array, plain: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and sizes for all ``items``: those marked ``plain`` are given, the rest go through the tokenizer."""
        rest = np.flatnonzero(~plain)
        listed, listed_sizes = self._listed(items.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist())
        all_sizes = np.zeros(len(items), np.int64)
        all_sizes[plain], all_sizes[rest] = sizes, listed_sizes
        starts = np.zeros(len(items), np.int64)
        starts[plain] = np.cumsum(sizes) - sizes
        starts[rest] = np.cumsum(listed_sizes) - listed_sizes + len(ids)
        return np.concatenate([ids, listed]), starts, all_sizes

    def _word_segments(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = pc.utf8_lower(words)
        cuttable = pc.match_substring_regex(low, CUTTABLE).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring_regex(low.filter(pa.array(cuttable)), PIECES, "\\1 "), " ")
        coded = cut.flatten().dictionary_encode()
        pieces, place = coded.dictionary, coded.indices.to_numpy()
        sizes = pc.binary_length(pieces).to_numpy()
        short = (sizes > 0) & (sizes <= LONG_BYTES)
        some = pieces.filter(pa.array(short))
        offsets = np.frombuffer(some.buffers()[1], dtype=np.int64)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(some) else np.zeros(0, np.uint8)
        merged, counts = self.merges(data, offsets[:-1] - offsets[0], np.diff(offsets)) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, starts, held = self._segments(pieces, short, merged, counts)
        places, upto = picked(starts, held, place)
        bounds = upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return self._segments(words, cuttable, ids[places], np.diff(bounds))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (strings, null: empty) one after another, and the bounds of each text's ids among them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, SEPARATORS))
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.flatten().dictionary_encode()
        ids, starts, sizes = self._word_segments(coded.dictionary)
        places, upto = picked(starts, sizes, coded.indices.to_numpy())
        ids = ids[places].astype("<u4")
        bounds = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if not pc.any(odd).as_py():
            return ids, bounds
        parts = np.split(ids, bounds[1:-1])
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            parts[row] = self._whole(texts[int(row)].as_py()).astype("<u4")
        return np.concatenate(parts), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(part) for part in parts])])

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].tobytes()


def ended_ids(encoder: WordIds, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ``texts`` with ``end_id`` after each, and the bounds of each text's ids among them."""
    ids, bounds = encoder.batch(texts)
    whole = np.full(len(ids) + len(texts), end_id, dtype="<u4")
    inside = np.ones(len(whole), dtype=bool)
    ends = bounds[1:] + np.arange(len(texts))
    inside[ends] = False
    whole[inside] = ids
    return whole, np.concatenate([np.zeros(1, np.int64), ends + 1])
