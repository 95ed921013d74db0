"""Splitting of texts by the byte-level BPE pattern, many texts at once, in array operations.

Equal to ``regex.findall(public_tokenizers.PATTERN, text)`` on each text. Letters, numbers, white space and the rest
form runs. A run of the first two or of the rest is a piece, with one plain space before it if there is one; of white
space before other characters the last one splits off; an apostrophe that stands alone at the start of a piece takes
``s t re ve m ll d`` from the letters that follow. Words are then numbered by Arrow's dictionary encoding.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_table: np.ndarray | None = None
#: Characters handled at once, which bounds the arrays' memory.
CHUNK_CHARS = 800_000
#: A place where a piece always begins: a plain space between letters.
_SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def _classes() -> np.ndarray:
    global _table
    if _table is None:
        import regex

        every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
        _table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for value, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            found = "".join(regex.findall(pattern, every))
            _table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return _table


def groups(texts: list[str], most: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters each (one text may be longer)."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((at, i))
            at, size = i, 0
        size += len(t)
    return [*out, (at, len(texts))] if at < len(texts) else out


def split(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """All pieces of all texts in order, and the number of pieces of each text."""
    raw = "".join(texts)
    if not raw:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    cp = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    cls = _classes()[cp]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    first = np.zeros(n + 1, bool)  # begins a text
    first[0] = True
    first[ends] = True
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    blank = cls == _SPACE
    start = run.copy()
    starts = np.flatnonzero(run)
    # Runs that white space of the same text precedes: its last character begins a piece, and if it is a plain space the run continues that piece.
    after = starts[(starts > 0) & ~first[starts] & ~blank[starts]]
    after = after[blank[after - 1]]
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    # Contractions.
    quote = starts[(cp[starts] == 0x27) & start[starts]]
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~first[quote + 1] & (cls[quote + 1] == _LETTER)]
    if len(quote):
        one = cp[quote + 1]
        inside = (quote + 2 < n) & ~run[np.minimum(quote + 2, n - 1)]  # a second letter of the same run
        two = np.where(inside, cp[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((quote[single], 1), (quote[double], 2)):
            start[hit + 1] = False
            start[hit[hit + 1 + size < n] + 1 + size] = True  # the rest of the letters, or what follows
        # What follows a contraction as white space or another run keeps its own rule.
        follow = np.concatenate([quote[single] + 2, quote[double] + 3])
        follow = follow[follow < n]
        follow = follow[run[follow] & ~blank[follow] & ~first[follow]]
        start[follow] = True
    at = np.flatnonzero(start)
    width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
    offset = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    bounds = np.append(offset[at], offset[n]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(raw.encode("utf-8", "surrogatepass")))
    edges = np.searchsorted(at, np.concatenate([[0], ends]))
    return pieces, np.diff(edges)


def portions(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """A text cut where a piece begins, into portions of about ``most`` characters (longer where there is no such place)."""
    out, at = [], 0
    while len(text) - at > most and (found := _SAFE.search(text, at + most)):
        out.append(text[at:found.start()])
        at = found.start()
    return [*out, text[at:]]


class HashedPieces:
    """Ids of pieces by a 128-bit hash of each, in arrays: a few dozen bytes a piece, where a dictionary takes some 200. Two levels, so that adding doesn't sort all."""

    def __init__(self):
        self.flat = np.zeros(0, np.uint32)
        self.levels = [self._level(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]

    @staticmethod
    def _level(keys: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(keys[:, 0], kind="stable")
        return keys[order, 0], keys[order, 1], begin[order], count[order]

    @property
    def bytes(self) -> int:
        return 4 * len(self.flat) + 28 * sum(len(level[0]) for level in self.levels)

    @staticmethod
    def keys(words: list[str]) -> np.ndarray:
        digest = xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(w.encode("utf-8", "surrogatepass")) for w in words]), np.uint64).reshape(-1, 2)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each key begin in ``flat``, and how many; -1 if it isn't known."""
        begin, count = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int32)
        for first, second, at, n in self.levels:
            if len(first):
                k = np.minimum(np.searchsorted(first, keys[:, 0]), len(first) - 1)
                hit = (first[k] == keys[:, 0]) & (second[k] == keys[:, 1])
                begin[hit], count[hit] = at[k[hit]], n[k[hit]]
        return begin, count

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = len(self.flat) + np.cumsum(count, dtype=np.int64) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum()))])
        joined = lambda level, x: self._level(np.concatenate([np.stack(level[:2], 1), x[0]]), np.concatenate([level[2], x[1]]), np.concatenate([level[3], x[2]]))
        large, small = self.levels[0], joined(self.levels[1], (keys, begin, count))
        if len(small[0]) > 20_000 + len(large[0]) // 8:
            large, small = joined(large, (np.stack(small[:2], 1), *small[2:])), self._level(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.levels = [large, small]

    def places(self, pieces: pa.StringArray, encode_words: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``flat``, and how many; unknown pieces are encoded."""
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        keys = self.keys(words)
        begin, count = self.find(keys)
        if len(new := np.flatnonzero(count < 0)):
            self.add(keys[new], encode_words([words[k] for k in new.tolist()]))
            begin, count = self.find(keys)
        where = coded.indices.to_numpy()
        return begin[where], count[where]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_NO_KEY = np.uint64(2**64 - 1)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, or a copy at least twice as long, with ``n`` places or more."""
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[:len(x)] = x
    return out


class PackedPieces:
    """The same by the pieces themselves: one of up to 15 bytes is two whole numbers, its bytes and their count, in an open hash table of arrays,
    so each occurrence is looked up without a Python object; longer ones are in a dictionary. Nothing rests on a hash alone."""

    SHORT = 15

    def __init__(self):
        self.flat = np.zeros(1024, np.uint32)
        # Entry 0 stands for an unknown piece: no piece has its key. The ids of entry k lie from at[k] to at[k + 1].
        self.low, self.high, self.at = np.full(512, _NO_KEY), np.full(512, _NO_KEY), np.zeros(513, np.int64)
        self.entries, self.slots = 1, np.zeros(1024, np.int32)
        self.long: dict[str, int] = {}
        self.long_bytes = 0

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.flat, self.low, self.high, self.at, self.slots)) + self.long_bytes

    @classmethod
    def _keys(cls, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two whole numbers for each piece, and which ones are short; the others have no key."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
        start, size = bounds[:-1], np.diff(bounds)
        padded = np.zeros(-(-(int(bounds[-1]) + 16) // 8) * 8 + 8, np.uint8)
        padded[:bounds[-1]] = np.frombuffer(pieces.buffers()[2], np.uint8, int(bounds[-1]))
        words = padded.view("<u8")

        def eight(at: np.ndarray) -> np.ndarray:
            k, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
            return (words[k] >> shift) | (words[k + 1] << np.uint64(1) << (np.uint64(63) - shift))

        low = eight(start) & _MASKS[np.minimum(size, 8)]
        high = size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(size > 8)
        high[more] |= eight(start[more] + 8) & _MASKS[np.minimum(size[more] - 8, 7)]
        short = size <= cls.SHORT
        low[~short] = high[~short] = _NO_KEY
        return low, high, short

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot where the search for each key begins."""
        x = low * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x += high * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, or 0."""
        at = self._first(low, high)
        entry = self.slots[at]
        left = np.flatnonzero((entry != 0) & ((self.low[entry] != low) | (self.high[entry] != high)))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.slots) - 1)
            entry[left] = e = self.slots[at]
            on = (e != 0) & ((self.low[e] != low[left]) | (self.high[e] != high[left]))
            left, at = left[on], at[on]
        return entry

    def _place(self, entry: np.ndarray) -> None:
        """Give each of these entries a slot."""
        at = self._first(self.low[entry], self.high[entry])
        while len(entry):
            free = self.slots[at] == 0
            self.slots[at[free]] = entry[free]
            on = self.slots[at] != entry
            entry, at = entry[on], (at[on] + 1) & (len(self.slots) - 1)

    def _add(self, low: np.ndarray, high: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """New entries with these keys and ids; those without a key get no slot."""
        n, begin = self.entries + len(ids), int(self.at[self.entries])
        ends = begin + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        entry = np.arange(self.entries, n, dtype=np.int32)
        self.low, self.high, self.at, self.flat = _room(self.low, n), _room(self.high, n), _room(self.at, n + 1), _room(self.flat, int(ends[-1]))
        self.low[entry], self.high[entry], self.at[entry + 1] = low, high, ends
        self.flat[begin:ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - begin)
        self.entries = n
        if 2 * n > len(self.slots):
            self.slots = np.zeros(2 << (2 * n).bit_length(), np.int32)
            self._place(np.flatnonzero(self.high[:n] != _NO_KEY).astype(np.int32))
        else:
            self._place(entry[high != _NO_KEY])
        return entry

    def places(self, pieces: pa.StringArray, encode_words: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in ``flat``, and how many; unknown pieces are encoded."""
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high, _ = self._keys(pieces)
        entry = self._find(low, high)
        if len(missing := np.flatnonzero(entry == 0)):
            coded = pieces.take(pa.array(missing)).dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            low, high, short = self._keys(coded.dictionary)
            found = np.zeros(len(words), np.int32)
            for k in np.flatnonzero(~short).tolist():
                found[k] = self.long.get(words[k], 0)
            if len(new := np.flatnonzero(found == 0)):
                found[new] = self._add(low[new], high[new], encode_words([words[k] for k in new.tolist()]))
                for k in new[~short[new]].tolist():
                    self.long[words[k]] = int(found[k])
                    self.long_bytes += 180 + 4 * len(words[k])
            entry[missing] = found[coded.indices.to_numpy()]
        begin = self.at[entry]
        return begin, self.at[entry + 1] - begin


class Encoder:
    """Token ids of many texts: distinct pieces are encoded once by ``encode_words`` and kept until they take ``limit`` bytes, then all anew."""

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], limit: int = 32_000_000, chars: int = CHUNK_CHARS, pieces: type = HashedPieces):
        self.encode_words, self.limit, self.chars, self.pieces, self.known = encode_words, limit, chars, pieces, pieces()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [portions(t, self.chars) for t in texts]
        flat = self._encoded([p for some in parts for p in some])
        if len(flat) == len(texts):
            return flat
        out, at = [], 0
        for some in parts:
            out.append(np.concatenate(flat[at:at + len(some)]) if len(some) > 1 else flat[at])
            at += len(some)
        return out

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as views of one array per group of texts."""
        out: list[np.ndarray] = []
        for a, b in groups(texts, self.chars):
            pieces, per_text = split(texts[a:b])
            if self.known.bytes > self.limit:
                self.known = self.pieces()
            begin, count = self.known.places(pieces, self.encode_words)
            total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            source = np.repeat(begin - total[:-1], count) + np.arange(total[-1])
            ids = self.known.flat[source]
            cuts = total[np.concatenate([[0], np.cumsum(per_text)])]
            out += [ids[cuts[k]:cuts[k + 1]] for k in range(b - a)]
        return out
