"""The terms of ``text.terms`` and their postings, over Arrow batches.

The rules tell ASCII letters and digits from all else, so they work on bytes, and by array operations on all words at once. Only words
with an ampersand are cleaned one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import OUT_ROWS
from .text import ENTITY_MARKS, MAX_WORD_BYTES

#: Bytes of text that are split at once, and tokens that are sorted at once; one text may be longer.
GROUP_BYTES, RUN_TOKENS = 2 << 20, 1 << 20
FIELDS = pa.array(["body", "title"])
_MARKS = tuple(m.encode() for m in ENTITY_MARKS)
_EDGES = re.compile(rb"\A[^A-Za-z0-9]+|[^A-Za-z0-9]+\Z")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BLANK, _DROPPED = _class(b" \t\r\n"), _class(b"'-")
_ALNUM = _class(bytes(c for c in range(128) if chr(c).isalnum()))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def clean_word(word: bytes) -> bytes:
    """A word as it is when entities and both ends are gone; empty if it is dropped."""
    word = word.replace(b"&#039;", b"")
    if len(word) > MAX_WORD_BYTES or any(m in word for m in _MARKS):
        return b""
    return _EDGES.sub(b"", word.replace(b"'", b""))


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64) if len(a) else np.zeros(1, np.int64)


def sizes(a: pa.Array) -> np.ndarray:
    """Bytes of each string, or elements of each list."""
    return np.diff(_offsets(a))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, and their offsets."""
    at = _offsets(a)
    n = int(at[-1] - at[0])
    return np.frombuffer(a.buffers()[2], np.uint8, n, int(at[0])) if n else np.zeros(0, np.uint8), at - at[0]


def _terms(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> pa.Array:
    """Per text, which are the bytes between two of ``at``, the list of terms of its words, which are the bytes from ``begin`` to ``end``."""
    marked = np.concatenate(([0], np.cumsum(data == ord("&"), dtype=np.int32)))
    odd = np.flatnonzero(marked[end] > marked[begin])
    if len(odd):
        data, end = data.copy(), end.copy()
        for k in odd.tolist():
            b, e = int(begin[k]), int(end[k])
            word = clean_word(data[b:e].tobytes())
            end[k] = b + len(word)
            data[b:b + len(word)] = np.frombuffer(word, np.uint8)
    alnum = _ALNUM[data]
    behind, places = np.concatenate(([0], np.cumsum(alnum, dtype=np.int32))), np.flatnonzero(alnum)
    low, high = behind[begin], behind[end]
    good = (high > low) & (end - begin <= MAX_WORD_BYTES)
    first, last = places[low[good]], places[high[good] - 1] + 1
    steps = np.zeros(len(data) + 1, np.int8)
    steps[first] += 1
    steps[last] -= 1
    within = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    parts = within & (data == ord("-"))
    parts[first] = True
    kept = np.flatnonzero(within & ~_DROPPED[data])
    part = np.cumsum(parts, dtype=np.int32)[kept]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
    values = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(kept)).astype(np.int32)), pa.py_buffer(_LOWER[data[kept]])])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(kept[starts], at), pa.int32()), values)


def terms_of_texts(texts: pa.Array) -> pa.Array:
    """The list of terms of each text."""
    data, at = _bytes(texts)
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = ~_BLANK[data]
    begins, ends = ink[1:] & ~ink[:-1], ink[:-1] & ~ink[1:]
    cuts = at[1:-1]
    cuts = cuts[ink[cuts] & ink[cuts + 1]]  # two texts meet within a run of such bytes
    begins[cuts] = ends[cuts] = True
    return _terms(data, np.flatnonzero(begins), np.flatnonzero(ends), at)


def terms_of_words(lists: pa.Array) -> pa.Array:
    """The same of lists of raw words."""
    at = _offsets(lists)
    data, ends = _bytes(lists.values.slice(int(at[0]), int(at[-1] - at[0])))
    return _terms(data, ends[:-1], ends[1:], ends[at - at[0]])


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of items that are ``most`` together, or one item."""
    behind, start = np.concatenate(([0], np.cumsum(sizes))), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(behind, behind[start] + most, "right")) - 1)
        yield start, stop
        start = stop


def _run(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of documents, in the order of chunk, term, field and document."""
    docs = docs.take(pc.sort_indices(docs.select(["chunk", "doc_idx"]), sort_keys=[("chunk", "ascending"), ("doc_idx", "ascending")], null_placement="at_start")).combine_chunks()
    column = lambda name: docs.column(name).combine_chunks()
    length = lambda name: pc.list_value_length(column(name)).to_numpy().astype(np.int64)
    titles, bodies = length("title_terms"), length("body_terms")
    n_titles, n = int(titles.sum()), int(titles.sum() + bodies.sum())
    if not n:
        return
    coded = pa.concat_arrays([column("title_terms").flatten(), column("body_terms").flatten()]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = np.arange(len(docs))
    doc = np.concatenate([np.repeat(number, titles), np.repeat(number, bodies)])
    inside = lambda sizes, start: np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
    pos = np.concatenate([inside(titles, 1), inside(bodies, titles + 1)]).astype(np.int32)
    body = np.arange(n) >= n_titles
    chunk = column("chunk").dictionary_encode("encode").indices.to_numpy().astype(np.int64)  # the documents are in its order
    key = ((chunk[doc] * len(rank)) + rank[coded.indices.to_numpy()]) * 2 + ~body
    low = n.bit_length()
    if int(key.max()).bit_length() + low < 63:
        by = np.sort(key << low | np.arange(n)) & ((1 << low) - 1)
    else:
        by = np.argsort(key, kind="stable")
    key, doc, pos = key[by], doc[by], pos[by]
    begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    key, doc = key[begin], pa.array(doc[begin])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, n), pa.int32()), pa.array(pos))
    terms = coded.dictionary.take(pa.array(order)).take(pa.array(key // 2 % len(rank)))
    rows = pa.record_batch({"term": terms, "field": FIELDS.take(pa.array(key % 2)), "doc_idx": column("doc_idx").take(doc), "positions": lists, "chunk": column("chunk").take(doc)})
    for k in range(0, len(rows), OUT_ROWS):
        yield rows.slice(k, OUT_ROWS)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, doc_idx, title_terms, body_terms to rows of term, field, doc_idx, positions, chunk; in sorted runs of some RUN_TOKENS."""
    held, tokens = [], 0
    for batch in batches:
        sizes = pc.add(pc.list_value_length(batch.column("title_terms")), pc.list_value_length(batch.column("body_terms"))).to_numpy().astype(np.int64)
        for start, stop in groups(sizes, RUN_TOKENS):
            held.append(batch.slice(start, stop - start))
            tokens += int(sizes[start:stop].sum())
            if tokens >= RUN_TOKENS:
                yield from _run(pa.Table.from_batches(held))
                held, tokens = [], 0
    if held:
        yield from _run(pa.Table.from_batches(held))
