"""Vectorised hashing of words and word windows over Arrow string columns.

Everything works on slices of a batch (bounded number of bytes), never on a
whole partition, so the memory of a task does not depend on its row count.
A single text longer than a slice forms a slice of its own.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; these
bytes never occur inside a UTF-8 sequence, so byte positions are safe. A word is folded eight bytes at a time,
each step through ``mix64``, and one longer than ``LONG`` bytes is hashed by BLAKE2; windows are joined from
halves, each join through ``mix64`` again. No step is linear over more than two values, so
texts can't cancel out as they do in sums of powers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 800_000
LONG = 256
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
_ONE, _63 = np.uint64(1), np.uint64(63)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return raw + ((raw - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in this order."""
    return mix64(a * _ODD + b)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` neighbours of ``h``, joined from windows of half the size."""
    n, at, out = len(h) - size + 1, 0, None
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, have = h, 1
    while True:
        if size & have:
            out = part[at : at + n] if out is None else join(out, part[at : at + n])
            at += have
        if at == size:
            return out
        part = join(part[:-have], part[have:])
        have *= 2


def fold(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence with its length, apart from those of windows."""
    out = mix64(np.array([len(h)], np.uint64) ^ _LENGTH)
    for k in range(len(h)):
        out = join(out, h[k : k + 1])
    return out[0]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, rebased to 0) of a string column; null texts count as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some documents: ``doc`` is the row inside the slice, ``first[d]:first[d+1]`` its words."""

    raw: np.ndarray
    start: np.ndarray  # byte offsets inside raw
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def _word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    whole = np.zeros((len(raw) + 23) // 8 * 8, np.uint8)
    whole[: len(raw)] = raw
    whole = whole.view("<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from ``at`` on as a number, of ``left`` bytes only."""
        word, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return ((whole[word] >> shift) | ((whole[word + 1] << _ONE) << (_63 - shift))) & _MASK[np.minimum(left, 8)]

    h = mix64(eight(start, size) ^ (size.astype(np.uint64) * _LENGTH))
    more, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = join(h[more], eight(start[more] + done, size[more] - done))
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Split the documents of one slice into hashed words."""
    offsets = offsets - offsets[0]
    n, docs = len(raw), len(offsets) - 1
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~is_space(raw)
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    if len(cuts):
        # a document border between two word bytes splits the run
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            start = np.sort(np.concatenate([start, cuts]))
            end = np.sort(np.concatenate([end, cuts]))
    h = _word_hashes(lowered(raw) if lower else raw, start, end)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(raw, start, end, doc, first, h)


def window_hashes(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and which of these windows lie in one document.

    Another ``salt`` gives an independent hash.
    """
    n = len(w.hash)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - size + 1)
    h = mix64(w.hash ^ np.uint64(salt)) if salt else w.hash
    return mix64(rolling(h, size) + np.uint64(size)), w.doc[at] == w.doc[at + size - 1]


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct shingle hashes; all words as one shingle if there are fewer."""
    h, ok = window_hashes(w, size)
    first = w.first
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            yield np.unique(h[a : b - size + 1])
        elif b > a:
            yield np.array([fold(w.hash[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def text_slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of bounded parts of a batch."""
    column = batch.column(batch.schema.get_field_index(text))
    raw, offsets = string_buffers(column)
    for i, j in slices(offsets, limit):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
