"""Vectorised word splitting and hashing of Arrow string columns.

All helpers look at whole texts as UTF-8 bytes, so that one numpy pass serves
thousands of documents. Words are runs of bytes other than the six ASCII
white-space bytes; white space never occurs inside a multi-byte character, so
byte runs and character runs are the same. Equality of words, lines and word
windows is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_EXACT_WORD_CODE = np.where(_IS_SPACE, U64(0), _BYTE_CODE)
_FOLDED_WORD_CODE = _EXACT_WORD_CODE.copy()
_FOLDED_WORD_CODE[65:91] = _FOLDED_WORD_CODE[97:123]

_powers = np.ones(1, dtype=U64)
_inverse_powers = np.ones(1, dtype=U64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)

        def powers(base: int) -> np.ndarray:
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            return np.cumprod(steps, dtype=U64)

        _powers, _inverse_powers = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    return _powers[:n], _inverse_powers


def span_hashes(data: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start up to the next one; bytes with code 0 do not count at the end."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    powers, inverse = _power_tables(len(data))
    sums = np.add.reduceat(codes[data] * powers, starts)
    return mix(sums * inverse[starts])


@dataclass
class Texts:
    """Some documents as one run of bytes; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each document has."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def take(self, rows: np.ndarray) -> Texts:
        """The documents at these positions."""
        sizes = np.diff(self.offsets)[rows]
        offsets = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        at = np.repeat(self.offsets[:-1][rows] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return Texts(self.data[at], offsets)


@dataclass
class Words:
    """Words of some documents, in order: where each starts, its document and its hash."""

    starts: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of document i: position of its first word; one more entry than documents

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def texts_of(column: pa.Array) -> Texts:
    """A string column as bytes, without a copy; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece has about max_bytes of text; one longer text stays whole."""
    offsets = texts_of(batch.column(column)).offsets
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: Texts, fold_case: bool = False) -> Words:
    """Splits documents into words and hashes each; fold_case treats A-Z as a-z."""
    data, offsets = texts.data, texts.offsets
    solid = ~_IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = solid[heads]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, doc, span_hashes(data, _FOLDED_WORD_CODE if fold_case else _EXACT_WORD_CODE, starts), first)


def windows_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of so many words within one document."""
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    value = np.zeros(len(at), dtype=U64)
    for k in range(width):
        value = mix(value * U64(0xD6E8FEB86659FD93) + words.hashes[at + k])
    return value, at


def line_starts_of(texts: Texts) -> np.ndarray:
    """Where the lines of the documents start that hold at least one byte; a line ends at its line feed."""
    breaks = texts.data == 10
    begins = np.zeros(len(breaks), dtype=bool)
    begins[1:] = breaks[:-1]
    begins[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    return np.flatnonzero(begins)


def repeats_an_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: does an equal one stand before it, does it occur more than once?"""
    _, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first[which] != np.arange(len(keys)), counts[which] > 1


LINE_CODE = _BYTE_CODE.copy()
LINE_CODE[10] = 0
