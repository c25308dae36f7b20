"""Vectorised tokenising and hashing of UTF-8 text held in Arrow batches.

All helpers work on a *chunk*: the concatenated UTF-8 bytes of some documents
and their offsets.  A chunk holds about ``CHUNK_BYTES`` (a longer document is a
chunk of its own), so a task's memory does not depend on the partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*groups: str) -> np.ndarray:
    """Table byte -> class; class 0 separates.  ``\\x80`` in a group stands for all non-ASCII bytes."""
    table = np.zeros(256, dtype=np.uint8)
    for number, group in enumerate(groups, 1):
        for char in group:
            table[ord(char)] = number
        if "\x80" in group:
            table[128:] = number
    return table


ALNUM = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "\x80"
SYMBOLS = "".join(chr(c) for c in range(33, 127) if chr(c) not in ALNUM)
WORDS = byte_class(ALNUM)
WORDS_AND_SYMBOLS = byte_class(ALNUM, SYMBOLS)
#: Everything but space and the controls tab .. carriage return.
NON_SPACE = byte_class("".join(chr(c) for c in range(129) if c not in (32, 9, 10, 11, 12, 13)))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of each chunk; null texts count as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class RangeHash:
    """Polynomial hashes of byte ranges of one buffer; equal bytes hash alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables(len(data))
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self.power[: len(data)]
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(terms, out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


@dataclass
class Tokens:
    start: np.ndarray  #: byte offsets in the chunk
    end: np.ndarray
    doc: np.ndarray  #: row within the chunk
    hash: np.ndarray  #: 64-bit hash of the lower-cased bytes
    kind: np.ndarray  #: class of the token's bytes
    ranges: RangeHash  #: hashes of other byte ranges of the chunk


def tokenize(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Tokens:
    """Maximal runs of bytes of one class (0 separates); no run crosses a document."""
    kinds = classes[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1]) if len(data) > 1 else None
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kinds[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    doc = np.searchsorted(offsets, start, side="right") - 1
    ranges = RangeHash(LOWER[data])
    return Tokens(start, end, doc, ranges(start, end), kinds[start], ranges)


def hash_of(word: str) -> np.uint64:
    """The hash that ``tokenize`` gives this token."""
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return RangeHash(data)(np.array([0]), np.array([len(data)]))[0]


def ngrams(tokens: Tokens, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-token windows inside one document, and the documents."""
    h = tokens.hash if hashes is None else hashes
    if n == 1:
        return mix(h + np.uint64(1)), tokens.doc
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = tokens.doc[n - 1 :] == tokens.doc[: 1 - n]
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _BASE + h[k : len(h) - n + 1 + k])
    return out[inside], tokens.doc[: 1 - n][inside]
