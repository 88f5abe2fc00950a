"""Words of whole Arrow string columns, found and hashed on their UTF-8 bytes with numpy.

Every character beyond ASCII is made of bytes of 128 and more, so word rules that only name
ASCII characters can be applied to bytes. A batch is worked off in pieces of a bounded number
of bytes (a single longer text is a piece of its own), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 21
# Where several stages share executors, and each worker keeps what the one before took.
SMALL_PIECE_BYTES = 1 << 20
PIECE_TEXTS = 2048

# Odd multipliers of the rolling hashes and the finalizer of splitmix64.
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _table(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(members, np.uint8)] = True
    return found


# Letters a-z, digits and everything beyond ASCII (texts are lower-cased first).
ALPHANUMERIC = _table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))
# Anything but white space.
VISIBLE = _table(bytes(b for b in range(256) if b not in b" \t\n\v\f\r"))
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offset of each; a null text has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, one text at least."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), start + PIECE_TEXTS, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of several texts: byte range, hash and text of each; ``first`` word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps, out=steps)


def _scaled_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the leading ``values``, each times its power of the base. Worked off in place: of a
    piece of 1 MB each further array takes 8 MB."""
    total = np.zeros(len(values) + 1, np.uint64)
    total[1:] = values
    total[1:] *= _powers(len(values), _BASE)[: len(values)]
    return np.cumsum(total, out=total)


def _inverses(n: int, start: np.ndarray) -> np.ndarray:
    """What takes a run from ``start`` back to place 0; the whole table is gone on return."""
    return _powers(n, pow(_BASE, -1, 2**64))[start]


def find_words(column: pa.Array, members: np.ndarray, lower: bool = True) -> Words:
    """Longest runs of ``members`` in each text, hashed; A-Z count as a-z if ``lower``."""
    data, offsets = utf8(column)
    inside = members[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    if lower:
        data = LOWER[data]
    if len(start):
        total = _scaled_sums(data.astype(np.uint16) + np.uint16(1))
        runs = total[end] - total[start]
        del total
        hashes = mix(runs * _inverses(len(data), start))
    else:
        hashes = np.empty(0, np.uint64)
    return Words(data, start, end, hashes, text, bounds)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of ``n`` words; a shorter text that has words is one run."""
    counts = words.counts
    whole = np.flatnonzero((counts > 0) & (counts < n))
    size = len(words.hash) - n + 1
    if size > 0:
        inside = np.flatnonzero(words.text[:size] == words.text[n - 1 :])
        runs = np.zeros(len(inside), np.uint64)
        for k in range(n):
            runs = runs * _STEP + words.hash[inside + k]
        hashes, text = mix(runs), words.text[inside]
    else:
        hashes, text = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(whole):
        short = np.zeros(len(whole), np.uint64)
        for k in range(n - 1):
            there = counts[whole] > k
            at = np.where(there, words.first[whole] + k, 0)
            short = np.where(there, short * _STEP + words.hash[at], short)
        hashes = np.concatenate([hashes, mix(short + counts[whole].astype(np.uint64))])
        text = np.concatenate([text, whole])
    return hashes, text


def run_hashes(hashes: np.ndarray, n: int | np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Hash of the runs of ``n`` words from each word ``start``, or from all that ``n`` words follow."""
    if start is None:
        start = np.arange(max(len(hashes) - n + 1, 0))
    total = _scaled_sums(hashes)
    return mix((total[start + n] - total[start]) * _inverses(len(hashes), start))


def distinct(hashes: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, cut to 52 bits so that one sort of integers finds them;
    returned as whole numbers with the offset of each text. At most PIECE_TEXTS texts at a time."""
    keys = np.sort((text.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << np.uint64(52))
    return keys & np.uint64((1 << 52) - 1), bounds
