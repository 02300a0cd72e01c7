"""Array helpers for tasks that read text in Arrow batches.

Texts stay UTF-8 bytes. Words are found, lower-cased and hashed for a whole slice of a
batch at once; slices hold a few MB of text, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _M64, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the hash of bytes i..j, times base**i."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each span, wherever it lies."""
    raw = (sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``buf``, the text each is in, and where each text's words begin."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # one more than there are texts

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_sums(self.buf), self.start, self.end)


def find_words(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = True) -> Words:
    """offsets: where each text begins in buf, and the end."""
    if lower:
        buf = LOWER[buf]
    inside = ~separators[buf]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[offsets < len(buf)]
    begins[edge] = inside[edge]
    edge = offsets[offsets > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(buf, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``most`` bytes of text each (one row at least), as (part, bytes, offsets)."""
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def by_text(values: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Values of consecutive texts as one list a text."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 where it has none."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
