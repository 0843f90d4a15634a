"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes outside a separator class. All classes used here are
ASCII, so working on UTF-8 bytes gives the same words as working on code points. Hashes
are 64-bit: a polynomial over random byte codes, modulo 2^64, mixed once more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, PIECE_BYTES + 1)
_INVERSE = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), PIECE_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a batch of texts: byte range, hash, and the first word of each text."""

    data: np.ndarray    # the bytes, lower-cased if asked for
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # past the last byte of each word
    hash: np.ndarray    # uint64
    first: np.ndarray   # word index at which each text begins; one more entry than texts


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null counts as an empty text."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.frombuffer(raw[2], np.uint8)[low:high] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - low if len(texts) else np.zeros(1, np.int64)


def _hash_piece(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _POWERS[: len(data)], out=sums[1:])
    return (sums[end] - sums[start]) * _INVERSE[start]


def _hash_long(data: np.ndarray) -> np.uint64:
    """A word longer than a piece, by Horner's rule over pieces."""
    total, factor = np.uint64(0), np.uint64(1)
    for at in range(0, len(data), PIECE_BYTES):
        part = data[at: at + PIECE_BYTES]
        with np.errstate(over="ignore"):
            total = total + factor * (_CODES[part] * _POWERS[: len(part)]).sum(dtype=np.uint64)
            factor = factor * _POWERS[PIECE_BYTES]
    return total


def split_words(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Words of a string column. Temporaries stay within a few MB whatever a text's length."""
    data, offsets = _bytes_of(texts)
    if lower:
        data = _LOWER[data]
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separators[data], out=inside[1:-1])
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= inside[inner + 1]        # a text's end closes its last word
    closes[inner - 1] |= inside[inner]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = int(np.searchsorted(end, start[at] + PIECE_BYTES, "right"))
        if to <= at:
            hashes[at] = _hash_long(data[start[at]: end[at]])
            at += 1
            continue
        low = start[at]
        hashes[at:to] = _hash_piece(data[low: end[to - 1]], start[at:to] - low, end[at:to] - low)
        at = to
    hashes = mix(hashes + (end - start).astype(np.uint64))
    return Words(data, start, end, hashes, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive hashes; position i covers i .. i + n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, seed * 0x632BE59BD9B4E019 % 2**64 + n, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= hashes[i: len(out) + i]
        out ^= out >> np.uint64(32)
    return mix(out)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes a task's batches on. At the end it gives freed memory back to the system: a
    worker serves many tasks and would else keep the peak of each kind of task."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # only some C libraries have it
        if trim:
            trim(0)


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Row ranges of a batch whose texts sum to max_bytes or a single row."""
    size = np.diff(_offsets(batch.column(column)))
    at, n = 0, batch.num_rows
    total = np.concatenate([[0], np.cumsum(size)])
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    return _bytes_of(column)[1]
