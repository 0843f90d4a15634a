"""Word runs of texts looked up in a Bloom filter of passages, where the text lies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.words import mix, pieces, released, split_words

# Words end at these bytes (`\S` of the SQL), 32 bits a passage up to 32 MB in all.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x09, 0x0A, 0x0C, 0x0D, 0x20]] = True
LEAST_BITS, MOST_BITS, SEGMENT_BITS = 10, 22, 16     # powers of two: 64-bit words of the filter, of a segment
PIECE_BYTES, CHUNK_WORDS = 1 << 20, 1 << 16
_OPENING = 1 << 40                                   # marks a run that a longer passage begins with
_BASE = 0xD6E8FEB86659FD93
_UNITS = np.uint64(1), np.uint64(6), np.uint64(63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of the runs of any size that begin at the words of a slice."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * _powers(_BASE, len(hashes)))])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), len(hashes))

    def keys(self, at: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.inverse[at] + np.uint64(size + kind))


def _word_and_bits(keys: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a key lies in a filter of 2^power words, and the four bits that it sets there."""
    one, step, low = _UNITS
    bits = np.zeros(len(keys), np.uint64)
    for i in range(4):
        bits |= one << (keys >> step * np.uint64(i) & low)
    return (keys >> np.uint64(64 - power)).astype(np.int64), bits


def _held(table: np.ndarray, power: int, keys: np.ndarray) -> np.ndarray:
    """Indices of the keys that the filter may hold; one bit sifts out most."""
    one, _, low = _UNITS
    some = np.flatnonzero(table[(keys >> np.uint64(64 - power)).astype(np.int64)] >> (keys & low) & one)
    word, bits = _word_and_bits(keys[some], power)
    return some[table[word] & bits == bits]


def _marks(batches: Iterator[pa.RecordBatch], n: int, power: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "passage", PIECE_BYTES):
            found = split_words(some.column("passage"), SEPARATORS)
            runs, size = Runs(found.hash), np.diff(found.first)
            keys = [runs.keys(found.first[:-1][size == k], int(k)) for k in np.unique(size)]
            keys.append(runs.keys(found.first[:-1][size > n], n, _OPENING))
            word, bits = _word_and_bits(np.concatenate(keys), power)
            yield pa.RecordBatch.from_arrays([pa.array(word >> SEGMENT_BITS, pa.int64()), pa.array(word & ((1 << SEGMENT_BITS) - 1)),
                                              pa.array(bits.view(np.int64))], names=["segment", "place", "bits"])


def _segment(rows: pa.Table) -> pa.Table:
    out = np.zeros(1 << SEGMENT_BITS, np.uint64)
    np.bitwise_or.at(out, rows.column("place").to_numpy(), rows.column("bits").to_numpy().view(np.uint64))
    return pa.table({"segment": rows.column("segment")[:1], "held": pa.array([out.tobytes()], pa.binary())})


def passage_filter(passages: DataFrame, n: int, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the passages and of the first n words of each longer one.

    Its size follows their number up to 32 MB; beyond, it lets more runs pass.
    """
    power = min(max((count // 2).bit_length(), LEAST_BITS), MOST_BITS)
    marks = passages.select("passage").mapInArrow(lambda x: _marks(x, n, power), "segment long, place long, bits long")
    table = np.zeros(max(1 << power, 1 << SEGMENT_BITS), np.uint64)
    for row in marks.groupBy("segment").applyInArrow(_segment, "segment long, held binary").toLocalIterator():
        at = row["segment"] << SEGMENT_BITS
        table[at: at + (1 << SEGMENT_BITS)] = np.frombuffer(row["held"], np.uint64)
    return table[: 1 << power], power


def _known(found, sizes: list[int], n: int, table: np.ndarray, power: int):
    """(first word, size) arrays of the runs that the filter may hold."""
    total = len(found.hash)
    ends = np.repeat(found.first[1:], np.diff(found.first))
    longest = sizes[-1]
    for low in range(0, total, CHUNK_WORDS):
        high = min(low + CHUNK_WORDS, total)
        runs = Runs(found.hash[low: high + longest])
        left = ends[low:high] - np.arange(low, high)
        opened = np.zeros(0, np.int64)
        if longest > n:
            at = np.flatnonzero(left > n)
            opened = at[_held(table, power, runs.keys(at, n, _OPENING))]
        for k in sizes:
            at = opened[left[opened] >= k] if k > n else np.flatnonzero(left >= k)
            at = at[_held(table, power, runs.keys(at, k))]
            if len(at):
                yield at + low, k


def _found_in(batches: Iterator[pa.RecordBatch], sizes: list[int], n: int, shared, power: int) -> Iterator[pa.RecordBatch]:
    table = shared.value
    for batch in batches:
        for some in pieces(batch, "text", PIECE_BYTES):
            found = split_words(some.column("text"), SEPARATORS)
            data = found.data.tobytes()
            seen = set()
            for at, k in _known(found, sizes, n, table, power):
                rows = np.searchsorted(found.first, at, "right") - 1
                for row, i in zip(rows.tolist(), at.tolist(), strict=True):
                    words = zip(found.start[i: i + k].tolist(), found.end[i: i + k].tolist(), strict=True)
                    seen.add((row, b" ".join([data[a:b] for a, b in words])))
            if seen:
                rows, texts = zip(*seen, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=[some.schema.names[0], "passage"])


def runs_in_texts(docs: DataFrame, doc_id: str, passages: DataFrame, sizes: dict[int, int], n: int) -> DataFrame:
    """(doc_id, passage): the runs of each document's words that may be a passage.

    `passages` has its words joined by single spaces, `sizes` how many passages have how many
    words. Sizes up to n are looked up at every word, longer ones only where n words begin one,
    so the work follows the documents' words, not the passages.
    """
    table, power = passage_filter(passages, n, sum(sizes.values()) + sum(c for k, c in sizes.items() if k > n))
    shared, order = docs.sparkSession.sparkContext.broadcast(table), sorted(sizes)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), "text").mapInArrow(
        lambda x: released(_found_in(x, order, n, shared, power)), f"`{doc_id}` {kind}, passage string")
