"""Best-two-fit packing of token sequences (operator 9).

The plan depends on piece lengths alone, and there are at most `capacity` of those: it is made
from their histogram. A bin is filled greedily with the longest piece that still fits; then its
smallest piece is replaced by the two unpacked pieces that fill its gap plus that piece most
tightly, as long as that leaves less room. The same bin is used as often as its lengths last,
so the number of different bins follows the number of lengths, not of documents. Every piece
has a rank among those of its length, counted by the task that made it plus the counts of the
tasks before, and its rank says which bin and offset it has. Texts don't move.

Defined cases: a null or empty text is one piece with the end id alone; only documents longer
than the capacity are cut, so that every piece but the first is full; rows that repeat a
doc_id, or have none, are packed one by one; an empty table gives no pieces. Other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import written
from answerlake.llm.tokens import encoder
from answerlake.llm.words import pieces as cut
from answerlake.llm.words import released

CAPACITY = 1024
PIECE = 1 << 20
KNOWN_WORDS = 200_000        # held by a task


def _cut(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, tail = encoder(path, KNOWN_WORDS), np.array([end], "<u4").tobytes()
    part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
    try:
        for batch in batches:
            for some in cut(batch, "text", PIECE):
                rows = []
                for doc, ids in zip(some.column("doc_id").to_pylist(), encode.ids(some.column("text").to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = (n - start - 1) % capacity + 1 if start == 0 else capacity
                        own = ids[4 * start: 4 * (start + size)]
                        rows.append((doc, piece, start, size, zlib.crc32(own), own if keep_ids else None, part, seen[size]))
                        seen[size] += 1
                        start, piece = start + size, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(),
                                                                              pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "turn"])
    finally:
        encode.forget()


def _best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths still unpacked whose sum comes closest to the room; (0, 0) if none."""
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return 0, 0
    a = have[have < room]
    at = np.searchsorted(have, room - a, "right") - 1
    b = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    alone = (a == b) & (left[a] < 2)
    b = np.where(alone, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), b)
    total = np.where(b > 0, a + b, 0)
    if not len(total) or not total.max():
        return 0, 0
    i = int(total.argmax())
    return int(a[i]), int(b[i])


def bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, number of such bins)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        taken, room = [], capacity
        while room:
            have = np.flatnonzero(left[: room + 1])
            if not len(have):
                break
            longest = int(have[-1])
            n = min(int(left[longest]), room // longest)
            taken += [longest] * n
            left[longest] -= n
            room -= n * longest
        while room and taken:
            a, b = _best_two(left, room + taken[-1])
            if a + b <= taken[-1]:
                break
            left[[a]] -= 1
            left[[b]] -= 1
            room += taken[-1] - a - b
            left[taken.pop()] += 1
            taken = sorted([*taken, a, b], reverse=True)
        need = Counter(taken)
        for length, n in need.items():
            left[length] += n
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        out.append((tuple(taken), times))
    return out


class Plan:
    """Bin and offset of a piece by its length and its rank among pieces of that length."""

    def __init__(self, packed: list[tuple[tuple[int, ...], int]], capacity: int):
        used, sequence, slots = [0] * (capacity + 1), 0, []
        for lengths, times in packed:
            offset = 0
            for length in lengths:
                slots.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        table = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.length, self.rank, self.sequence, self.offset = table.T
        self.from_ = np.searchsorted(self.length, np.arange(capacity + 2))
        self.sequences = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = np.empty(len(length), np.int64)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            low, high = self.from_[size], self.from_[size + 1]
            slot[rows] = low + np.searchsorted(self.rank[low:high], rank[rows], "right") - 1
        return self.sequence[slot] + rank - self.rank[slot], self.offset[slot]


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        kept = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                                         names=[*kept, "sequence_id", "offset"])


def best_two_fit(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each stands.

    doc_id, piece, start, length, ids_crc32, ids (little-endian unsigned 32-bit; null unless
    keep_ids), sequence_id, offset. `tokenizer` is the path of a vocabulary file.
    """
    pieces = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda x: released(_cut(x, tokenizer, end_id, capacity, keep_ids)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, turn long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(bins(histogram, capacity), capacity)
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("turn")).alias("rank"))
    return ranked.mapInArrow(
        lambda x: released(_placed(x, plan)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
