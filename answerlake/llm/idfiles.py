"""Token-id files: an adaptive context-mixing range coder (operator 6).

A file is a table of blocks in ascending doc_id order. A block holds whole documents up to a
number of tokens (a longer document is cut over blocks of its own), is coded from a fresh
model, and ends with a CRC-32 of everything before. Its ids are dealt to lanes that are coded
side by side, a step at a time, by one model that learns from all of them.

Before each id the model has three predictions: how often each id came (order 0), the id last
seen after the previous one (order 1) and after the previous two (order 2), each of the latter
with a confidence. How much of the probability goes to each is learned for every combination
of the confidences. The mixture's interval drives a carry-less range coder with 64-bit state.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first and is
kept as null; rows that repeat a doc_id follow one another, by text; an empty table makes an
empty file. Other columns aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import written
from answerlake.llm.tokens import encoder
from answerlake.llm.words import pieces as cut
from answerlake.llm.words import released

BLOCK_TOKENS = 1 << 20
LANES = 4096
LANE_STEPS = 64
PIECE = 8 << 20
MAGIC = b"IDX1"

SCALE = 20                       # order-0 frequencies sum to 2^20
SHARES = 64                      # the mixture deals out 64 shares of that
BITS = np.uint64(SCALE + 6)
TOP, BOTTOM, LOW32 = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(0xFFFFFFFF)
CHUNK, WORD, UNIT = np.uint64(16), np.uint64(48), np.uint64(1)
CONTEXT_BITS = 18
MOST = 7                         # highest confidence
MOVES = np.array([0, -1] + [-2] * (MOST - 1) + [1] * MOST + [0], np.int32)      # of a confidence after a miss, after a hit
REBUILD = 32                     # steps between new order-0 frequencies


class Model:
    """Predictions of order 0 to 2 and the shares that each gets, learned as ids pass.

    The interval of an id is its share as the order-2 prediction, else as the order-1
    prediction, else its part of what is left to order 0.
    """

    def __init__(self, size: int, lanes: int):
        if size >= 1 << SCALE:
            raise ValueError(f"ids must be below {1 << SCALE}")
        self.count = np.zeros(size, np.int64)
        self.one, self.two = np.zeros(size + 1, np.int32), np.zeros(1 << CONTEXT_BITS, np.int32)     # 8 x guess + confidence
        self.met = np.full(128, 4.0)
        self.hit_one, self.hit_two = np.full(128, 1.0), np.full(128, 1.0)
        self.last, self.before = np.full(lanes, size, np.int64), np.full(lanes, size, np.int64)
        self.size, self.step = size, 0

    def _rebuild(self):
        total = int(self.count.sum())
        share = ((1 << SCALE) - self.size) * self.count // max(total, 1) + 1
        share[int(self.count.argmax())] += (1 << SCALE) - int(share.sum())
        self.share = share
        self.part = (np.concatenate([[0], np.cumsum(share)[:-1]]) << 32) + share      # begin and width in one
        self.inverse = None

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The id whose order-0 part holds a point."""
        if self.inverse is None:
            self.inverse = np.repeat(np.arange(self.size, dtype=np.uint32), self.share)
        return self.inverse.take(at)

    def predict(self, n: int):
        """For the first n lanes: both predicted ids, the ends of their shares, and what is left."""
        if self.step & (self.step - 1) == 0 or self.step % REBUILD == 0:
            self._rebuild()
            self.deal_two = np.int32(60) * (self.hit_two / self.met) + 1
            self.deal_one = np.int32(60) * (self.hit_one / self.met) + 1
            self.deal_two = self.deal_two.astype(np.int64)
            self.deal_one = self.deal_one.astype(np.int64)
            self.deal_one[1::2] = 0              # both predict the same id
        last = self.last[:n]
        self.at = ((last * 0x9E3779B1 + self.before[:n] * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - CONTEXT_BITS)
        one, two = self.one.take(last), self.two.take(self.at)
        p1, p2 = one >> 3, two >> 3
        self.met1, self.met2 = one, two
        self.context = (((two & 7) << 4) + ((one & 7) << 1) + (p1 == p2)).astype(np.int64)
        end2 = self.deal_two.take(self.context)
        return p1, p2, end2, end2 + self.deal_one.take(self.context)

    def learn(self, ids: np.ndarray, right1: np.ndarray, right2: np.ndarray):
        n = len(ids)
        last = self.last[:n]
        seen = np.bincount(self.context + 128 * right2 + 256 * (right1 & ~right2), minlength=384).reshape(3, 128)
        self.hit_two += seen[1]
        self.hit_one += seen[2]
        self.met += seen.sum(0)
        if self.step % 32 == 31:
            for x in (self.met, self.hit_one, self.hit_two):
                x *= 0.5
            self.met += 2.0
        fresh = ids.astype(np.int32) << 3
        for table, place, right, old in ((self.one, last, right1, self.met1), (self.two, self.at, right2, self.met2)):
            state = (old & 7) + (right.view(np.int8) << 3)
            table[place] = np.where(state > 0, old + MOVES.take(state), fresh)
        np.add.at(self.count, ids, 1)
        self.before[:n] = last
        self.last[:n] = ids
        self.step += 1


def _shape(n: int) -> tuple[int, np.ndarray]:
    """Lanes of a block and the number of ids in each."""
    lanes = max(1, min(LANES, n // LANE_STEPS))
    size = np.full(lanes, n // lanes)
    size[: n % lanes] += 1
    return lanes, size


def _narrow(low: np.ndarray, span: np.ndarray, begin: np.ndarray, width: np.ndarray):
    """Takes the first lanes to their interval; yields the lanes that shift out 16 bits."""
    m = len(begin)
    unit = span[:m] >> BITS
    low[:m] += begin * unit
    span[:m] = unit * width
    x, r = low[:m], span[:m]
    live = np.flatnonzero(((x ^ (x + r)) < TOP) | (r < BOTTOM))
    while len(live):
        x, r = low[live], span[live]
        settled = (x ^ (x + r)) < TOP
        r = np.where(settled, r, (~x + UNIT) & LOW32)
        yield live, x
        low[live], span[live] = x << CHUNK, r << CHUNK
        x, r = low[live], span[live]
        live = live[((x ^ (x + r)) < TOP) | (r < BOTTOM)]


def encode_ids(ids: np.ndarray) -> bytes:
    """Ids of one block as bytes."""
    n = len(ids)
    if not n:
        return struct.pack("<III", 0, 0, 0)
    lanes, size = _shape(n)
    first = np.cumsum(size) - size
    model = Model(int(ids.max()) + 1, lanes)
    steps = np.zeros((int(size[0]), lanes), np.int64)      # a row for each step
    steps.T[np.arange(size[0]) < size[:, None]] = ids
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    whose, words = [], []
    for step, now in enumerate(steps):
        m = lanes if step < size[-1] else int((size > step).sum())
        now = now[:m]
        p1, p2, end2, end1 = model.predict(m)
        right1, right2 = p1 == now, p2 == now
        rest = SHARES - end1
        part = model.part.take(now)
        begin = np.where(right2, 0, np.where(right1, end2 << SCALE, (end1 << SCALE) + rest * (part >> 32)))
        width = np.where(right2, end2 << SCALE, np.where(right1, end1 - end2 << SCALE, rest * (part & 0xFFFFFFFF)))
        for live, x in _narrow(low, span, begin.view(np.uint64), width.view(np.uint64)):
            whose.append(live.astype(np.uint16))
            words.append((x >> WORD).astype(np.uint16))
        model.learn(now, right1, right2)
    for shift in (48, 32, 16, 0):
        whose.append(np.arange(lanes, dtype=np.uint16))
        words.append((low >> np.uint64(shift)).astype(np.uint16))
    owner = np.concatenate(whose)
    used = np.bincount(owner, minlength=lanes)
    body = np.concatenate(words)[np.argsort(owner, kind="stable")]       # lane by lane, each in its order
    return struct.pack("<III", n, model.size, lanes) + used.astype("<u4").tobytes() + body.astype("<u2").tobytes()


def decode_ids(data: bytes) -> np.ndarray:
    n, alphabet, lanes = struct.unpack_from("<III", data)
    if not n:
        return np.zeros(0, np.int64)
    _, size = _shape(n)
    first = np.cumsum(size) - size
    used = np.frombuffer(data, "<u4", lanes, 12).astype(np.int64)
    body = np.concatenate([np.frombuffer(data, "<u2", int(used.sum()), 12 + 4 * lanes), np.zeros(4, np.uint16)]).astype(np.uint64)
    at = np.cumsum(used) - used
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << CHUNK | body[at]
        at += 1
    model = Model(alphabet, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    ids = np.zeros(n, np.uint32)
    for step in range(int(size[0])):
        m = lanes if step < size[-1] else int((size > step).sum())
        p1, p2, end2, end1 = model.predict(m)
        value = np.minimum((code[:m] - low[:m]) // (span[:m] >> BITS), (1 << int(BITS)) - 1).view(np.int64)
        in2 = value < end2 << SCALE
        in1 = ~in2 & (value < end1 << SCALE)
        rest = SHARES - end1
        point = (np.where(in2 | in1, 0, value - (end1 << SCALE)) / rest).astype(np.int64)      # exact: below 2^26 by at most 64
        now = np.where(in2, p2, np.where(in1, p1, model.symbol(np.minimum(point, (1 << SCALE) - 1)))).astype(np.int64)
        part = model.part.take(now)
        begin = np.where(in2, 0, np.where(in1, end2 << SCALE, (end1 << SCALE) + rest * (part >> 32))).view(np.uint64)
        width = np.where(in2, end2 << SCALE, np.where(in1, end1 - end2 << SCALE, rest * (part & 0xFFFFFFFF))).view(np.uint64)
        for live, _ in _narrow(low, span, begin, width):
            code[live] = code[live] << CHUNK | body[np.minimum(at[live], len(body) - 1)]
            at[live] += 1
        ids[first[:m] + step] = now
        model.learn(now, p1 == now, p2 == now)
    return ids.astype(np.int64)


def make_block(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A block: magic, document table, coded ids, CRC-32."""
    known = np.array([d is not None for d in docs], np.uint8)
    numbers = np.array([d or 0 for d in docs], "<i8")
    data = MAGIC + struct.pack("<I", len(docs)) + known.tobytes() + numbers.tobytes() + np.array(counts, "<u4").tobytes() + encode_ids(ids)
    return data + struct.pack("<I", zlib.crc32(data))


def read_block(block: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    if block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block of token ids")
    n = struct.unpack_from("<I", block, 4)[0]
    known = np.frombuffer(block, np.uint8, n, 8)
    numbers = np.frombuffer(block, "<i8", n, 8 + n).tolist()
    counts = np.frombuffer(block, "<u4", n, 8 + 9 * n).tolist()
    return [d if k else None for d, k in zip(numbers, known, strict=True)], counts, decode_ids(block[8 + 13 * n: -4])


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end: int, most: int) -> Iterator[pa.RecordBatch]:
    encode, tail, part = encoder(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
    docs, counts, held, size, row, start, number = [], [], [], 0, 0, 0, 0

    def row_of(docs, counts, data, row, segment):
        nonlocal start, number
        ids = np.frombuffer(data, "<u4").astype(np.int64)
        block = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([row], pa.int64()),
             pa.array([segment], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([make_block(docs, counts, ids)], pa.binary())],
            names=["part", "number", "start", "row", "segment", "n_ids", "block"])
        start, number = start + len(ids), number + 1
        return block

    for batch in batches:
        for some in cut(batch, "text", PIECE):
            for doc, ids in zip(some.column("doc_id").to_pylist(), encode.ids(some.column("text").to_pylist()), strict=True):
                ids += tail
                if size and size + len(ids) > 4 * most:
                    yield row_of(docs, counts, b"".join(held), row - len(docs), -1)
                    docs, counts, held, size = [], [], [], 0
                if len(ids) > 4 * most:
                    for segment, at in enumerate(range(0, len(ids), 4 * most)):
                        own = ids[at: at + 4 * most]
                        yield row_of([doc], [len(own) // 4], own, row, segment)
                else:
                    docs.append(doc)
                    counts.append(len(ids) // 4)
                    held.append(ids)
                    size += len(ids)
                row += 1
    if docs:
        yield row_of(docs, counts, b"".join(held), row - len(docs), -1)


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the ids of all documents below `path`, in ascending doc_id order by (part, number)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(lambda x: released(_blocks(x, tokenizer, end_id, block_tokens)),
                    "part int, number int, start long, row long, segment int, n_ids long, block binary").write.option(
        "compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def combine_crc32(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings joined, from theirs and the second's length in bytes."""
    def apply(rows, x):
        out = 0
        for bit in range(32):
            if x >> bit & 1:
                out ^= rows[bit]
        return out

    shift = [0xEDB88320] + [1 << i for i in range(31)]       # one zero bit
    steps = length * 8
    while steps:
        if steps & 1:
            first = apply(shift, first)
        shift = [apply(shift, r) for r in shift]
        steps >>= 1
    return first ^ second


def _read(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, row, segment, block in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "row", "segment", "block")), strict=True):
            docs, counts, ids = read_block(block)
            data = ids.astype("<u4").tobytes()
            ends = np.cumsum(counts, dtype=np.int64)
            begins = (ends - counts).tolist()
            own = [data[4 * a: 4 * b] for a, b in zip(begins, ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array([segment] * n, pa.int32()), pa.array(docs, pa.int64()),
                 pa.array([start + a for a in begins], pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own if keep_ids else [None] * n, pa.binary())],
                names=["part", "row", "segment", "doc_id", "place", "n_tokens", "ids_crc32", "ids"])


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of a file: part, row (in it), segment (-1: a whole document), doc_id, start
    (ids before it in the whole file), n_tokens, ids_crc32, ids (null unless keep_ids)."""
    file = spark.read.parquet(path)
    sizes = file.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row for each part
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    rows = file.select("part", "start", "row", "segment", "block").mapInArrow(
        lambda x: released(_read(x, keep_ids)), "part int, row long, segment int, doc_id long, place long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(bases.hint("merge"), "part").select(
        "part", "row", "segment", "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "ids")


def document_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of whole documents, segments put together."""
    @F.udf("long")
    def joined(parts):
        total = parts[0]["crc"]
        for p in parts[1:]:
            total = combine_crc32(total, p["crc"], 4 * p["n"])
        return total

    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    rows = written(rows, "digests")     # decoded once for both kinds
    whole = rows.filter("segment < 0").select(*columns)
    cut_up = rows.filter("segment >= 0").groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("segment", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc")))).alias("parts"))
    return whole.union(cut_up.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32")))
