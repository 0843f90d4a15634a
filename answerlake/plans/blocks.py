"""Every question against every chunk, as products of blocks.

Chunks are packed where they lie into blocks of a few thousand rows, each one row of compressed
Arrow; they are stored once and not moved afterwards. Questions are dealt by hash to groups, each
one row as well. A cartesian product brings a block and a group together, and a function scores
the two as a matrix product. The rows of a pair are bounded, whatever the tables hold: more chunks
make more blocks, more questions more groups. No pair of rows ever becomes a row; a pair of blocks
gives a row for each question, or its best few chunks, and Spark merges those by an aggregate or a
ranked window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import settle

QUESTIONS_PER_BLOCK = 512
CHUNKS_PER_BLOCK = 2048
#: Groups of questions in a partition, and prepared groups that a task holds.
GROUPS_PER_TASK, GROUPS_HELD = 4, 8


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@contextmanager
def _rows_to_python(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send a block's rows to Python at a time, not 10,000, which a task would hold several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _as_it_is(value):
    return value


@dataclass(frozen=True)
class Grid:
    """How many chunks a block holds at most, and how many groups the questions are cut into."""

    rows: int
    groups: int

    @classmethod
    def over(cls, questions: DataFrame, chunks_per_block: int = CHUNKS_PER_BLOCK,
             questions_per_block: int = QUESTIONS_PER_BLOCK) -> Grid:
        return cls(chunks_per_block, max(1, -(-questions.count() // questions_per_block)))

    def deal(self, chunks: DataFrame, compact: Callable[[pa.RecordBatch], pa.RecordBatch] = _as_it_is,
             measures: dict[str, Callable[[pa.RecordBatch], int]] | None = None) -> DataFrame:
        """The chunk side as stored blocks (block, one column for each measure of its rows)."""
        rows, sizes = self.rows, dict(measures or {})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    block = {"block": pa.array([_packed(compact(part))], pa.binary())}
                    yield pa.RecordBatch.from_pydict(block | {k: pa.array([f(part)], pa.int64()) for k, f in sizes.items()})

        with _rows_to_python(chunks.sparkSession, rows):
            dealt = settle(chunks.mapInArrow(pack, ", ".join(["block binary", *(f"{k} bigint" for k in sizes)])))
        # A table of few splits: its blocks, not its rows, are spread over the cores.
        cores = chunks.sparkSession.sparkContext.defaultParallelism
        return settle(dealt.repartition(cores)) if dealt.rdd.getNumPartitions() < cores else dealt

    def meet(self, dealt: DataFrame, questions: DataFrame, score: Callable[[pa.RecordBatch, object], pa.Table], schema: str,
             key: str = "query_id", prepare: Callable[[pa.Table], object] = _as_it_is) -> DataFrame:
        """score(block, prepare(group)) of every block and every group of questions; rows of one key share a group."""
        group = F.pmod(F.xxhash64(key), F.lit(self.groups)).cast("int")
        asked = settle(questions.groupBy(group.alias("grp")).agg(F.collect_list(F.struct(*questions.columns)).alias("asked"))
                       .coalesce(-(-self.groups // GROUPS_PER_TASK)))

        def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[int, object] = {}
            for batch in batches:
                blocks, groups, members = (batch.column(c) for c in ("block", "grp", "asked"))
                for i in range(batch.num_rows):
                    if (at := groups[i].as_py()) not in ready:
                        if len(ready) >= GROUPS_HELD:
                            ready.pop(next(iter(ready)))
                        ready[at] = prepare(pa.Table.from_struct_array(members[i].values))
                    block = pa.ipc.open_stream(blocks[i].as_buffer()).read_next_batch()
                    yield from score(block, ready[at]).to_batches()

        # Neither side is sent to the driver, as a broadcast would be.
        return dealt.select("block").hint("shuffle_replicate_nl").crossJoin(asked).mapInArrow(both, schema)
