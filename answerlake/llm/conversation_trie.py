"""Prefix trie of conversations by a splitter skeleton (operator 12).

A turn is a unit of 20 bytes (MD5 of role and text, byte length of the text), a conversation the
path of its units. Equal paths are one row with a count; distinct paths are dealt to shards by
splitters, prefixes of a bounded sample of paths, and sorted there. A node reaches into two shards
only if it is a proper prefix of a splitter: these nodes are the skeleton, a trie of at most
MOST_SHARDS * CUT nodes that is broadcast. A shard walks its sorted paths with one stack and
finishes every other node. For a skeleton node it gives partial aggregates, and one reduction by
node adds them up. Sums over subtrees need no second pass over the skeleton: (members - 1) * bytes
is a sum of members * bytes over the shards less bytes once, which the shard of the node's first
splitter takes off; that shard holds the sampled path, so the node exists there.

Conversations that end in a node are hashed as a stream sorted by conv_id, never gathered. A task
holds 20 bytes for each turn of one conversation, and the finished children of open nodes.

Defined cases: rows of equal turn are ordered by their units; repeated rows are turns each; a null
role or text is empty; rows with a null conv_id belong to no conversation and are left out; very
long texts enter by their digest; an empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import written
from answerlake.llm.words import released

UNIT = 20
SHARD_BYTES = 256 << 10
MOST_SHARDS = 1024
CUT = 256               # units of a path that a splitter may have
SAMPLED = 16            # paths for each shard
SHARED_FROM, STEP = 9, 5

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
        ("node", pa.binary()), ("parent", pa.binary()), ("partial", pa.bool_())]
NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
               "ends_sha256 string, node binary, parent binary, partial boolean")


def turn_units(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), unit."""
    rows = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.octet_length("role").cast("string")
    rows = rows.select("conv_id", "turn", F.concat(
        F.unhex(F.md5(F.concat(size, F.lit(":"), F.col("role"), F.col("text")))),
        F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0"))).alias("unit"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "unit")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "unit")


def rebuilt(units: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 5, then c's own after its first h, where h is the
    CRC-32 of c modulo 9. Every conversation has a further row of place 0 and no unit."""
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED_FROM
    convs = units.filter("place = 1").select("conv_id", h.alias("h"))
    donors = units.filter((F.col("conv_id") % STEP == 0) & (F.col("place") < SHARED_FROM)).withColumnRenamed("conv_id", "donor")
    heads = convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % STEP).join(donors, "donor").filter("place <= h")
    own = units.filter(F.col("place") > h)
    return heads.select("conv_id", "place", "unit").union(own).union(
        convs.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary")))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (conv_id, place)."""
    conv, path, done, size = None, [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.int64()), pa.array([hashlib.md5(x[1]).digest() for x in done], pa.binary()),
             pa.array([x[1] for x in done], pa.binary())], names=["conv_id", "key", "path"])

    for batch in batches:
        for c, place, unit in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "place", "unit")], strict=True):
            if place == 0:
                if conv is not None:
                    done.append((conv, b"".join(path)))
                    size += UNIT * len(path) + 64
                    if size > 1 << 20:
                        yield flush()
                        done, size = [], 0
                conv, path = c, []
            else:
                path.append(unit)
    if conv is not None:
        done.append((conv, b"".join(path)))
    yield flush()


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, key, path of conversations given as (conv_id, place, unit)."""
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return turns.mapInArrow(lambda x: released(_paths(x)), "conv_id long, key binary, path binary")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, conv_id): count, smallest and hash of the ids of each key."""
    key, low, n, sha, done = None, None, 0, None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["key", "n", "low", "ends_sha256"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, n, low, sha.hexdigest()))
                key, low, n, sha = k, c, 0, hashlib.sha256()
            sha.update(f",{c}".encode() if n else str(c).encode())
            n += 1
        if done:
            yield flush()
            done = []
    if key is not None:
        done.append((key, n, low, sha.hexdigest()))
    yield flush()


def _shared_units(a: bytes, b: bytes) -> int:
    most, i = min(len(a), len(b)) // UNIT, 0
    while i < most and a[i * UNIT: (i + 1) * UNIT] == b[i * UNIT: (i + 1) * UNIT]:
        i += 1
    return i


def splitters_of(sample: list[bytes], shards: int) -> list[bytes]:
    """Shortest prefixes that part the sample into about equal shards."""
    sample, out = sorted(set(sample)), []
    for s in range(1, shards):
        i = s * len(sample) // shards
        if 0 < i < len(sample):
            cut = sample[i][: (_shared_units(sample[i - 1], sample[i]) + 1) * UNIT]
            if not out or cut > out[-1]:
                out.append(cut)
    return out


def _below(node: bytes, unit: bytes) -> bytes:
    return hashlib.md5(node + unit).digest()


def skeleton_of(splitters: list[bytes]) -> dict[bytes, int]:
    """Every proper prefix of a splitter, with the shard of its first splitter."""
    out: dict[bytes, int] = {}
    for shard, path in enumerate(splitters, 1):
        node = b""
        for at in range(0, len(path), UNIT):
            out.setdefault(node, shard)
            node = _below(node, path[at: at + UNIT])
    return out


class _Node:
    __slots__ = ("node", "bytes", "owner", "n", "low", "children", "leaves", "saved", "ends", "held")

    def __init__(self, node: bytes, size: int, owner: int | None):
        self.node, self.bytes, self.owner = node, size, owner
        self.n, self.low, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.held = None, []


def _finished(open_nodes: list[_Node], depth: int, shard: int) -> Iterator[tuple]:
    """Closes the open nodes deeper than depth. A finished child is held until its parent knows
    its smallest member, or goes out at once if the parent is of the skeleton."""
    while len(open_nodes) > depth + 1:
        v = open_nodes.pop()
        up = open_nodes[-1] if open_nodes else None
        partial = v.owner is not None
        v.saved += v.n * v.bytes - (v.bytes if not partial or v.owner == shard else 0)
        if not partial and not v.children:
            v.leaves = 1
        at = len(open_nodes)
        for row in v.held:
            yield (*row[:2], v.low, *row[3:])
        row = (v.low, at, None, v.n, v.children, v.leaves, v.saved, v.ends, v.node if partial else None,
               up.node if up else None, partial)
        if up is None or up.owner is not None:
            yield row
        else:
            up.held.append((*row[:9], None, False))
        if up:
            up.n += v.n
            up.low = v.low if up.low is None else min(up.low, v.low)
            up.children += not partial or v.owner == shard
            up.leaves += v.leaves
            up.saved += v.saved


def _walked(batches: Iterator[pa.RecordBatch], skeleton) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, path)."""
    owners, shard, last, stack, done = skeleton.value, None, b"", [], []
    schema = pa.schema(NODE)

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), NODE, strict=True)], schema=schema)

    for batch in batches:
        names = ("shard", "path", "n", "low", "ends_sha256")
        for s, path, n, low, ends in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if s != shard:
                done += _finished(stack, -1, shard)
                shard, last, stack = s, b"", [_Node(b"", 0, owners.get(b""))]
            same = _shared_units(last, path)
            done += _finished(stack, same, shard)
            for at in range(same * UNIT, len(path), UNIT):
                unit = path[at: at + UNIT]
                node = _below(stack[-1].node, unit)
                stack.append(_Node(node, int.from_bytes(unit[16:], "big"), owners.get(node)))
            top = stack[-1]
            top.n, top.low, top.ends = top.n + n, low if top.low is None else min(low, top.low), ends
            last = path
            if len(done) > 5000:
                yield flush()
                done = []
    done += _finished(stack, -1, shard)
    if done:
        yield flush()


def prefix_trie(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Nodes of the trie of (conv_id, key, path), one row each: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    ends = paths.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = ends.mapInArrow(lambda x: released(_ends(x)), "key binary, n long, low long, ends_sha256 string")
    shapes = written(paths.groupBy("key").agg(F.min("path").alias("path")).join(ends, "key"), "shapes")

    size = shapes.agg(F.sum(F.length("path") + UNIT)).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, size // shard_bytes))
    sample = shapes.select(F.substring("path", 1, CUT * UNIT).alias("path"), F.xxhash64("key").alias("h")).orderBy("h").limit(
        SAMPLED * shards).collect() if shards > 1 else []
    splitters = splitters_of([bytes(r.path) for r in sample], shards)
    skeleton = spark.sparkContext.broadcast(skeleton_of(splitters))
    cuts = spark.sparkContext.broadcast(splitters)

    def dealt(batches):
        for batch in batches:
            found = [bisect_right(cuts.value, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "shard"])

    rows = shapes.select("path", "n", "low", "ends_sha256").mapInArrow(
        dealt, "path binary, n long, low long, ends_sha256 string, shard int")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "path")
    nodes = written(rows.mapInArrow(lambda x: released(_walked(x, skeleton)), NODE_SCHEMA), "nodes")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    bones = nodes.filter("partial").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in columns[3:7]], F.max("ends_sha256").alias("ends_sha256"), F.max("parent").alias("parent"))
    # no more rows than the skeleton has nodes, so its size is bounded
    names = F.broadcast(bones.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_low")))
    whole = nodes.filter("not partial").select("conv_id", "depth", "parent_conv_id", *columns[3:], "parent").union(
        bones.select("conv_id", "depth", F.lit(None).cast("long"), *columns[3:], "parent"))
    return whole.join(names, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent_low").alias("parent_conv_id"), *columns[3:7],
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The prefix trie of conversations (conv_id, turn, role, text) as they are."""
    units = turn_units(rows)
    heads = units.filter("place = 1").select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"))
    return prefix_trie(written(paths_of(units.union(heads)), "paths"), shard_bytes)


def rebuilt_trie(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return prefix_trie(written(paths_of(rebuilt(written(turn_units(rows), "units"))), "paths"), shard_bytes)
