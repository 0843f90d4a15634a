"""N-gram Jaccard join by PartEnum signatures (operator 2).

A document is the set of its distinct n-word shingles. Sizes fall into bands so that two
sets that can link lie in the same band or in neighbouring ones; a set takes part in the
instance of its own band and of the next. Within an instance linked sets differ in at most
k elements, so if the domain is cut into k + 1 + e partitions by hash, at least 1 + e of
them hold the same elements in both. A signature is the content of one partition. A set
with at most e empty partitions needs no signature for those; any other also joins each
empty one with the partitions of a second cut. Sets that share a signature are candidates.

Equal sets are one class, named by its smallest doc_id, and only that one is compared. Candidates
are checked exactly, without pairing up a group: every member of a signature's group is compared
with the group's smallest member; groups that the found links connect are done. In the rest,
members of different components are compared in blocks by parity sketches (a bit for each hash
value, flipped by each element), whose Hamming distance never exceeds the true difference of the
sets; what passes leaves the task and is compared exactly.

Defined cases: a null or wordless text has the empty set and no link; a text of fewer than n
words is one shingle; ties and copies link through the smallest doc_id; rows that repeat a
doc_id are one document (a link of any of them counts); a null doc_id has no component.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import components, written
from answerlake.llm.words import grams, mix, pieces, released, split_words

PIECE = 1 << 20
BLOCK = 2048
PER_SALT = 256
# bits of a sketch by the size of the set: enough that a difference near the bound rarely collides
SKETCHES = ((600, 1 << 11), (2500, 1 << 13), (1 << 62, 1 << 15))
EMITTED = 200_000       # pairs that a task remembers so as not to give them again


class Bands:
    """Size bands of a threshold in percent, and the number of partitions of each instance."""

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [0]

    def upto(self, size: int) -> np.ndarray:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, (self.tops[-1] + 1) * 100 // self.percent))
        return np.array(self.tops)

    def plan(self, sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Instance, partitions and spare partitions of each set in its band plus step."""
        largest = int(sizes.max())
        tops = self.upto(largest)
        tops = self.upto(int(tops[np.searchsorted(tops, largest)]) + 1)      # the next band too
        instance = np.searchsorted(tops, sizes) + step
        most = 2 * tops[instance] * (100 - self.percent) // (100 + self.percent)
        # room for the empty partitions that the smallest set of the instance is likely to have
        least = tops[np.maximum(instance - 2, 0)] + 1
        about = 1.15 * (most + 1)
        spare = np.where(most > 0, 1 + np.ceil(1.5 * about * np.exp(-least / about)).astype(np.int64), 0)
        return instance, most + 1 + spare, spare


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row's text."""
    words = split_words(batch.column("text"), lower=True)
    runs = grams(words.hash, n)
    out = []
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        if high - low >= n:
            out.append(np.unique(runs[low: high - n + 1]))
        else:
            out.append(grams(words.hash[low:high], high - low) if high > low else runs[:0])
    return out


def _sums(owner: np.ndarray, elements: np.ndarray, parts: np.ndarray, seed: int):
    """Content hash and element count of every partition of every set, in one flat array."""
    base = np.concatenate([[0], np.cumsum(parts)])
    scrambled = mix(elements ^ np.uint64(seed))
    cell = base[owner] + ((scrambled >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, cell, mix(scrambled))
    return base, sums, np.bincount(cell, minlength=base[-1])


def signatures(sets: list[np.ndarray], bands: Bands) -> list[np.ndarray]:
    """PartEnum signatures of nonempty sets."""
    sizes = np.array([len(s) for s in sets])
    owner, elements = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for step in (0, 1):
        instance, parts, spare = bands.plan(sizes, step)
        base, sums, counts = _sums(owner, elements, parts, 0x51ED270B)
        which = np.repeat(np.arange(len(sets)), parts)
        place = np.arange(len(sums)) - base[which]
        tag = mix((instance[which].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
        sigs = mix(sums ^ tag)
        empty = np.add.reduceat((counts == 0).astype(np.int64), base[:-1])
        rare = empty > spare
        for i in np.flatnonzero(~rare):
            cut = slice(base[i], base[i + 1])
            out[i].append(sigs[cut][counts[cut] > 0])
        for i in np.flatnonzero(rare):
            cut = slice(base[i], base[i + 1])
            full = counts[cut] > 0
            _, second, _ = _sums(np.zeros(len(sets[i]), np.int64), sets[i], parts[i: i + 1], 0x2545F491)
            second = mix(second + np.arange(len(second), dtype=np.uint64))
            out[i] += [sigs[cut][full]] + [mix(second ^ s) for s in sigs[cut][~full]]
    return [np.concatenate(x) for x in out]


def _sketch(s: np.ndarray) -> bytes:
    bits = next(b for most, b in SKETCHES if len(s) <= most)
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as wide as the narrowest: the halves of a wider one XORed."""
    width, out = min(map(len, sketches)), []
    for raw in sketches:
        row = np.frombuffer(raw, np.uint64)
        while row.nbytes > width:
            row = row[: len(row) // 2] ^ row[len(row) // 2:]
        out.append(row)
    return np.stack(out)


def _class_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each signature; nothing else is kept of it than the shuffle's copy."""
    bands = Bands(percent)
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            docs, sets = part.column("doc_id").to_numpy(), shingle_sets(part, n)
            some = [i for i, s in enumerate(sets) if len(s)]
            found = signatures([sets[i] for i in some], bands) if some else []
            sigs = np.concatenate([*found, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(docs[some], [len(x) for x in found])), pa.array(sigs.view(np.int64))], names=["doc_id", "sig"])


def _sized(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Size, class key and sketch of every row."""
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            sets = shingle_sets(part, n)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_key(s) for s in sets], pa.binary()),
                 pa.array([_sketch(s) for s in sets], pa.binary())], names=["doc_id", "n_shingles", "key", "sketch"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compared(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt, role): the texts of a, then those to compare with them."""
    group, pivots = None, []
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            found = []
            rows = zip(part.column("a").to_pylist(), part.column("salt").to_pylist(),
                       part.column("role").to_pylist(), part.column("doc_id").to_pylist(),
                       shingle_sets(part, n), strict=True)
            for a, salt, role, b, shingles in rows:
                if group != (a, salt):
                    group, pivots = (a, salt), []
                if role == 0:
                    pivots.append(shingles)
                elif any(_linked(p, shingles, percent) for p in pivots):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                names=["a", "b"])


def exact_links(pairs: DataFrame, documents: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link. One set of a is held at a time;
    a that is compared with many is repeated once for each few thousand of them. The texts
    are always joined by a shuffle, since the pairs grow with the corpus."""
    pairs = written(pairs, "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    right = pairs.join(salts, "a").select(
        F.col("b").alias("doc_id"), "a", F.pmod(F.hash("b"), F.col("salts")).alias("salt"), F.lit(1).alias("role"))
    left = salts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                        F.lit(0).alias("role"))
    texts = right.union(left).hint("merge").join(documents.select("doc_id", "text"), "doc_id")
    texts = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return texts.mapInArrow(lambda x: released(_compared(x, n, percent)), "a long, b long")


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (sig, left, right): one or two blocks of a signature's members.
    Gives pairs of different components whose sketches are close enough."""
    held: list[pa.RecordBatch] = []
    last, given = None, set()

    def fresh():
        """The pairs of the group that this task has not given lately."""
        out = list(dict.fromkeys(pair for pair in flush() if pair not in given))
        if len(given) + len(out) > EMITTED:
            given.clear()
        given.update(out[:EMITTED])
        return out

    def flush():
        rows = pa.Table.from_batches(held)
        chunk, pivot = rows["chunk"].to_numpy(), rows["pivot"].to_numpy()
        doc, comp, size = rows["doc_id"].to_numpy(), rows["comp"].to_numpy(), rows["n"].to_numpy()
        sketch = _folded(rows["sketch"].to_pylist())
        one = chunk == last[1]
        two = chunk == last[2]
        left, right = np.flatnonzero(one), np.flatnonzero(two)
        for i in left:
            j = right[(comp[right] != comp[i]) & (doc[right] != pivot[i])] if doc[i] != pivot[i] else right[:0]
            if last[1] == last[2]:
                j = j[j > i]
            j = j[percent * np.maximum(size[j], size[i]) <= 100 * np.minimum(size[j], size[i])]
            if len(j):
                near = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
                for x in doc[j[(100 + percent) * near <= (100 - percent) * (size[j] + size[i])]]:
                    yield min(doc[i], x), max(doc[i], x)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                           pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "left", "right")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(x) for x in keys[:, low]) if high > low else last
            if key != last and held:
                yield batch_of(fresh())
                held.clear()
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield batch_of(fresh())


def open_pairs(members: DataFrame, found: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs still to compare in groups that the links found so far don't connect."""
    placed = members.filter("cnt > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "comp", F.coalesce("component", "doc_id"))
    groups = placed.groupBy("sig").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("cnt"),
        F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).filter("low <> high")
    groups = groups.groupBy("cnt", "who").agg(F.min("sig").alias("sig")).select("sig")
    open_rows = placed.join(groups, "sig").select("sig", "pivot", "doc_id", "comp", "cnt")
    # members of a component go to the same block, as far as they fit in one
    sizes = open_rows.groupBy("sig", "comp").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    chunk = F.pmod(F.xxhash64("comp", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), F.ceil(F.col("cnt") / BLOCK))
    rows = written(open_rows.join(sizes, ["sig", "comp"]).select("sig", "pivot", "doc_id", "comp", chunk.cast("int").alias("chunk")), "open")
    blocks = rows.groupBy("sig", "chunk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    left = blocks.select("sig", F.col("chunk").alias("left"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    right = blocks.select("sig", F.col("chunk").alias("right"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    tasks = left.join(right, "sig").filter("left <= right and not (l1 = h1 and l2 = h2 and l1 = l2)")
    tasks = tasks.select("sig", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("chunk"))
    sent = rows.join(tasks, ["sig", "chunk"]).join(sketches, "doc_id")
    sent = sent.repartition("sig", "left", "right").sortWithinPartitions("sig", "left", "right", "comp", "doc_id")
    return sent.select("sig", "left", "right", "chunk", "pivot", "doc_id", "comp", "n", "sketch").mapInArrow(
        lambda x: released(_open_pairs(x, percent)), "a long, b long").distinct()


def sketches_of(sized: DataFrame) -> DataFrame:
    """doc_id, sketch, n: a row for each different text of a doc_id."""
    return sized.select("doc_id", "sketch", F.col("n_shingles").alias("n")).distinct()


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when 100 * intersection of their
    shingle sets >= percent * union; a component is named by its smallest doc_id."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = written(documents.mapInArrow(lambda x: released(_sized(x, n)), "doc_id long, n_shingles long, key binary, sketch binary"), "sized")
    some = sized.filter("doc_id is not null and n_shingles > 0")
    classes = written(some.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    rows = documents.filter("doc_id is not null").mapInArrow(lambda x: released(_signed(x, n, percent)), "doc_id long, sig long")
    group = Window.partitionBy("sig")
    members = written(rows.withColumns({"cnt": F.count("*").over(group), "pivot": F.min("doc_id").over(group)})
                      .filter("cnt > 1"), "members")
    # a class has one set and so one list of signatures: its smallest doc_id stands for it, as a pivot does
    members = members.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = members.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(exact_links(pairs, documents, n, percent), "links")
    # a doc_id of several texts is one document: it joins their classes
    named = some.select("doc_id", "key").join(classes, "key")
    several = named.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high")
    own = named.join(several.select("doc_id"), "doc_id").filter("doc_id <> rep").select(
        F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct()
    links = links.union(written(own, "own"))
    found = written(components(links), "components")
    more = written(exact_links(open_pairs(members, found, sketches_of(some), percent), documents, n, percent), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("key").alias("class"), F.coalesce("component", "rep").alias("component_id"))
    out = sized.select("doc_id", "n_shingles", "key").join(classes, F.col("key") == F.col("class"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
