"""SimHash near-dedup by a self-join of the binary trie of fingerprints (operator 13).

Bit i of a document's fingerprint is 1 if it is set in more than half of the XXH64 values of its
word shingles, repeats included. Equal fingerprints are one row, named by their smallest doc_id.

The distinct fingerprints are the leaves of a binary trie over their bits. Counts of prefixes cut
its top into subtrees of at most `most` leaves, and two subtrees meet in one task unless their
prefixes differ in more bits than the budget. In a task the nodes of both are traversed in pairs,
level by level in blocks of bounded size: a pair goes on to its pairs of children with the
differing bits counted so far, and ends where they exceed the budget, or where all leaves below
are one component already, so that a dense group costs its size and not its square. What leaves
the task is a spanning forest of the links found, never the links themselves.

Defined cases: a null, empty or wordless text has the fingerprint zero, linked like any other;
a text of fewer words than a shingle is one shingle; rows that repeat a doc_id are one document;
a null doc_id links with nothing and has no component; very long texts are hashed in parts; an
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.shared import components, written
from answerlake.llm.words import released

SEED = 42
PART_BYTES = 1 << 20
LEAST_LEAVES, MOST_LEAVES, SUBTREES = 256, 1 << 22, 32
PAIRS_AT_ONCE = 1 << 15
SMALL = 16              # leaves of nodes that are compared one by one
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLANK = re.compile(b"[ \t\n\x0b\x0c\r]")


def _parts(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some MB at a time; a part never ends within a word."""
    at = 0
    while at < len(raw):
        found = BLANK.search(raw, at + PART_BYTES)
        to = found.start() if found else len(raw)
        yield raw[at:to].translate(LOWER).split()
        at = to


def fingerprint(text: str | None, n: int = 4) -> int:
    """64-bit SimHash of the n-word shingles of a text, A-Z lower-cased."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _parts((text or "").encode()):
        words = tail + words
        tail = words[len(words) - n + 1:] if len(words) >= n else words
        if len(words) < n:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in
                              zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)),
                             np.uint64, len(words) - n + 1)
        for low in range(0, len(hashes), 1 << 15):
            bits = np.unpackbits(hashes[low: low + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _printed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = np.array([fingerprint(x.as_py(), n) for x in part.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])


def subtrees(prints: DataFrame, most: int) -> list[tuple[int, int]]:
    """(depth, prefix) of the nodes that part the trie into subtrees of at most `most` leaves.
    Only counts of the children of overfull nodes come to the driver: 256 for each."""
    cut, heavy, depth = [], [0], 0
    while heavy:
        at, step = 64 - depth, 64 - depth - 8
        rows = prints.select("print") if depth == 0 else prints.select("print").filter(
            F.shiftrightunsigned("print", at).isin([_signed(p) for p in heavy]))
        counts = {int(r.p) & ((1 << (depth + 8)) - 1): r["count"] for r in rows.groupBy(F.shiftrightunsigned("print", step).alias("p")).count().collect()}
        todo = [(depth, p) for p in heavy]
        heavy = []
        while todo:
            d, p = todo.pop()
            shift = depth + 8 - d
            n = sum(counts.get((p << shift) + i, 0) for i in range(1 << shift))
            if n <= most or d == 64:
                cut += [(d, p)] if n else []
            elif d == depth + 8:
                heavy.append(p)
            else:
                todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        depth += 8
    return sorted(cut, key=lambda x: x[1] << (64 - x[0]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Cuts:
    """Depth and first value of each subtree, and the bits in which prefixes of two differ."""

    def __init__(self, cut: list[tuple[int, int]]):
        self.depth = np.array([d for d, _ in cut], np.int64)
        self.first = np.array([p << (64 - d) for d, p in cut], np.uint64)

    def apart(self, x: int) -> np.ndarray:
        shift = 64 - np.minimum(self.depth, self.depth[x])
        differ = (self.first ^ self.first[x]) >> np.minimum(shift, 63).astype(np.uint64)
        return np.where(shift == 64, 0, np.bitwise_count(differ))


class Forest:
    """Union-find over the leaves of a task, with whole ranges asked for at once."""

    def __init__(self, n: int):
        self.label, self.links, self._changes = np.arange(n), [], np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i], and keeps the links that join two components."""
        a, b = a[self.label[a] != self.label[b]], b[self.label[a] != self.label[b]]
        if not len(a):
            return
        up = {}

        def root(x):
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j, x, y in zip(a.tolist(), b.tolist(), self.label[a].tolist(), self.label[b].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((i, j))
        if up:
            change = np.arange(len(self.label))
            old = np.array(list(up))
            change[old] = [root(x) for x in up]
            self.label = change[self.label]
            self._changes = None

    def changes(self) -> np.ndarray:
        """Prefix counts of places where the label differs from the one before."""
        if self._changes is None:
            self._changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return self._changes


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of every place of the ranges."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]


def _leaf_links(prints: np.ndarray, pairs: np.ndarray, forest: Forest, budget: int) -> None:
    """Compares the leaves of small node pairs one by one."""
    a0, a1, b0, b1 = pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 3]
    for at in range(0, len(pairs), PAIRS_AT_ONCE // 16):
        cut = slice(at, at + PAIRS_AT_ONCE // 16)
        owner, left = _expand(a0[cut], a1[cut])
        again, right = _expand(b0[cut][owner], b1[cut][owner])
        left = left[again]
        near = (left < right) & (np.bitwise_count(prints[left] ^ prints[right]) <= budget)
        forest.add(left[near], right[near])


def join_tries(prints: np.ndarray, edge: int, top: int, apart: int, budget: int) -> list[tuple[int, int]]:
    """Spanning links (places) among the sorted distinct fingerprints: of one subtree with itself
    (edge = len), or of the subtree before `edge` with the one from it on. Both agree in the
    first `top` bits but for `apart` of them."""
    forest, n = Forest(len(prints)), len(prints)
    begin = (0, n, 0, n, apart, top) if edge == n else (0, edge, edge, n, apart, top)
    stack = [np.array([begin], np.int64)]
    while stack:
        now = stack.pop()
        if len(now) > PAIRS_AT_ONCE:
            stack.append(now[PAIRS_AT_ONCE:])
            now = now[:PAIRS_AT_ONCE]
        a0, a1, b0, b1, spent, depth = now.T
        jump = forest.changes()
        one = (jump[a1 - 1] == jump[a0]) & (jump[b1 - 1] == jump[b0]) & (forest.label[a0] == forest.label[b0])
        now = now[~one]
        if not len(now):
            continue
        small = ((now[:, 1] - now[:, 0] <= SMALL) & (now[:, 3] - now[:, 2] <= SMALL)) | (now[:, 5] == 64)
        if small.any():
            _leaf_links(prints, now[small], forest, budget)
        now = now[~small]
        if not len(now):
            continue
        a0, a1, b0, b1, spent, depth = now.T
        same = (a0 == b0) & (a1 == b1)
        middle_a, middle_b = _middle(prints, a0, a1, depth), _middle(prints, b0, b1, depth)
        kids = [(a0, middle_a, b0, middle_b, spent), (middle_a, a1, middle_b, b1, spent), (a0, middle_a, middle_b, b1, spent + 1),
                (middle_a, a1, b0, middle_b, np.where(same, budget + 1, spent + 1))]
        made = np.concatenate([np.stack([*x, depth + 1], 1) for x in kids])
        made = made[(made[:, 0] < made[:, 1]) & (made[:, 2] < made[:, 3]) & (made[:, 4] <= budget)]
        if len(made):
            # the closest pairs first: their links spare later pairs
            stack.append(made[np.argsort(made[:, 4], kind="stable")])
    return forest.links


def _middle(prints: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the bit after `depth` turns to one in each node's range."""
    bit = np.uint64(1) << (63 - depth).astype(np.uint64)
    limit = (prints[low] & ~(bit - np.uint64(1))) | bit     # the first possible value of the upper child
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        less = prints[np.minimum(middle, len(prints) - 1)] < limit
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)


def _dealt(batches: Iterator[pa.RecordBatch], cuts, budget: int) -> Iterator[pa.RecordBatch]:
    """A row of a fingerprint for each pair of subtrees that it takes part in."""
    cut = Cuts(cuts.value)
    mates = [np.flatnonzero(cut.apart(x) <= budget).astype(np.int32) for x in range(len(cut.first))]
    for batch in batches:
        prints, reps = batch.column("print").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
        home = np.searchsorted(cut.first, prints, "right") - 1
        for at in range(0, len(prints), 4096):
            part = slice(at, at + 4096)
            sizes = np.array([len(mates[h]) for h in home[part]], np.int64)
            other = np.concatenate([*[mates[h] for h in home[part]], np.zeros(0, np.int32)])
            own = np.repeat(home[part], sizes).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(np.repeat(prints[part], sizes).view(np.int64)),
                 pa.array(np.repeat(reps[part], sizes))], names=["one", "two", "print", "rep"])


def _joined(batches: Iterator[pa.RecordBatch], cuts, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (one, two): the leaves of two subtrees."""
    cut = Cuts(cuts.value)
    key, held = None, []

    def links():
        rows = pa.Table.from_batches(held)
        prints, reps = rows["print"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        order = np.argsort(prints)
        prints, reps = prints[order], reps[order]
        one, two = key
        edge = len(prints) if one == two else int(np.searchsorted(prints, cut.first[two]))
        top = int(min(cut.depth[one], cut.depth[two]))
        found = join_tries(prints, edge, top, int(cut.apart(one)[two]), budget)
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(reps[found[:, 0]], pa.int64()), pa.array(reps[found[:, 1]], pa.int64())], names=["a", "b"])

    for batch in batches:
        one, two = batch.column("one").to_numpy(), batch.column("two").to_numpy()
        ends = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        for low, high in zip([0, *ends], [*ends, len(one)], strict=True):
            if high > low:
                now = (int(one[low]), int(two[low]))
                if now != key and held:
                    yield links()
                    held.clear()
                key = now
                held.append(batch.slice(low, high - low).select(["print", "rep"]))
    if held:
        yield links()


def near_links(classes: DataFrame, budget: int = 4, least: int = LEAST_LEAVES) -> DataFrame:
    """(a, b): links between the distinct fingerprints (print, rep) that span every component of
    those that differ in at most `budget` bits."""
    spark = classes.sparkSession
    n = classes.count()
    # a leaf is sent once for each subtree that its own meets, so their number stays the same at
    # every size, until a task could no longer hold two of them
    cut = subtrees(classes, min(max(n // SUBTREES, least), MOST_LEAVES)) if n else [(0, 0)]
    cuts = spark.sparkContext.broadcast(cut)
    rows = classes.select("print", "rep").mapInArrow(lambda x: _dealt(x, cuts, budget), "one int, two int, print long, rep long")
    rows = rows.repartition("one", "two").sortWithinPartitions("one", "two")
    return rows.mapInArrow(lambda x: released(_joined(x, cuts, budget)), "a long, b long")


def simhash_components(documents: DataFrame, n: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = written(documents.mapInArrow(lambda x: released(_printed(x, n)), "doc_id long, print long"), "prints")
    classes = written(prints.filter("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    links = near_links(classes, budget)
    # a doc_id of several fingerprints joins them
    several = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).filter("p <> q")
    several = several.select("doc_id").join(prints, "doc_id").distinct().join(classes, "print").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    found = components(written(links.union(several), "links"))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "print", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
