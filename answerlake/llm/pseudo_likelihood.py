"""Masked pseudo-likelihood of documents (operator 8).

A small network predicts each word's class from the two words on either side of it: the four
neighbours' vectors are added, pass a tanh layer and give two softmaxes, one over groups of
classes and one over the classes of a group, corpus shares being their biases. Classes are the
most frequent words of the corpus, counted over all of it, and hash buckets for the rest. A
word of a bucket has its own probability, that of its class times its share of the class's
words, from the counts of all words of the corpus. A document's score is the sum of its
words' conditional log probabilities, each with the word itself masked.

The table of word counts grows with the corpus and stays in Spark. The counts of the KNOWN
most frequent words go to the tasks; every other word of a text is joined with the table.

Training is plain numpy: every task trains from the same start on every word of all its
documents, and the tasks' weights are averaged, each by the number of words behind it,
first within SLOTS groups and then on the driver, which receives SLOTS small matrices.

Defined cases: null, empty and wordless texts have no words, sum 0 and no mean; a document's
ends are a class of their own; rows that repeat a doc_id are scored one by one; a word that
the corpus doesn't hold counts as one that it holds once; an empty corpus scores nothing.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.shared import written
from answerlake.llm.words import mix, split_words
from answerlake.llm.words import pieces as cut

FREQUENT = 384
BUCKETS = 128
MEMBERS = 32        # classes of a group
KNOWN = 65_536
WIDTH = 16
NEAR = (-2, -1, 1, 2)
BATCH = 2048
RATE = 0.3
SLOTS = 32
PIECE = 2 << 20
ROWS = 4096


@dataclass
class Network:
    words: np.ndarray       # sorted hashes of the frequent words
    share: np.ndarray       # corpus share of each class, all classes of whole groups
    inputs: np.ndarray      # [neighbour, class and the end, width]
    hidden: np.ndarray      # [width]
    group: np.ndarray       # [width, group]
    member: np.ndarray      # [group, width, class of the group]

    @classmethod
    def start(cls, words: np.ndarray, share: np.ndarray, seed: int = 7) -> Network:
        draw, n = np.random.default_rng(seed), len(share)
        return cls(words, share, draw.normal(0, 0.3, (len(NEAR), n + 1, WIDTH)).astype(np.float32), np.zeros(WIDTH, np.float32),
                   draw.normal(0, 0.1, (WIDTH, n // MEMBERS)).astype(np.float32), draw.normal(0, 0.1, (n // MEMBERS, WIDTH, MEMBERS)).astype(np.float32))

    def __post_init__(self):
        shares = self.share.reshape(-1, MEMBERS)
        self.group_bias = np.log(shares.sum(1)).astype(np.float32)
        self.member_bias = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        bucket = FREQUENT + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.words):
            return bucket
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, bucket)

    def contexts(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Classes of the neighbours of every word; beyond a text stands the class of ends."""
        n, end = len(classes), len(self.share)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out = np.full((n, len(NEAR)), end)
        for j, step in enumerate(NEAR):
            low, high = max(0, -step), min(n, n - step)
            if high > low:
                same = text[low:high] == text[low + step: high + step]
                out[low:high, j] = np.where(same, classes[low + step: high + step], end)
        return out

    def layer(self, contexts: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.inputs[j][contexts[:, j]] for j in range(len(NEAR))) + self.hidden)

    def log_probability(self, classes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        out = np.empty(len(classes))
        for at in range(0, len(classes), ROWS):
            y = classes[at: at + ROWS]
            order = np.argsort(y // MEMBERS, kind="stable")
            y, h = y[order], self.layer(contexts[at: at + ROWS][order])
            own = _log_softmax(h @ self.group + self.group_bias)[np.arange(len(y)), y // MEMBERS]
            for g, low, high in _groups(y):
                z = _log_softmax(h[low:high] @ self.member[g] + self.member_bias[g])
                own[low:high] += z[np.arange(high - low), y[low:high] % MEMBERS]
            out[at + order] = own
        return out

    def train(self, classes: np.ndarray, contexts: np.ndarray) -> None:
        """One pass of gradient steps."""
        ends = len(self.share) + 1
        for at in range(0, len(classes), BATCH):
            y = classes[at: at + BATCH]
            order = np.argsort(y // MEMBERS, kind="stable")
            y, x = y[order], contexts[at: at + BATCH][order]
            h, rate = self.layer(x), RATE / len(y)
            p = _softmax(h @ self.group + self.group_bias)
            p[np.arange(len(y)), y // MEMBERS] -= 1
            p *= rate
            back = p @ self.group.T
            self.group -= h.T @ p
            for g, low, high in _groups(y):
                p = _softmax(h[low:high] @ self.member[g] + self.member_bias[g])
                p[np.arange(high - low), y[low:high] % MEMBERS] -= 1
                p *= rate
                back[low:high] += p @ self.member[g].T
                self.member[g] -= h[low:high].T @ p
            back *= 1 - h * h
            self.hidden -= back.sum(0)
            place = (x + np.arange(len(NEAR)) * ends).ravel()
            for i in range(WIDTH):
                more = np.bincount(place, np.repeat(back[:, i], len(NEAR)), len(NEAR) * ends)
                self.inputs[:, :, i] -= (4 * more).reshape(len(NEAR), ends)

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.hidden, self.group, self.member)]).astype(np.float64)

    def with_weights(self, w: np.ndarray) -> Network:
        own = (self.inputs, self.hidden, self.group, self.member)
        cuts = np.cumsum([x.size for x in own])[:-1]
        return Network(self.words, self.share, *(x.reshape(y.shape).copy() for x, y in zip(np.split(w.astype(np.float32), cuts), own, strict=True)))


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z) @ np.ones((z.shape[1], 1), z.dtype))
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z @ np.ones((z.shape[1], 1), z.dtype)
    return z


def _groups(classes: np.ndarray):
    """(group, low, high) of classes sorted by group."""
    edges = np.searchsorted(classes // MEMBERS, np.arange(classes[-1] // MEMBERS + 2)) if len(classes) else [0]
    return ((g, low, high) for g, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if low < high)


@dataclass
class Model:
    network: Network
    known: np.ndarray       # sorted hashes of words whose counts the tasks have
    known_counts: np.ndarray
    class_counts: np.ndarray
    counts: DataFrame       # word, n of every word of the corpus


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, "text", 4 * PIECE):
            found, n = np.unique(split_words(part.column("text"), lower=True).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])


def _trained(batches: Iterator[pa.RecordBatch], start: Network) -> Iterator[pa.RecordBatch]:
    net, n = start.with_weights(start.weights()), 0
    for batch in batches:
        for part in cut(batch, "text", PIECE):
            words = split_words(part.column("text"), lower=True)
            classes = net.classes(words.hash)
            net.train(classes, net.contexts(classes, words.first))
            n += len(classes)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([n], pa.int64()),
                                          pa.array([(net.weights() * n).tobytes()], pa.binary())], names=["slot", "n", "total"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for count, data in zip(batch.column("n").to_pylist(), batch.column("total").to_pylist(), strict=True):
            own = np.frombuffer(data)
            total, n = own.copy() if total is None else total + own, n + count
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])


def learn_network(documents: DataFrame) -> Model:
    texts = documents.select("text").filter("text is not null")
    counts = written(texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    often, held = np.iinfo(np.int64).max, 0
    for n, words in sorted(counts.groupBy("n").count().collect(), reverse=True):       # a row for each different count
        held += words
        if held > KNOWN:
            break
        often = n
    top = sorted(counts.filter(F.col("n") >= often).collect(), key=lambda r: (-r["n"], r["word"]))
    words, known = (np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64)) for rows in (top[:FREQUENT], top))
    number = {r["word"] % 2**64: r["n"] for r in top}
    classes = np.zeros(FREQUENT + BUCKETS)
    for r in counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        classes[FREQUENT + r["bucket"]] = r["n"]
    for i, word in enumerate(words.tolist()):
        classes[i] = number[word]
        classes[FREQUENT + word % BUCKETS] -= number[word]
    classes += 1.0
    start = Network.start(words, classes / classes.sum())
    parts = texts.mapInArrow(lambda x: _trained(x, start), "slot int, n long, total binary").repartition(SLOTS, "slot").mapInArrow(
        _summed, "n long, total binary").collect()
    n = sum(r["n"] for r in parts)
    net = start.with_weights(sum(np.frombuffer(r["total"]) for r in parts) / n) if n else start
    return Model(net, known, np.array([number[x] for x in known.tolist()], float), classes, counts)


def _scored(batches: Iterator[pa.RecordBatch], net: Network, known: np.ndarray, known_counts: np.ndarray, class_counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text, with the part of its score that needs no other count, and a row for
    each of its words whose count is to be looked up. A text's row has a word that only spreads it."""
    row, known_log, class_log = TaskContext.get().partitionId() << 36, np.log(known_counts), np.log(class_counts)
    for batch in batches:
        for part in cut(batch, "text", PIECE):
            words = split_words(part.column("text"), lower=True)
            classes = net.classes(words.hash)
            each = net.log_probability(classes, net.contexts(classes, words.first))
            rare = np.flatnonzero(classes >= FREQUENT)
            each[rare] -= class_log[classes[rare]]
            if len(known):
                at = np.minimum(np.searchsorted(known, words.hash[rare]), len(known) - 1)
                have = known[at] == words.hash[rare]
                each[rare[have]] += known_log[at[have]]
                rare = rare[~have]
            total = np.concatenate([[0.0], np.cumsum(each)])
            n, texts = np.diff(words.first), row + np.arange(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts), pa.array(mix(texts).view(np.int64)), part.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(total[words.first[1:]] - total[words.first[:-1]])], names=["row", "word", "doc_id", "n_words", "part"])
            if len(rare):
                none = pa.nulls(len(rare), pa.int64())
                owner = texts[np.searchsorted(words.first, rare, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(words.hash[rare].view(np.int64)), none, none, none.cast(pa.float64())],
                                                 names=["row", "word", "doc_id", "n_words", "part"])
            row += part.num_rows


def pseudo_likelihood(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over words), per_word of every document."""
    model = model or learn_network(documents)
    held = (model.network, model.known, model.known_counts, model.class_counts)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda x: _scored(x, *held), "row long, word long, doc_id long, n_words long, part double")
    joined = rows.hint("merge").join(model.counts, "word", "left")
    looked_up = F.when(F.col("n_words").isNull(), F.log("n")).otherwise(F.col("part"))
    found = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                      F.sum(F.coalesce(looked_up, F.lit(0.0))).alias("log_likelihood"))
    return found.select("doc_id", "n_words", "log_likelihood", F.expr("log_likelihood / nullif(n_words, 0)").alias("per_word"))
