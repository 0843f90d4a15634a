"""Benchmark decontamination by FM-indexes (operator 4).

Each training shard (some MB of documents of one task) is indexed over the vocabulary of the
benchmark: a word outside that vocabulary ends a run, as does a document's end, and runs too
short for any window are left out, which loses no occurrence. The index is the
Burrows-Wheeler transform of the runs in a wavelet matrix with bit-packed ranks, and suffix
positions sampled at every run start and every few words. All windows of the benchmark are
searched backward at once, their occurrences located by walking to the next sampled position,
and covered words merged into spans. Documents don't move: there is no shuffle.

Only the benchmark's windows are broadcast. Its items are taken in blocks of bounded word
count; a larger benchmark takes more passes and loses nothing.

Defined cases: null or wordless documents have nothing hit; items without words have no
window; shorter items than a window are one window; repeated items count once by their id
(null ids as the empty string); rows that repeat a doc_id get a row each; an empty benchmark
or an empty documents table gives unhit or no rows. Other columns aren't read unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.words import NOT_ALNUM, released, split_words
from answerlake.llm.words import pieces as cut

WINDOW = 10
SHARD_BYTES = 4 << 20
SAMPLE = 8
BLOCK_WORDS = 1_000_000


class Phrases:
    """Windows of a block of benchmark items over that block's vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WINDOW):
        words = split_words(pa.array(texts, pa.string()), NOT_ALNUM, lower=True)
        self.vocabulary = np.unique(words.hash)
        coded = np.searchsorted(self.vocabulary, words.hash).astype(np.int64) + 1
        windows: dict[bytes, int] = {}
        links = set()
        for i, low, high in zip(range(len(ids)), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            for at in range(low, max(low + 1, high - width + 1) if high > low else low):
                window = coded[at: min(at + width, high)].tobytes()
                links.add((windows.setdefault(window, len(windows)), i))
        self.windows = [np.frombuffer(w, np.int64) for w in windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.least = int(self.length.min()) if len(self.windows) else 0
        pairs = np.array(sorted(links), np.int64).reshape(-1, 2)
        self.item_of = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.ids = ids


class WaveletMatrix:
    """Symbols of a sequence by bit planes; rank of a symbol before a position."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.planes = []
        for bit in reversed(range(max(int(top).bit_length(), 1))):
            ones = (symbols >> bit) & 1
            packed = np.zeros((len(symbols) // 64 + 2) * 8, np.uint8)
            packed[: (len(ones) + 7) // 8] = np.packbits(ones.astype(np.uint8), bitorder="little")
            lanes = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(lanes), dtype=np.int64)])
            self.planes.append((bit, lanes, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    @staticmethod
    def _ones(lanes: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        lane, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[lane] + np.bitwise_count(lanes[lane] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = np.zeros_like(at)
        for bit, lanes, before, zeros in self.planes:
            one = (symbol >> bit) & 1 == 1
            a, b = self._ones(lanes, before, at), self._ones(lanes, before, low)
            at, low = np.where(one, zeros + a, at - a), np.where(one, zeros + b, low - b)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for bit, lanes, before, zeros in self.planes:
            one = (lanes[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ranked = self._ones(lanes, before, at)
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ranked, at - ranked)
        return out


def suffix_array(text: np.ndarray, runs: int) -> np.ndarray:
    """Sorted suffixes by prefix doubling. Symbols below `runs` occur once each, so the
    rounds end with the longest run."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank.max() == n - 1:
            return order
        step *= 2


class FMIndex:
    """An index of runs of symbols (1 and above) for backward search and location."""

    def __init__(self, symbols: np.ndarray, run_starts: np.ndarray, top: int):
        runs = len(run_starts)
        n = len(symbols) + runs
        self.place = np.arange(len(symbols)) + np.searchsorted(run_starts, np.arange(len(symbols)), "right")
        text = np.empty(n, np.int64)
        breaks = run_starts + np.arange(runs)        # a separator before each run
        text[breaks] = np.arange(runs)
        text[self.place] = symbols + runs - 1
        order = suffix_array(text, runs)
        plain = np.zeros(n, np.int64)
        plain[self.place] = symbols
        self.bwt = WaveletMatrix(plain[order - 1], top)
        self.counts = np.searchsorted(np.sort(plain), np.arange(top + 2))
        where = np.full(n, -1, np.int64)
        where[self.place] = np.arange(len(symbols))
        within = np.arange(n) - np.repeat(breaks, np.diff(np.append(breaks, n)))
        kept = (within % SAMPLE == 1) | (within == 0)
        self.sampled = np.flatnonzero(kept[order])
        self.sample = np.where(within[order] == 0, -1, where[order])[self.sampled]
        self.n = n

    def search(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last suffix rank of every window."""
        length = np.array([len(w) for w in windows])
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        table = np.zeros((len(windows), int(length.max())), np.int64)
        for i, w in enumerate(windows):
            table[i, : len(w)] = w[::-1]             # searched from the last word
        live = np.arange(len(windows))
        for step in range(table.shape[1]):
            live = live[(step < length[live]) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = table[live, step]
            low[live] = self.counts[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.counts[symbol] + self.bwt.rank(symbol, high[live])
            live = np.flatnonzero(low < high)
        return low, np.maximum(low, high)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Positions, in the symbols given, of suffixes by rank."""
        out, moved = np.full(len(ranks), -1, np.int64), np.zeros(len(ranks), np.int64)
        live = np.arange(len(ranks))
        ranks = ranks.copy()
        while len(live):
            at = np.searchsorted(self.sampled, ranks[live])
            hit = (at < len(self.sampled)) & (self.sampled[np.minimum(at, len(self.sampled) - 1)] == ranks[live])
            out[live[hit]] = self.sample[at[hit]] + moved[live[hit]]
            live = live[~hit]
            symbol = self.bwt.access(ranks[live])
            ranks[live] = self.counts[symbol] + self.bwt.rank(symbol, ranks[live])
            moved[live] += 1
        return out


def occurrences(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of every occurrence in a shard of documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.windows) or not len(hashes):
        return none
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    begins = np.zeros(len(hashes), bool)
    begins[first[:-1][first[:-1] < len(hashes)]] = True
    begins[0] = True
    begins[1:] |= ~known[:-1]
    begins &= known
    number = np.cumsum(begins) - 1
    size = np.bincount(number[known], minlength=int(begins.sum()))
    kept = np.flatnonzero(known & (size[number] >= phrases.least)) if len(size) else np.zeros(0, np.int64)
    if not len(kept):
        return none
    run_starts = np.flatnonzero(begins[kept])
    index = FMIndex(at[kept].astype(np.int64) + 1, run_starts, len(phrases.vocabulary))
    low, high = index.search(phrases.windows)
    many = high - low
    window = np.repeat(np.arange(len(many)), many)
    rank = np.repeat(low, many) + np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
    return window, kept[index.locate(rank)]


def _searched(batches: Iterator[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, "text", SHARD_BYTES):
            words = split_words(part.column("text"), NOT_ALNUM, lower=True)
            window, at = occurrences(words.hash, words.first, phrases)
            change = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + phrases.length[window], -1)
            covered = np.cumsum(change) > 0
            items: dict[int, set] = {}
            text = np.searchsorted(words.first, at, "right") - 1
            for t, w in set(zip(text.tolist(), window.tolist(), strict=True)):
                items.setdefault(t, set()).update(phrases.item_of[phrases.item_from[w]: phrases.item_from[w + 1]].tolist())
            spans, found = [], []
            for i, low, high in zip(range(part.num_rows), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                if i not in items:
                    spans.append([])
                    found.append([])
                    continue
                edge = np.flatnonzero(np.diff(covered[low:high].astype(np.int8), prepend=0, append=0))
                spans.append([{"low": int(a), "high": int(b)} for a, b in edge.reshape(-1, 2)])
                found.append(sorted({phrases.ids[x] for x in items[i]}))
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), part.column("text"), pa.array(np.diff(words.first), pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                names=[*keep, "text", "n_words", "spans", "items"])


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Every row of documents (doc_id, text and whatever else) with n_words, the merged word
    spans [low, high) that occur in the benchmark, and the sorted ids of items found."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // (BLOCK_WORDS * 4)
    out = documents
    clash = {"n_words", "spans", "items"} & set(documents.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).distinct().collect()
        phrases = Phrases([r["item"] for r in rows], [r["text"] for r in rows], width)
        names = [c for c in out.columns if c not in ("text", "n_words", "spans", "items")]
        before = ["p_spans", "p_items"] if block else []
        if block:
            out = out.drop("n_words").withColumnsRenamed({"spans": "p_spans", "items": "p_items"})
        schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names),
                            *(["p_spans array<struct<low:bigint,high:bigint>>", "p_items array<string>"] if block else []),
                            "text string, n_words long, spans array<struct<low:bigint,high:bigint>>, items array<string>"])
        out = out.select(*names, *before, "text").mapInArrow(lambda x, p=phrases: released(_searched(x, p)), schema)
        if block:
            out = out.select(*names, "text", "n_words", F.array_sort(F.concat("p_spans", "spans")).alias("spans"),
                             F.array_sort(F.array_union("p_items", "items")).alias("items"))
    if blocks > 1:      # spans of several passes may overlap
        out = out.withColumn("spans", F.expr(
            "aggregate(spans, cast(array() as array<struct<low:bigint,high:bigint>>), (a, s) -> case when size(a) > 0 and "
            "element_at(a, -1).high >= s.low then concat(slice(a, 1, size(a) - 1), array(named_struct('low', element_at(a, -1).low, "
            "'high', greatest(element_at(a, -1).high, s.high)))) else concat(a, array(s)) end)"))
    return out


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, "text", SHARD_BYTES):
            texts, clean = part.column("text").to_pylist(), []
            for text, spans in zip(texts, part.column("spans").to_pylist(), strict=True):
                if spans:
                    words, raw, at, kept = split_words(pa.array([text], pa.string()), NOT_ALNUM, lower=True), text.encode(), 0, []
                    for s in spans:
                        kept.append(raw[at: words.start[s["low"]]])
                        at = words.end[s["high"] - 1]
                    text = b"".join([*kept, raw[at:]]).decode().strip()
                clean.append(text)
            names = [c for c in part.schema.names if c not in ("text", "spans", "items", "n_words")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(clean, pa.string())], names=[*names, "text"])


def decontaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """documents with the covered spans cut out of their texts; those left empty by it go."""
    found = contamination(documents, benchmark, width)
    names = [c for c in documents.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names), "text string, hit boolean"])
    out = found.withColumn("hit", F.size("spans") > 0).select(*names, "hit", "text", "spans").mapInArrow(
        lambda x: released(_without_spans(x)), schema.replace(", hit boolean", "").replace("text string", "hit boolean, text string"))
    return out.filter(~F.col("hit") | (F.length("text") > 0)).select(*documents.columns)
