"""Substring dedup by super-k-mers (operator 3).

A window is a number of consecutive words of one document. Its minimiser is the smallest
hash among its short word runs; consecutive windows with the same minimiser travel as one
packed string to the bucket of that minimiser, so equal windows always meet. A map batch
sends one copy of equal strings and only the places of the others, which are repeats for
certain. In its bucket a sort of all windows by content and place finds the first start of
each window; the others are removed, and their word ranges go back to the documents.

Buckets are sized from the corpus, and their windows are counted first. Where a bucket would
hold more than MOST_WINDOWS, as a frequent line's minimiser brings about, its windows go
by their own hash to buckets of windows instead: equal windows still meet, a map batch sends
one of them, and what is known to be a repeat is dealt by document. Windows are compared by
128-bit hash.

Defined cases: null, empty and wordless texts have no words and hash the empty string; texts
shorter than a window lose nothing; rows that repeat a doc_id are one document, so a window
at the same place of both is no repeat, and both lose the same word positions; a row without
doc_id takes no part and keeps every word. An empty table gives an empty result. Other
columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.words import Words, grams, mix, released, split_words
from answerlake.llm.words import pieces as cut

WINDOW = 20
RUN = 4
MAP_BYTES = 3 << 20
BUCKET_BYTES = 4 << 20
MOST_WINDOWS = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window, from a polynomial over word hashes."""
    out = []
    for base, seed in ((0xA0761D6478BD642F, 0x589965CC75374CC3), (0xE7037ED1A0B428DB, 0x1D8E4E27C47D124F)):
        total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        coded = mix(words ^ np.uint64(seed))
        for i in range(width):
            total *= np.uint64(base)
            total += coded[i: i + len(total)]
        out.append(mix(total))
    return out[0], out[1]


def _inside(first: np.ndarray, count: int, width: int) -> np.ndarray:
    """Whether the window at each word lies within one text."""
    starts = np.arange(max(count - width + 1, 0))
    return np.searchsorted(first, starts, "right") == np.searchsorted(first, starts + width - 1, "right")


def _later(order: np.ndarray, content: tuple, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether equal content also stands at an earlier place; order sorts by content and place."""
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in content])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return out


def _minimisers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and minimiser of every window."""
    if len(words.hash) < WINDOW:
        return np.zeros(0, np.int64), words.hash[:0]
    good = np.flatnonzero(_inside(words.first, len(words.hash), WINDOW))
    return good, sliding_min(grams(words.hash, RUN), WINDOW - RUN + 1)[good]


def _loads(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of a task by bucket."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for part in cut(batch, "text", MAP_BYTES):
            _, minimiser = _minimisers(split_words(part.column("text")))
            total += np.bincount((mix(minimiser) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _windows(words: Words, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start, hash, hash) of the windows of strings, one of each content, and the (doc, start) of the others."""
    many = size - WINDOW + 1
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc, start = np.repeat(doc, many), np.repeat(start, many) + offset
    one, two = (h[np.repeat(begin, many) + offset] for h in window_hashes(words.hash, WINDOW))
    repeat = _later(np.lexsort((start, doc, two, one)), (one, two), doc, start)
    head = np.stack([doc, start, one.view(np.int64), two.view(np.int64)])
    return head[:, ~repeat], head[:2, repeat]


def _dealt(bucket: np.ndarray):
    """(bucket, places) of equal buckets."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    return ((int(bucket[order[i]]), order[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True))


def _sent(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray, more: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of each batch, one compressed row for each bucket. The windows of hot
    buckets go to `more` buckets of windows, which come after the others."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in cut(batch, "text", MAP_BYTES):
            docs = part.column("doc_id").to_numpy(zero_copy_only=False)
            words = split_words(part.column("text"))
            good, minimiser = _minimisers(words)
            if not len(good):
                continue
            text = np.searchsorted(words.first, good, "right") - 1
            new = np.ones(len(good), bool)
            new[1:] = (minimiser[1:] != minimiser[:-1]) | (good[1:] != good[:-1] + 1) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            begin, last = good[at], good[np.append(at[1:], len(good)) - 1] + WINDOW
            key, text = minimiser[at], text[at]
            doc, start = docs[text], begin - words.first[text]
            # equal strings of the batch: the first by (doc, start) is sent, the rest are known repeats
            chain = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash + np.uint64(7)) * _odd(len(words.hash)))])
            content = mix((chain[last] - chain[begin]) * _inverse(begin)) ^ mix((last - begin).astype(np.uint64))
            second = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash ^ np.uint64(0x5DEECE66D)) * _odd(len(words.hash)))])
            content2 = mix((second[last] - second[begin]) * _inverse(begin))
            order = np.lexsort((start, doc, content2, content))
            repeat = _later(order, (content, content2), doc, start)
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            size, many = last - begin, np.isin(bucket, hot)
            out_bucket, out_head, out_body = [], [], []
            if many.any():
                fresh = np.flatnonzero(many & ~repeat)
                found, again = _windows(words, begin[fresh], size[fresh], doc[fresh], start[fresh])
                for b, here in _dealt(buckets + (found[2].view(np.uint64) % np.uint64(more)).astype(np.int64)):
                    out_bucket.append(b)
                    out_head.append(pack.compress(np.ascontiguousarray(found[:, here]).tobytes()))
                    out_body.append(b"")
                old = np.flatnonzero(many & repeat)
                again = np.concatenate([np.stack([doc[old], start[old], size[old]]), np.stack([*again, np.full(again.shape[1], WINDOW)])], 1)
                for b, here in _dealt((mix(again[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
                    out_bucket.append(b)
                    out_head.append(pack.compress(np.concatenate([again[:, here], np.zeros((1, len(here)), np.int64)]).tobytes()))
                    out_body.append(pack.compress(b""))
            order = np.lexsort((key, bucket))
            order = order[~many[order]]
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            view = memoryview(words.data)
            low, high = words.start[begin], words.end[last - 1]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                here = order[i:j]
                sent = here[~repeat[here]]
                head = np.stack([doc[here], start[here], last[here] - begin[here],
                                 np.where(repeat[here], 0, 1)]).astype(np.int64)
                body = b" ".join([view[x:y] for x, y in zip(low[sent], high[sent], strict=True)])
                out_bucket.append(int(bucket[here[0]]))
                out_head.append(pack.compress(head.tobytes()))
                out_body.append(pack.compress(body))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_bucket, pa.int64()), pa.array(out_head, pa.binary()), pa.array(out_body, pa.binary())],
                names=["bucket", "head", "body"])


_ODD = np.uint64(0xD1342543DE82EF95)
_ODD_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _odd(n: int) -> np.ndarray:
    return _powers(_ODD, n)


def _inverse(at: np.ndarray) -> np.ndarray:
    return _powers(_ODD_INVERSE, int(at.max()) + 1)[at]


def _counted(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Repeated word ranges of one bucket."""
    unpack = zstandard.ZstdDecompressor()
    heads = [np.frombuffer(unpack.decompress(h), np.int64).reshape(4, -1) for h, _ in rows]
    bodies = [unpack.decompress(b) for _, b in rows]
    head = np.concatenate(heads, 1)
    out = [head[:3, head[3] == 0]]
    doc, start, size, _ = head[:, head[3] == 1]
    if len(doc):
        out.append(_later_ranges(doc, start, size, bodies))
    doc, start, size = np.concatenate(out, 1)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(start + size, pa.int64())],
                                      names=["doc_id", "low", "high"])


def _later_ranges(doc: np.ndarray, start: np.ndarray, size: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """doc, start, size of word ranges covered by windows of packed strings that also stand earlier."""
    words = split_words(pa.array([b" ".join([x for x in bodies if x])], pa.large_binary())).hash
    base = np.concatenate([[0], np.cumsum(size)])
    if base[-1] != len(words):
        raise ValueError("packed strings and their sizes differ")
    one, two = window_hashes(words, WINDOW)
    many = size - WINDOW + 1
    owner = np.repeat(np.arange(len(size)), many)
    offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    at = base[owner] + offset
    one, two = one[at], two[at]
    whose, where = doc[owner], start[owner] + offset
    order = np.lexsort((where, whose, two, one))
    found = np.flatnonzero(_later(order, (one, two), whose, where))
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
    i = np.flatnonzero(new)
    low, high = found[i], found[np.append(i[1:], len(found)) - 1] if len(found) else found
    return np.stack([whose[low], where[low], where[high] - where[low] + WINDOW])


def _counted_windows(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Repeated word ranges of one bucket of windows."""
    unpack = zstandard.ZstdDecompressor()
    doc, start, one, two = np.concatenate([np.frombuffer(unpack.decompress(h), np.int64).reshape(4, -1) for h, _ in rows], 1)
    found = _later(np.lexsort((start, doc, two, one)), (one, two), doc, start)
    return pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(start[found]), pa.array(start[found] + WINDOW)], names=["doc_id", "low", "high"])


def _buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held, last = [], None
    for batch in batches:
        for key, head, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "head", "body")), strict=True):
            if key != last and held:
                yield _counted(held) if last < buckets else _counted_windows(held)
                held = []
            last = key
            held.append((head, body))
    if held:
        yield _counted(held) if last < buckets else _counted_windows(held)


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """bucket, head, body of the strings and windows to compare, and the number of buckets of strings."""
    buckets = 1 + 3 * size // BUCKET_BYTES
    loads = rows.select("text").mapInArrow(lambda x: released(_loads(x, buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    hot = loads.filter(F.col("n") > MOST_WINDOWS).collect()      # no more than one for each MOST_WINDOWS words of the corpus
    more = 1 + 3 * sum(r["n"] for r in hot) // MOST_WINDOWS
    hot = np.array([r["bucket"] for r in hot], np.int64)
    return rows.mapInArrow(lambda x: released(_sent(x, buckets, hot, more)), "bucket long, head binary, body binary"), buckets


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """doc_id, low, high: word ranges covered by windows that also start earlier."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and doc_id is not null")
    sent, buckets = packed(rows, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(lambda x: released(_buckets(x, buckets)), "doc_id long, low long, high long")


def _kept(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, "text", MAP_BYTES):
            words = split_words(part.column("text"))
            view = memoryview(words.data)
            keep = np.ones(len(words.hash), bool)
            for base, ranges in zip(words.first[:-1], part.column("ranges").to_pylist(), strict=True):
                for r in ranges or ():
                    keep[base + r["low"]: base + r["high"]] = False
            kept, removed, count = [], [], []
            for low, high in zip(words.first[:-1], words.first[1:], strict=True):
                index = np.flatnonzero(keep[low:high]) + low
                kept.append(b" ".join([view[x:y] for x, y in zip(words.start[index].tolist(), words.end[index].tolist(), strict=True)]))
                count.append(high - low)
                removed.append(high - low - len(index))
            more = {"n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            if digest:
                more["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            else:
                more["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([more[n] if n in more else part.column("text" if n == "_text" else n) for n in schema.names], schema=schema)


def without_repeats(documents: DataFrame, columns: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The named columns of every document with n_words, n_removed and its kept text `kept`
    (kept words joined by one space), or with its SHA-256 `kept_sha256` if digest."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    ranges = repeated_ranges(documents).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    columns = tuple(columns)
    rows = documents.select(F.col("doc_id").cast("long").alias("_key"), F.col("text"),
                            *[F.col(c).alias(f"_{c}") for c in columns if c != "text"])
    joined = rows.join(ranges.withColumnRenamed("doc_id", "_key"), "_key", "left")
    schema = StructType()
    for c in columns:
        schema = schema.add(f"_{c}", documents.schema[c].dataType)
    schema = schema.add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256" if digest else "kept", StringType())
    arrow = to_arrow_schema(schema)
    out = joined.select("text", "ranges", *[f"_{c}" for c in columns if c != "text"]).mapInArrow(lambda x: released(_kept(x, arrow, digest)), schema)
    return out.select(*[F.col(f"_{c}").alias(c) for c in columns], *out.columns[len(columns):])
