"""From documents to an index: chunks, postings, statistics and vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions import text as x
from answerlake.functions.vocabulary import NEUTRAL, Vocabulary
from answerlake.session import spread

# The heading rule and the window sizes of the default chunker.
SECTION_HEADING = r"Section\s+\d+\s*:[^\n]*"
WINDOW_WORDS, WINDOW_OVERLAP = 500, 50
HASHED_DIMENSIONS = 1536
#: Words whose place an encoding task remembers; the others are hashed again.
WORDS_HELD = 100_000


def sections(text: Column, doc_id: Column, heading: str = SECTION_HEADING) -> Column:
    """Array of (title, heading, body): text is cut before every line that is a heading.

    The first line in front of the first heading is the title and the rest of it an
    introduction; sections without a body are dropped; a text without headings is
    one section named after the document.
    """
    starts = rf"(?i)^(?:{heading})(?:\n|$)"

    def first_line(p: Column) -> Column:
        return x.strip(F.substring_index(p, "\n", 1))

    def rest(p: Column) -> Column:
        cut = F.locate("\n", p)
        return F.when(cut > 0, x.strip(p.substr(cut + 1, F.length(p)))).otherwise("")

    def entry(title: Column, name: Column, body: Column) -> Column:
        return F.struct(title.alias("doc_title"), name.alias("section"), body.alias("body"))

    def headed(parts: Column, preamble: Column, title: Column) -> Column:
        found = F.filter(parts, lambda p: p.rlike(starts))
        named = F.transform(found, lambda p: entry(title, first_line(p), rest(p)))
        return F.filter(F.concat(F.array(entry(title, title, rest(preamble))), named),
                        lambda s: F.length(s["body"]) > 0)

    def with_title(parts: Column) -> Column:
        intro = F.when(F.get(parts, F.lit(0)).rlike(starts), F.lit("")).otherwise(F.get(parts, F.lit(0)))
        return x.let(intro, lambda preamble: headed(
            parts, preamble, F.when(F.length(preamble) > 0, first_line(preamble)).otherwise(doc_id)))

    def cut(whole: Column) -> Column:
        plain = F.array(entry(doc_id, doc_id, whole))
        parts = F.filter(F.transform(F.split(whole, rf"(?im)(?=^(?:{heading})$)"), lambda p: x.strip(p)), lambda p: F.length(p) > 0)
        return F.when(F.length(whole) == 0, F.slice(plain, 1, 0)).otherwise(x.let(parts, lambda found: F.when(
            F.exists(found, lambda p: p.rlike(starts)), with_title(found)).otherwise(plain)))

    return x.let(x.strip(text), cut)


def chunk(docs: DataFrame, heading: str = SECTION_HEADING, size: int = WINDOW_WORDS,
          overlap: int = WINDOW_OVERLAP, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """Section-aware word windows, numbered through the document, without a shuffle."""
    docs = spread(docs)
    name = F.col("doc_id").cast("string")
    cut = sections(F.col("text"), name, heading)
    windows = F.flatten(F.transform(cut, lambda s: F.transform(
        x.word_windows(s["body"], size, overlap),
        lambda w: F.struct(s["doc_title"].alias("doc_title"), s["section"].alias("section"), w.alias("text")))))
    return (
        docs.select("doc_id", *keep, F.posexplode(windows).alias("chunk_no", "w"))
        .select(
            F.concat_ws("::", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"),
            "doc_id", "chunk_no", *keep, "w.doc_title", "w.section", "w.text",
            F.concat_ws(" ", "w.doc_title", "w.section", "w.text").alias("search_text"))
    )


def knowledge_base(chunks: DataFrame) -> DataFrame:
    """Consecutive chunks of one section joined again, in document order.

    The island number is a running count of heading changes inside the document;
    documents are bounded by their own text, so the windows stay small.
    """
    from pyspark.sql import Window as W
    order = W.partitionBy("doc_id").orderBy("chunk_no")
    changed = F.coalesce((F.lag("section").over(order) != F.col("section")).cast("int"), F.lit(1))
    marked = chunks.withColumn("changed", changed).withColumn("island", F.sum("changed").over(order))
    grouped = marked.groupBy("doc_id", "island").agg(
        F.min_by("section", "chunk_no").alias("section"),
        F.count(F.lit(1)).alias("chunks"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("parts"))
    return grouped.select("doc_id", "island", "section", "chunks",
                          F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def index_stats(chunks: DataFrame, vector: str | None = None) -> DataFrame:
    """Documents, chunks and vector width per provenance and overall (``all``)."""
    width = F.max(F.size(vector)) if vector else F.lit(None).cast("int")
    return chunks.groupingSets([("source",), ()], "source").agg(
        F.grouping_id().alias("level"), F.countDistinct("doc_id").alias("documents"),
        F.count(F.lit(1)).alias("chunks"), width.alias("dimensions"),
    ).select(F.when(F.col("level") == 1, "all").otherwise(F.col("source")).alias("source"),
             "documents", "chunks", "dimensions")


def term_table(chunks: DataFrame, vocab: Vocabulary = NEUTRAL, text: str = "search_text",
               ident: str = "chunk_id") -> DataFrame:
    """One row per chunk: (ident, doc_len, counts of its terms), counted where the chunk lies."""
    tokens = chunks.select(ident, x.tokenize(F.col(text), vocab).alias("tokens"))
    return tokens.select(ident, F.size("tokens").cast("bigint").alias("doc_len"),
                         x.term_counts(F.col("tokens")).alias("counts"))


def build_postings(terms: DataFrame, ident: str = "chunk_id", colocated: bool = False) -> DataFrame:
    """Inverted index rows (ident, term, tf, doc_len) of a term table.

    The one exchange moves the compact counted rows and puts a chunk's postings
    together, so that sums per (question, chunk) afterwards stay in place. A term
    table stored with ``bucketBy(n, ident)`` is ``colocated`` already and skips it.
    """
    placed = terms if colocated else terms.repartition(ident)
    return placed.select(ident, "doc_len", F.inline("counts")).select(
        ident, "term", F.col("tf").cast("bigint").alias("tf"), "doc_len")


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean token count."""
    return terms.agg(F.count(F.lit(1)).alias("chunks"), F.avg("doc_len").alias("avg_len"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(docs: DataFrame, vocab: Vocabulary = NEUTRAL, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.array_distinct(x.tokenize(F.col(text), vocab))).alias("term")).distinct()


def hashed_embedding(df: DataFrame, ident: str, text: str, dims: int = HASHED_DIMENSIONS) -> DataFrame:
    """Feature-hashed unit vectors as sparse rows (ident, bucket, weight)."""
    said = df.select(ident, F.explode(x.extract_all(F.lower(text), "[a-zA-Z0-9']+")).alias("word"))
    code = F.sha2("word", 256)
    bucket = F.conv(F.substring(code, 1, 8), 16, 10).cast("bigint") % dims
    sign = F.when(F.conv(F.substring(code, 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    raw = said.groupBy(ident, bucket.alias("bucket")).agg(F.sum(sign).alias("raw")).filter("raw <> 0")
    norm = raw.groupBy(ident).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, ident).select(ident, "bucket", (F.col("raw") / F.col("norm")).alias("weight"))


def hashed_encoder(dims: int = HASHED_DIMENSIONS):
    """The same vectors as a dense Arrow UDF column, computed where the text lies."""

    class Places(dict):
        """Twice the bucket of a word, and one more where its sign is minus."""

        def __missing__(self, word: str) -> int:
            code = hashlib.sha256(word.encode()).hexdigest()
            hit = 2 * (int(code[:8], 16) % dims) + int(code[8], 16) % 2
            if len(self) < WORDS_HELD:
                self[word] = hit
            return hit

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re
        words, seen = re.compile("[a-zA-Z0-9']+"), Places()
        for batch in batches:
            out = []
            for text in batch:
                found = words.findall((text or "").lower())
                many = np.bincount(np.fromiter(map(seen.__getitem__, found), dtype=np.int64, count=len(found)), minlength=2 * dims)
                vec = (many[::2] - many[1::2]).astype(float)
                out.append(vec / (np.sqrt((vec * vec).sum()) or 1.0))
            yield pd.Series(out)

    return encode


def embed(df: DataFrame, text: str, encoder=None, dims: int = HASHED_DIMENSIONS) -> DataFrame:
    """Adds ``embedding`` and ``encoder``: the given Arrow UDF, or the hashed floor,
    which is reported so that nobody mistakes it for a trained encoder."""
    if encoder is None:
        return df.withColumns({"embedding": hashed_encoder(dims)(F.col(text)), "encoder": F.lit(f"hashed-{dims}")})
    return df.withColumns({"embedding": encoder(F.col(text)), "encoder": F.lit("supplied")})


def index_is_stale(chunks: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """One row: how many stored vectors do not have the active encoder's width."""
    wrong = F.coalesce(F.size(vector), F.lit(0)) != dims
    return chunks.agg(F.sum(wrong.cast("int")).cast("bigint").alias("stale_vectors"),
                      F.count(F.lit(1)).alias("vectors"), F.bool_or(wrong).alias("stale"))
