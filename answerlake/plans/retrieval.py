"""Batch retrieval: a table of questions against a corpus index."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions import text as x
from answerlake.functions.vocabulary import NEUTRAL, Vocabulary
from answerlake.plans import scoring
from answerlake.plans.blocks import Grid
from answerlake.session import settle, small_side

POOL = 15


# ---------------------------------------------------------------- lexical side

def question_terms(questions: DataFrame, vocab: Vocabulary = NEUTRAL) -> DataFrame:
    """(query_id, term, qtf): expanded tokens with their multiplicity."""
    words = questions.select("query_id", F.explode(x.expand(x.tokenize(F.col("text"), vocab), vocab)).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(questions: DataFrame, terms: DataFrame, stats: DataFrame, vocab: Vocabulary = NEUTRAL,
         k1: float = 1.5, b: float = 0.75, ident: str = "chunk_id") -> DataFrame:
    """(query_id, ident, lexical) for every pair that shares a term, from a term table.

    A chunk's counts lie in one row, so where the weighted terms are small enough to be
    broadcast a pair's sum is complete before the one exchange. They are settled once.
    """
    asked = small_side(question_terms(questions, vocab))
    postings = terms.select(ident, "doc_len", F.inline("counts"))
    df = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    n, avg = stats.select("chunks").scalar(), stats.select("avg_len").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weighted = small_side(asked.join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")))
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (
        F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avg))
    return postings.join(weighted, "term").groupBy("query_id", ident).agg(F.sum(part).alias("lexical"))


def top_k(scored: DataFrame, k: int, score: str, ties: Sequence[str]) -> DataFrame:
    """Best k per question in a total order; Spark prunes to k per task before the exchange."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def minmax_over(scored: DataFrame, column: str, total: Column | None = None, key: str = "query_id",
                out: str = "normalised") -> DataFrame:
    """Min-max per question; when ``total`` says more rows exist than are present, the
    absent ones count as 0. The extremes are an aggregate joined back, not a window,
    so one huge group is still reduced inside every task first."""
    ends = scored.groupBy(key).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))
    if total is not None:
        ends = ends.withColumns({
            "lo": F.when(F.col("n") < total, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")),
            "hi": F.when(F.col("n") < total, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))})
    span = F.col("hi") - F.col("lo")
    return scored.join(ends.drop("n"), key).withColumn(
        out, F.when(span < 1e-9, 0.0).otherwise((F.col(column) - F.col("lo")) / span)).drop("lo", "hi")


# ------------------------------------------------------------------ dense side

def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int,
                query_vector: str = "embedding", vector: str = "embedding") -> DataFrame:
    """Best k vectors per query by cosine over all pairs, as block products. ``queries`` has
    (query_id, vector), ``vectors`` (vec_id, vector); a pair of blocks gives k rows per query."""
    asked = queries.select("query_id", F.col(query_vector).cast("array<double>").alias("embedding"))
    held = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("embedding"))
    grid = Grid.over(asked)
    kinds = asked.schema["query_id"].dataType.simpleString(), held.schema["vec_id"].dataType.simpleString()
    found = grid.meet(grid.deal(held), asked, scoring.nearest(k), "query_id {}, vec_id {}, dense double".format(*kinds))
    return top_k(found, k, "dense", ["vec_id"])


# --------------------------------------------------------------- hybrid search

@dataclass(frozen=True)
class SearchConfig:
    vocab: Vocabulary = NEUTRAL
    k: int = 4
    lam: float = 0.8
    dims: int = 64
    encoder: object = None
    fusion: float = 0.0
    same_doc_base: float = 0.6
    same_doc_step: float = 0.3
    use_places: bool = False
    route_words: str | None = None
    query_kind: Callable[[Column], Column] | None = None
    chunk_kind: Callable[[DataFrame], Column] | None = None
    # (question test, chunk test) pairs: both true means a neighbouring topic
    topic_rules: tuple[tuple[Callable[[Column], Column], Callable[[DataFrame], Column]], ...] = ()
    settings: scoring.Settings = field(default_factory=scoring.Settings)

    def with_(self, **changes) -> SearchConfig:
        return replace(self, **changes)


def chunk_features(index: DataFrame, cfg: SearchConfig) -> DataFrame:
    """What a task needs to score a chunk: tokens, heading words, vector, places, kind."""
    vocab = cfg.vocab
    heading = F.concat_ws(" ", "section", "doc_title")
    kind = cfg.chunk_kind(index) if cfg.chunk_kind else F.lit(None).cast("string")
    flags = F.array(*[test(index).cast("double") for _, test in cfg.topic_rules]) if cfg.topic_rules else \
        F.array().cast("array<double>")
    return index.select(
        "chunk_id", "doc_id", F.col("chunk_no").cast("int").alias("chunk_no"),
        x.tokenize(F.col("search_text"), vocab).alias("tokens"),
        F.array_distinct(x.expand(x.tokenize(heading, vocab), vocab)).alias("heading_tokens"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (x.places_in(F.col("text"), vocab) if cfg.use_places else x.word_set(())).alias("places"),
        kind.alias("kind"), flags.alias("topic_flags"))


def _question_features(questions: DataFrame, cfg: SearchConfig) -> DataFrame:
    from answerlake.plans.corpus import embed
    vocab, text = cfg.vocab, F.col("text")
    base = questions.select("query_id", "text")
    if cfg.fusion > 0:
        base = base.select("query_id", F.posexplode(x.subqueries(text, vocab)).alias("part", "text"))
    else:
        base = base.withColumn("part", F.lit(0))
    kind = cfg.query_kind(text) if cfg.query_kind else F.lit(None).cast("string")
    flags = F.array(*[test(text).cast("double") for test, _ in cfg.topic_rules]) if cfg.topic_rules else \
        F.array().cast("array<double>")
    asked = x.places_in(text, vocab) if cfg.use_places else x.word_set(())
    route = text.rlike(cfg.route_words) if cfg.route_words else F.lit(False)
    return embed(base, "text", cfg.encoder, cfg.dims).select(
        "query_id", "part", "text", x.expand(x.tokenize(text, vocab), vocab).alias("tokens"),
        "embedding", kind.alias("kind"), flags.alias("flags"), asked.alias("places"), route.alias("route_words"))


def _weighted(asked: DataFrame, grid: Grid, dealt: DataFrame, chunks: int) -> DataFrame:
    """Adds weights: each question's terms with their count and inverse document frequency."""
    key = ["query_id", "part"]
    said = asked.select(*key, F.inline(x.term_counts(F.col("tokens"))))
    df = grid.meet(dealt, said.select("term").distinct(), scoring.holders, scoring.HOLDERS_SCHEMA, "term").groupBy("term").agg(
        F.sum("df").alias("df"))
    idf = F.coalesce(F.log((chunks - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), F.lit(0.0))
    weights = said.join(df, "term", "left").groupBy(*key).agg(
        F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"), idf.alias("idf"))).alias("weights"))
    none = F.array().cast("array<struct<term:string,tf:int,idf:double>>")
    return asked.drop("tokens").join(weights, key, "left").withColumn("weights", F.coalesce("weights", none))


def candidate_pool(questions: DataFrame, index: DataFrame, cfg: SearchConfig, pool: int = POOL,
                   grid: Grid | None = None) -> DataFrame:
    """The ``pool`` best chunks of every question with all score parts.

    Groups of questions meet blocks of chunks four times: for document frequencies, for the score
    ranges, for the best scores where parts are fused, and for the candidates. The index is read
    once; what scoring needs of it is stored in blocks where its rows lie. However many questions
    there are, the jobs are the same. Pass a stored table of ``chunk_features`` as the index to
    skip computing them here.
    """
    features = index if "heading_tokens" in index.columns else chunk_features(index, cfg)
    grid = grid or Grid.over(questions)
    dealt = grid.deal(features, scoring.compact, scoring.MEASURES)
    total = dealt.agg(*[F.sum(c).alias(c) for c in scoring.MEASURES]).first()
    chunks, avg_len = total["n"] or 0, (total["words"] / total["sized"] if total["sized"] else 0.0) or 1.0
    kind = questions.schema["query_id"].dataType.simpleString()
    settings = replace(cfg.settings, avg_len=avg_len, pool=pool, fusion=cfg.fusion)
    covers, aliases, cities = (cfg.vocab.places if cfg.use_places else None), cfg.vocab.aliases, cfg.vocab.cities

    def prepared(right: pa.Table) -> tuple[pa.Table, scoring.QuestionBlock]:
        return right.slice(0, 0), scoring.QuestionBlock.of(right, covers, aliases, cities)

    def met(asked: DataFrame, function, schema: str) -> DataFrame:
        return grid.meet(dealt, asked, lambda block, ready: function(block, *ready, settings), schema, prepare=prepared)

    asked = settle(_weighted(_question_features(questions, cfg), grid, dealt, chunks))
    key = ["query_id", "part"]
    ends = met(asked, scoring.extremes, scoring.EXTREMES_SCHEMA.format(id=kind)).groupBy(*key).agg(
        F.min("lex_lo").alias("lex_lo"), F.max("lex_hi").alias("lex_hi"), F.min("dense_lo").alias("dense_lo"), F.max("dense_hi").alias("dense_hi"))
    asked = asked.join(ends, key)
    if cfg.fusion > 0:
        asked = settle(asked)
        best = met(asked, scoring.best_scores, scoring.BEST_SCHEMA.format(id=kind)).groupBy(*key).agg(F.max("best").alias("best"))
        asked = asked.join(best, key)
    found = met(asked, scoring.candidates, scoring.CANDIDATE_SCHEMA.format(id=kind, doc=features.schema["doc_id"].dataType.simpleString()))
    return top_k(found, pool, "score", ["doc_id", "chunk_no"])


def mmr(pool: DataFrame, k: int = 4, lam: float = 0.8, base: float = 0.6, step: float = 0.3,
        stale: bool = False) -> DataFrame:
    """Greedy diverse selection per question from its ranked pool (with ``embedding``).
    A pool holds at most a few rows per question, so a group always fits a task."""
    schema = T.StructType([f for f in pool.schema.fields if f.name not in ("rank", "embedding")]
                          + [T.StructField("rank", T.IntegerType())])
    names = schema.names

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("rank").reset_index(drop=True).head(max(k, POOL))
        chosen = ordered.iloc[scoring.select_diverse(ordered, k, lam, base, step, stale)].copy()
        chosen["rank"] = np.arange(1, len(chosen) + 1, dtype="int32")
        return chosen[names]

    return pool.groupBy("query_id").applyInPandas(pick, schema)


def drop_unmatched(hits: DataFrame) -> DataFrame:
    """Once the first hit shares a word with the question, hits that share none go."""
    # A group is one question's k hits.
    order = W.partitionBy("query_id").orderBy("rank")
    strict = F.first("lexical_score").over(order) > 0
    kept = hits.withColumn("strict", strict).filter(~F.col("strict") | (F.col("lexical_score") > 0)).drop("strict")
    return kept.withColumn("rank", F.row_number().over(order))


def with_vectors(pool: DataFrame, index: DataFrame) -> DataFrame:
    return index.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).join(
        small_side(pool), "chunk_id")


def search(questions: DataFrame, index: DataFrame, cfg: SearchConfig) -> DataFrame:
    """End to end: blended, boosted, penalised, diversified top k per question."""
    pool = settle(candidate_pool(questions, index, cfg, max(cfg.k, POOL)))
    chosen = mmr(with_vectors(pool, index), cfg.k, cfg.lam, cfg.same_doc_base, cfg.same_doc_step)
    return drop_unmatched(chosen)


def with_chunks(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with the text they point at (a hit table is k rows per question)."""
    return index.select("chunk_id", "source", "doc_title", "section", "text", "search_text").join(
        small_side(hits), "chunk_id")


def sweep(pool: DataFrame, index: DataFrame, ks: Sequence[int], lams: Sequence[float],
          base: float = 0.6, step: float = 0.3) -> DataFrame:
    """Every (k, lambda) selection from the same pool, in one pass over the pools."""
    fields = [T.StructField("k", T.IntegerType()), T.StructField("lam", T.DoubleType()),
              pool.schema["query_id"], T.StructField("rank", T.IntegerType()), pool.schema["chunk_id"],
              pool.schema["doc_id"], T.StructField("dense_score", T.DoubleType())]
    grid = [(k, lam) for k in ks for lam in lams]

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("rank").reset_index(drop=True)
        parts = []
        for k, lam in grid:
            cut = ordered.head(max(k, POOL))
            chosen = cut.iloc[scoring.select_diverse(cut, k, lam, base, step)]
            parts.append(pd.DataFrame({
                "k": np.int32(k), "lam": float(lam), "query_id": chosen["query_id"],
                "rank": np.arange(1, len(chosen) + 1, dtype="int32"), "chunk_id": chosen["chunk_id"],
                "doc_id": chosen["doc_id"], "dense_score": chosen["dense_score"]}))
        return pd.concat(parts)

    return with_vectors(pool, index).groupBy("query_id").applyInPandas(pick, T.StructType(fields))


# ----------------------------------------------------------------- evaluation

def recall_at_k(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: questions, any-hit and all-hit rates, all-hit rate of questions with
    several gold documents, mean first dense score. ``gold`` is (query_id, doc_id)."""
    wanted = gold.select("query_id", "doc_id").distinct()
    got = hits.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    per = wanted.join(got, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"))
    every = F.when(F.col("found") == F.col("gold"), 1.0).otherwise(0.0)
    top = hits.filter("rank = 1").agg(F.round(F.avg("dense_score"), 4).alias("top")).scalar()
    return per.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)), 4).alias("any_hit"),
        F.round(F.avg(every), 4).alias("all_hit"),
        F.round(F.avg(F.when(F.col("gold") > 1, every)), 4).alias("multi_all_hit"),
    ).withColumn("mean_top_dense", top)


def compare_runs(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """Questions whose count of gold documents found rose or fell between two runs."""
    wanted = gold.select("query_id", "doc_id").distinct()

    def covered(hits: DataFrame, name: str) -> DataFrame:
        return hits.select("query_id", "doc_id").distinct().join(wanted, ["query_id", "doc_id"], "left_semi").groupBy(
            "query_id").agg(F.count(F.lit(1)).alias(name))

    both = covered(before, "was").join(covered(after, "now"), "query_id", "full_outer").select(
        "query_id", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.withColumn("change", F.when(F.col("now") > F.col("was"), "gained")
                           .when(F.col("now") < F.col("was"), "lost").otherwise("same"))


def grounding_guard(questions: DataFrame, hits: DataFrame, vocabulary: DataFrame, vocab: Vocabulary = NEUTRAL,
                    min_share: float = 0.5, borderline: float = 0.33) -> DataFrame:
    """Whether the retrieved text may answer each question.

    ``hits`` carries search_text and dense_score; ``vocabulary`` is the corpus word
    table. Subject words known to the corpus are evidence; too little evidence, only
    vague evidence, or evidence the retrieved text does not contain means no.
    """
    words = questions.select("query_id", F.explode(F.array_distinct(
        x.topical(x.tokenize(F.col("text"), vocab), vocab))).alias("word"))
    forms = words.select("query_id", "word", F.explode(F.array_distinct(x.expand(F.array("word"), vocab))).alias("term"))
    # The question side is small: keep the big vocabulary where it is.
    known = vocabulary.join(small_side(forms.select("term").distinct()), "term", "left_semi").withColumn("known", F.lit(1))
    retrieved = hits.select("query_id", F.explode(F.array_distinct(x.tokenize(F.col("search_text"), vocab))).alias("term")
                            ).distinct().withColumn("shown", F.lit(1))
    per_word = forms.join(known, "term", "left").join(retrieved, ["query_id", "term"], "left").groupBy(
        "query_id", "word").agg((F.count("known") > 0).alias("evidence"), (F.count("shown") > 0).alias("shown"))
    vague = F.col("word").isin(*vocab.vague_words)
    per = per_word.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("topical"),
        F.sum(F.col("evidence").cast("int")).alias("evidence"),
        F.sum((~vague).cast("int")).alias("subject"),
        F.sum((~vague & F.col("evidence")).cast("int")).alias("subject_evidence"),
        F.sum((F.col("evidence") & F.col("shown")).cast("int")).alias("supported"))
    best = hits.groupBy("query_id").agg(F.max("dense_score").alias("best_dense"))
    joined = questions.select("query_id").join(per, "query_id", "left").join(best, "query_id", "left").fillna(
        0, ["topical", "evidence", "subject", "subject_evidence", "supported", "best_dense"])
    share = F.when(F.col("evidence") > 0, F.col("evidence") / F.col("topical")).otherwise(0.0)
    grounded = (
        ~((F.col("subject") > 0) & (F.col("subject_evidence") == 0)) & (share >= min_share)
        & ~((share <= min_share) & (F.col("topical") > 1) & (F.col("best_dense") < borderline))
        & (F.col("supported") / F.greatest(F.col("evidence"), F.lit(1)) >= min_share) & (F.col("evidence") > 0))
    return joined.select("query_id", F.col("topical").cast("bigint").alias("topical"),
                         F.col("evidence").cast("bigint").alias("evidence"),
                         F.col("supported").cast("bigint").alias("supported"), grounded.alias("grounded"))
