"""From raw documents to packed training sequences, in five written stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. `docs` has
the columns of `documents`; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm.decontaminate import decontaminated
from answerlake.llm.jaccard import jaccard_components
from answerlake.llm.packing import best_two_fit
from answerlake.llm.queries import TOXIC_FROM, fold, table
from answerlake.llm.shared import written
from answerlake.llm.substrings import without_repeats
from answerlake.llm.toxicity import learn_grammar, scored

PACKED_WITH, END_ID = "byte_bpe_50k.json", 2


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    if "n_chars" in columns and "text" in columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.length("text").cast(kind))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM; null and empty texts stay. The grammar learns from
    the labelled rows that its query may learn from."""
    grammar = learn_grammar(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    name = "toxic_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, grammar, name).filter(F.col(name) < TOXIC_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-shingles at a Jaccard similarity of 0.8 the document with
    the smallest doc_id; rows that repeat both doc_id and text stay once. Empty texts stay."""
    found = jaccard_components(docs, n=5, percent=80)
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier (kept words joined
    by one space); an untouched text stays as it is, a document of repeats alone goes."""
    found = without_repeats(docs.select(*[F.col(c).alias(f"c{i}" if c not in ("doc_id", "text") else c) for i, c in enumerate(docs.columns)]),
                            tuple(f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)))
    found = found.filter("n_removed = 0 or n_removed < n_words").withColumn(
        "text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).drop("kept", "n_words", "n_removed")
    return _counted(found.toDF(*docs.columns), docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in the benchmark; a document of those alone goes."""
    plain = docs.toDF(*[f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)])
    return _counted(decontaminated(plain, table(spark, sf_dir, "benchmark")).toDF(*docs.columns), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their place in sequences of 1024 tokens."""
    return best_two_fit(docs, public_tokenizers.path(PACKED_WITH), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
