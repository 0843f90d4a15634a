"""Written cuts in the shared folder, and components of a graph of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.session import checkpoint_root, settle


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later jobs, and tasks run
    again after an executor is lost, read files instead of the plan."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns that an operator needs, so that others can't clash."""
    return df.select(*columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Large-star and small-star rounds. Every round is two group-wise minima, its output has
    no more rows than its input, and each is checkpointed; rounds end when the edges stay.
    Nodes without an edge to another node aren't returned.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = settle(small.filter("u <> v").distinct())
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
