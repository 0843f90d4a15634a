"""Corpus fingerprints and the refresh of changed documents only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A digest is summed in parts of 8 hex digits: the sums combine in any order.
_PARTS = tuple(range(1, 64, 8))


def document_digests(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The name's length stands before it, so no other name and text spell the same."""
    name = F.col(ident).cast("string")
    named = F.concat(F.length(name).cast("string"), F.lit(":"), name)
    return docs.select(ident, F.sha2(F.concat_ws("=", named, F.col(text)), 256).alias("digest"))


def corpus_fingerprint(docs: DataFrame, settings: Mapping[str, object], ident: str = "doc_id", text: str = "text",
                       manifest: DataFrame | None = None) -> DataFrame:
    """One row, ``fingerprint``: 16 hex digits that change with any document, with the set
    of documents, with any setting and with any field of the manifest.

    Document digests are added up part by part instead of being sorted and joined: the
    sum needs no order, so every task sends one row whatever the corpus size.
    """
    digests = document_digests(docs, ident, text).select("digest", F.lit("d").alias("side"))
    sides = ["d"]
    if manifest is not None:
        row = F.to_json(F.struct(*sorted(manifest.columns)))
        digests = digests.unionByName(manifest.select(F.sha2(row, 256).alias("digest"), F.lit("m").alias("side")))
        sides.append("m")
    # parts are below 2^32; 28 digits leave the sum 38, more than any table has rows for
    part = {at: F.conv(F.substring("digest", at, 8), 16, 10).cast("decimal(28,0)") for at in _PARTS}
    sums = digests.agg(
        *[F.count(F.when(F.col("side") == s, 1)).alias(f"{s}n") for s in sides],
        *[F.sum(F.when(F.col("side") == s, part[at])).alias(f"{s}{at}") for s in sides for at in _PARTS])
    fixed = "/".join(f"{k}={settings[k]}" for k in sorted(settings))
    parts = [F.coalesce(F.col(f"{s}{at}"), F.lit(0)).cast("string") for s in sides for at in ("n", *_PARTS)]
    return sums.select(F.substring(F.sha2(F.concat_ws("/", *parts, F.lit(fixed)), 256), 1, 16).alias("fingerprint"))


def changed_documents(old: DataFrame, new: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, change) of documents added, changed or removed between two versions."""
    before = document_digests(old, ident, text).withColumnRenamed("digest", "was")
    after = document_digests(new, ident, text).withColumnRenamed("digest", "now")
    return before.join(after, ident, "full_outer").withColumn(
        "change", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "changed")).filter(F.col("change").isNotNull()).select(ident, "change")


def refresh_index(index: DataFrame, old: DataFrame, new: DataFrame, build: Callable[[DataFrame], DataFrame],
                  ident: str = "doc_id") -> DataFrame:
    """The index of ``new``: kept chunks of unchanged documents plus ``build`` of the others."""
    changes = changed_documents(old, new, ident)
    kept = index.join(changes.select(ident), ident, "left_anti")
    todo = new.join(changes.filter("change <> 'removed'").select(ident), ident, "left_semi")
    return kept.unionByName(build(todo))


def needs_rebuild(fingerprint: str, previous: str | None, stale: bool) -> bool:
    return stale or previous != fingerprint
