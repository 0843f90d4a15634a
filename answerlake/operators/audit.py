"""Data audits: registries, manifests, evaluation sets, overlaps and generated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.operators.passages import runs_in_texts
from answerlake.session import small_side


def sql_words(text: Column) -> Column:
    """Words as the SQL's `\\S` sees them: a vertical tab does not end one."""
    return x.extract_all(text, r"[^\t\n\f\r ]+")


def containing_documents(passages: DataFrame, ident: str, docs: DataFrame, doc_id: str, n: int = 6) -> DataFrame:
    """(ident, doc_id) pairs where the document holds all the passage's words in a row.

    Documents are never compared with passages one by one, nor their runs shuffled: a document's
    runs of words are looked up where it lies in a Bloom filter whose size follows the number of
    passages. Only the runs that pass are joined with the passages, whole and as text, so nothing
    rests on a hash. A passage without words is in none.
    """
    words = sql_words(F.col("text"))
    wanted = small_side(passages.select(ident, words.alias("w")).filter(F.size("w") > 0).select(
        ident, F.size("w").alias("k"), F.array_join("w", " ").alias("passage")))
    sizes = {r["k"]: r["n"] for r in wanted.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row for each length
    if not sizes:
        return docs.select(F.lit(None).cast(passages.schema[ident].dataType).alias(ident), doc_id).limit(0)
    held = runs_in_texts(docs, doc_id, wanted, sizes, n)
    return held.join(wanted, "passage").select(ident, doc_id).distinct()


def containing_phrase(rows: DataFrame, ident: str, phrase: str, docs: DataFrame, doc_key: str) -> DataFrame:
    """Marks rows whose named document contains their phrase, spaces collapsed, any case."""
    flat = docs.select(doc_key, F.regexp_replace(F.lower("text"), r"\s+", " ").alias("body"))
    return rows.join(flat, doc_key, "left").withColumn(
        "present", F.coalesce(F.contains(F.col("body"), F.regexp_replace(F.lower(phrase), r"\s+", " ")), F.lit(False))).drop("body")


def audit_registry(registry: DataFrame, docs: DataFrame) -> DataFrame:
    """Problems of a figure registry (key, doc_id, phrase, provenance, source_url)."""
    found = containing_phrase(registry, "key", "phrase", docs.select("doc_id", "text"), "doc_id")
    known = docs.select("doc_id").withColumn("known", F.lit(True))
    rows = found.join(known, "doc_id", "left")
    problem = (F.when(F.col("known").isNull(), "document missing").when(~F.col("present"), "figure not in document")
               .when((F.col("provenance") == "published") & F.col("source_url").isNull(), "published without source"))
    return rows.select("key", "doc_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def manifest_gaps(docs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Documents missing from the manifest and manifest entries without a document."""
    undeclared = docs.select(key).join(manifest.select(key), key, "left_anti").withColumn("reason", F.lit("not in manifest"))
    absent = manifest.select(key).join(docs.select(key), key, "left_anti").withColumn("reason", F.lit("no such document"))
    return undeclared.unionByName(absent)


def audit_manifest(manifest: DataFrame, docs: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Gaps both ways, missing required fields, and synthetic documents that do not say so."""
    gaps = manifest_gaps(docs, manifest, key)
    missing = manifest.select(key, F.explode(F.array_compact(F.array(
        *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]))).alias("reason"))
    silent = manifest.filter((F.col("provenance") == "synthetic") & ~F.coalesce(
        F.lower("notes").contains("prototype"), F.lit(False))).select(key, F.lit("synthetic not disclosed").alias("reason"))
    return gaps.unionByName(missing).unionByName(silent)


def audit_eval_set(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Per evaluation item (item_id, topics, keywords): number of topics and the
    keywords found in none of its topics' documents."""
    wanted = items.select("item_id", F.explode_outer("keywords").alias("keyword"))
    bodies = items.select("item_id", F.explode("topics").alias("doc_id")).join(
        docs.select("doc_id", F.lower("text").alias("body")), "doc_id")
    seen = wanted.join(bodies, "item_id", "left").groupBy("item_id", "keyword").agg(
        F.max(F.contains(F.col("body"), F.lower("keyword"))).alias("present"))
    lost = seen.groupBy("item_id").agg(F.array_sort(F.collect_set(
        F.when(F.col("keyword").isNotNull() & ~F.coalesce("present", F.lit(False)), F.col("keyword")))).alias("absent"))
    return items.select("item_id", F.size("topics").alias("hops")).join(lost, "item_id", "left")


def describe_dataset(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows, words per row and case-insensitive duplicates of a text table."""
    n = F.size(x.words(F.col(text)))
    rows = df.select(n.alias("n"), F.md5(F.lower(x.strip(F.col(text)))).alias("key"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("n"), 4).alias("mean_words"), F.min("n").alias("min_words"),
                    F.max("n").alias("max_words"), (F.count(F.lit(1)) - F.countDistinct("key")).alias("duplicates"))


def overlap(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Normalised texts present on both sides, with their copies on each."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(x.norm_key(F.col(text)).alias("norm_key")).agg(F.count(F.lit(1)).alias(name))

    return side(a, "left_rows").join(side(b, "right_rows"), "norm_key")


def pool_size(templates: DataFrame, pools: dict[str, int]) -> DataFrame:
    """Number of texts each template can make, without making them."""
    table = F.create_map(*[p for k, n in pools.items() for p in (F.lit(k), F.lit(n).cast("bigint"))])
    slots = x.extract_all(F.col("template"), r"\{(\w+)\}", 1)
    return templates.withColumn("size", F.aggregate(
        F.transform(slots, lambda s: table[s]), F.lit(1).cast("bigint"), lambda a, n: a * n))


def expand_grammar(templates: DataFrame, pools: dict[str, DataFrame], n: int, seed: str, label: str = "label") -> DataFrame:
    """Fills the slots of each template with words drawn from their pools and keeps n
    distinct texts per label in an order fixed by the seed.

    Slots are filled one after the other by an equi-join on the slot's name, so every
    step is a hash join whose build side is the word pool.
    """
    words = None
    for slot, pool in pools.items():
        named = pool.select(F.lit("{" + slot + "}").alias("slot"), F.col(pool.columns[0]).alias("word"))
        words = named if words is None else words.unionByName(named)
    words = small_side(words)
    open_rows, done = templates.select(label, F.col("template").alias("text")), None
    for _ in range(len(pools) + 1):
        slot = F.regexp_extract("text", r"(\{\w+\})", 1)
        marked = open_rows.withColumn("slot", slot)
        full = marked.filter("slot = ''").drop("slot")
        done = full if done is None else done.unionByName(full)
        filled = F.concat(F.expr("left(text, at - 1)"), F.col("word"), F.expr("substring(text, at + length(slot))"))
        open_rows = marked.filter("slot <> ''").withColumn("at", F.expr("locate(slot, text)")).join(words, "slot").select(
            label, filled.alias("text"))
    flat = done.select(label, x.strip(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    # texts that differ by case alone are one: the first in the seeded order stays
    flat = flat.groupBy(label, F.lower("text").alias("same")).agg(
        F.min_by("text", F.struct(F.md5(F.concat(F.lit(seed), "text")), "text")).alias("text")).drop("same")
    from pyspark.sql import Window as W
    order = W.partitionBy(label).orderBy(F.md5(F.concat(F.lit(seed), "text")), "text")
    return flat.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
