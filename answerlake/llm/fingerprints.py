"""I-Match fingerprints (operator 10), in DataFrame operations only.

The lexicon is every term whose share of documents lies in an inverse-document-frequency band.
A document keeps its distinct terms in the lexicon, sorted; SUBSETS random subsets of the
lexicon, of different sizes, are drawn by the digits of a term's MD5, and the fingerprint is
the hash of what each subset leaves of the document. Two fingerprints are as alike as the
share of equal hashes among subsets that hold a term of either.

The lexicon's size is bounded by the average number of distinct terms of a document divided by
the band's lower share (a term in the band takes that share of all documents), whatever the
number of documents; it becomes an IN list of the plan.

Defined cases: a null text counts as empty; a document without a lexicon term hashes all of its
terms in every subset, so that only equal term sets look alike (two empty texts do); rows that
repeat a doc_id are ordered by text, and of rows without doc_id, which come first, likewise;
the last row's next is the first, in a one-row table itself. An empty table gives no rows.
Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import written

LEAST_SHARE = 0.005
MOST_SHARE = 0.10
SUBSETS = 24
# a term is in subset i if digits i and i + 1 of its MD5 are below the i-th pair of these: 1/4, 1/16, 1/32 and 1/64 of the lexicon in turn
LIMITS = "40100804" * (SUBSETS // 4)
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: Column) -> Column:
    """Distinct words of a text, A-Z lower-cased."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), *LOWER), r"[\x20\x09-\x0D]+")
    return F.array_remove(F.array_distinct(words), "")


def lexicon(documents: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> list[str]:
    """Terms of the band, sorted. A term of a single document is in none."""
    found = documents.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = documents.count()
    band = found.filter((F.col("df") >= max(2.0, least * n)) & (F.col("df") <= most * n))
    return sorted(r["term"] for r in band.collect())


def _in_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def hashes(text: str, words: list[str]) -> Column:
    """The array of subset hashes of a text column; '' where a subset holds none of its terms."""
    every = f"array_remove(array_distinct(split(translate(coalesce({text}, ''), '{LOWER[0]}', '{LOWER[1]}'), '[\\\\x20\\\\x09-\\\\x0D]+')), '')"
    kept = f"filter(t, w -> w in ({_in_list(words)}))" if words else "filter(t, w -> false)"
    return F.expr(f"""
      transform(array({every}), t -> transform(array({kept}), k -> case when size(k) = 0
        then transform(sequence(1, {SUBSETS}), i -> substr(md5(array_join(array_sort(t), ' ')), 1, 8))
        else transform(array(transform(array_sort(k), w -> concat(md5(w), w))), s ->
          transform(sequence(1, {SUBSETS}), i -> transform(array(filter(s, x -> substr(x, i, 2) < substr('{LIMITS}', 2 * i - 1, 2))),
            m -> case when size(m) = 0 then '' else substr(md5(array_join(m, ' ')), 1, 8) end)[0]))[0] end)[0])[0]""")


def likeness(a: str, b: str) -> Column:
    used = f"size(filter(sequence(0, {SUBSETS - 1}), i -> {a}[i] <> '' or {b}[i] <> ''))"
    same = f"size(filter(sequence(0, {SUBSETS - 1}), i -> {a}[i] <> '' and {a}[i] = {b}[i]))"
    return F.expr(f"case when {used} = 0 then 0.0D else {same} / cast({used} as double) end")


def fingerprint(a: str) -> Column:
    return F.array_join(F.transform(F.col(a), lambda x: F.when(x == "", "--------").otherwise(x)), "")


def in_ranges(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) with `range`, the number of a doc_id interval of about equal rows."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = documents.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    return documents.withColumn("range", F.coalesce(F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c <= F.col("doc_id"))), F.lit(0)))


def with_next(documents: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, text, its hashes `own`, and text and hashes of the next row by doc_id. Rows are
    ordered within intervals; the first row of each interval is handed to the one before."""
    rows = in_ranges(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    place = Window.partitionBy("range").orderBy("doc_id", "text")
    firsts = rows.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    firsts = firsts.select("range", F.col("head.text").alias("text"))
    firsts = written(firsts.withColumn("own", hashes("text", words)), "heads")      # a row for each interval
    turn = Window.orderBy("range")
    first = F.first(F.struct("text", "own")).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = firsts.select("range", F.coalesce(F.lead(F.struct("text", "own")).over(turn), first).alias("head"))
    ahead = rows.withColumn("next_text", F.lead("text").over(place)).withColumn("own", hashes("text", words))
    ahead = ahead.withColumn("next_own", F.lead("own").over(place)).join(heads, "range")
    return ahead.select("doc_id", "text", "own", F.coalesce("next_text", "head.text").alias("next_text"),
                        F.coalesce("next_own", "head.own").alias("next_own"))


def fingerprints(documents: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every document and of its edited text (its last quarter replaced by the
    start of the next document), with the likeness of both and of the next document's."""
    words = lexicon(documents, least, most)
    rows = with_next(documents, words).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut),
                                              F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_own", hashes("edited", words))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"),
                       fingerprint("edited_own").alias("edited_fingerprint"), likeness("own", "edited_own").alias("near_edited"),
                       likeness("own", "next_own").alias("near_next"))
