"""Table versions: upserts, ratings and the consented import of labelled messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.functions.masking import SCRUB_RULES, scrub
from answerlake.session import small_side


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str, keep_old: Sequence[str] = ()) -> DataFrame:
    """The target with the last change of each key applied; columns in ``keep_old``
    take a new value only where there is one."""
    columns = [c for c in target.columns if c != key]
    row = F.struct(*[c for c in changes.columns if c != key])
    last = changes.groupBy(key).agg(F.max_by(row, order).alias("new"))
    joined = target.withColumn("present", F.lit(True)).join(last, key, "full_outer")

    def value(c: str):
        if c not in changes.columns:
            return F.col(c)
        if c in keep_old:
            return F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c)
        return F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(key, *[value(c) for c in columns])


def apply_feedback(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """The last rating of each message, taken only for assistant messages of the
    rater's own session. ``ratings`` has (message_id, session_id, rating, rated_no)."""
    last = ratings.groupBy("message_id", "session_id").agg(F.max_by("rating", "rated_no").alias("rating")).select(
        F.col("message_id").alias("id"), "session_id", "rating")
    rated = messages.join(last, ["id", "session_id"], "left")
    return rated.withColumn("feedback", F.when(F.col("role") == "assistant", F.coalesce("rating", "feedback"))
                            .otherwise(F.col("feedback"))).drop("rating")


def drop_seen(new: DataFrame, *known: DataFrame, text: str = "text", order: str = "row_no") -> DataFrame:
    """New rows whose normalised text is in no known table; of copies the first stays."""
    keyed = new.withColumn("norm_key", x.norm_key(F.col(text)))
    first = keyed.groupBy("norm_key").agg(F.min_by(F.struct(*new.columns), order).alias("row"))
    for table in known:
        first = first.join(table.select(x.norm_key(F.col(text)).alias("norm_key")), "norm_key", "left_anti")
    return first.select("row.*")


def import_messages(new: DataFrame, train: DataFrame, challenge: DataFrame, labels: Sequence[str],
                    rules=SCRUB_RULES) -> DataFrame:
    """Every offered row with its fate: (row_no, text, label, language, found, reason).

    A NULL reason means accepted. Consent, text and label are checked in that order;
    the text is scrubbed before it is compared with known and earlier rows.
    """
    label = F.lower(x.strip(F.coalesce("label", F.lit(""))))
    raw = x.strip(F.coalesce("text", F.lit("")))
    safe = scrub(F.col("raw"), rules)

    def key(text: Column) -> Column:
        return F.sha2(x.norm_key(text), 256)

    rows = new.select(
        "row_no", raw.alias("raw"), label.alias("label"),
        F.coalesce(F.nullif(F.lower(x.strip(F.coalesce("language", F.lit("")))), F.lit("")), F.lit("unknown")).alias("language"),
        F.when(x.strip(F.coalesce("consent_ref", F.lit(""))) == "", "no consent reference")
        .when(raw == "", "empty text").when(~label.isin(*labels), "bad label").alias("reason"),
    ).withColumns({"text": safe["text"], "found": safe["found"]}).withColumn("norm_key", key(F.col("text")))
    # scrubbed once; what follows reads the columns it needs
    rows = small_side(rows)
    open_rows = rows.filter("reason IS NULL")
    known = train.select(key(F.col("text")).alias("norm_key")).union(
        challenge.select(key(F.col("text")).alias("norm_key"))).distinct().withColumn("known", F.lit(True))
    first = open_rows.groupBy("norm_key").agg(F.min("row_no").alias("first_no"))
    checked = open_rows.join(first, "norm_key").join(known, "norm_key", "left").withColumn(
        "reason", F.when(F.col("known") | (F.col("row_no") != F.col("first_no")), "duplicate of training or challenge data"))
    columns = ["row_no", "text", "label", "language", "found", "reason"]
    refused = rows.filter("reason IS NOT NULL").withColumns(
        {"text": F.col("raw"), "found": x.word_set(())}).select(columns)
    return checked.select(columns).unionByName(refused)


def import_report(rows: DataFrame) -> DataFrame:
    """Accepted rows by language and label, rejected by reason, placeholders used."""
    fate = F.when(F.col("reason").isNull(), F.struct(F.lit("accepted").alias("part"), F.concat_ws("/", "language", "label").alias("key"))
                  ).otherwise(F.struct(F.lit("rejected").alias("part"), F.col("reason").alias("key")))
    replaced = F.transform("found", lambda f: F.struct(F.lit("replaced").alias("part"), f.alias("key")))
    return rows.select(F.inline(F.concat(F.array(fate), F.coalesce(replaced, F.slice(F.array(fate), 1, 0))))).groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("n"))
