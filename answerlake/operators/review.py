"""Review-desk rollups: conversations, flags, daily trends, pages and queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.session import settle

# Review thresholds, page bounds and export bound.
LOW_GROUNDEDNESS = 0.9
FRUSTRATED = 0.55
MAX_PAGE_SIZE = 100
TOP_ROWS = 2500         # pages up to here are cut from a top-k
MAX_TREND_DAYS = 90
METRIC_VERSION = 2


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def is_declined(message: Column, prefixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | message.startswith(prefix)
    return hit


def current_version(scores: DataFrame, version: int = METRIC_VERSION) -> DataFrame:
    return scores.filter(F.col("metric_version") == version)


def conversation_rollup(messages: DataFrame, scores: DataFrame, cases: DataFrame,
                        prefixes: Sequence[str], version: int = METRIC_VERSION) -> DataFrame:
    """One row per session. Each input is aggregated on session_id first, so the
    two joins reuse that partitioning and only aggregated rows move."""
    user = F.col("role") == "user"
    base = messages.groupBy("session_id").agg(
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_at"),
        count_if(user).alias("questions"),
        F.max(F.when(user, F.col("frustration_score"))).alias("max_frustration"),
        count_if(F.col("feedback") == "up").alias("rated_up"),
        count_if(F.col("feedback") == "down").alias("rated_down"),
        count_if((F.col("role") == "assistant") & is_declined(F.col("message"), prefixes)).alias("declined"),
        F.min_by("message", F.when(user, F.col("id"))).alias("first_question"),
    )
    worst = current_version(scores, version).groupBy("session_id").agg(
        F.min("groundedness").alias("min_groundedness"),
        F.min("answer_relevance").alias("min_relevance"),
    )
    handed = cases.groupBy("session_id").agg(F.count(F.lit(1)).alias("handovers"))
    return (
        base.join(worst, "session_id", "left").join(handed, "session_id", "left")
        .withColumn("handovers", F.coalesce("handovers", F.lit(0).cast("bigint")))
    )


def flag(rollup: DataFrame) -> DataFrame:
    """Adds the ordered ``flags`` array; a missing figure never raises a flag."""
    rules = [
        ("low", F.col("min_groundedness") < LOW_GROUNDEDNESS),
        ("down", F.col("rated_down") > 0),
        ("frustrated", F.col("max_frustration") >= FRUSTRATED),
        ("handover", F.col("handovers") > 0),
        ("declined", F.col("declined") > 0),
    ]
    return rollup.withColumn(
        "flags", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])))


def with_flag(flagged: DataFrame, name: str) -> DataFrame:
    return flagged.filter(F.array_contains("flags", name))


def search_sessions(rollup: DataFrame, messages: DataFrame, text: str) -> DataFrame:
    """Sessions with at least one message containing ``text`` (any letter case)."""
    needle = text.strip()[:100].lower()
    hits = messages.filter(F.lower("message").contains(needle)).select("session_id")
    return rollup.join(hits, "session_id", "left_semi")


def short_id(session_id: Column) -> Column:
    return F.substring(F.coalesce(session_id.cast("string"), F.lit("")), 1, 8)


def padded_ref(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}-%05d", number)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page in a total order: size kept in 1..100, page number at least 1.

    The first pages are a top-k, of which a task keeps no more rows than the page ends at. For
    one further down the rows are sorted by range once; the counts of the partitions tell in
    which the page lies, and only those are read again. Nothing before the page is gathered.
    """
    size = max(1, min(int(size or 25), MAX_PAGE_SIZE))
    skip = (max(1, int(number or 1)) - 1) * size
    if skip + size <= TOP_ROWS:
        return df.orderBy(*order).offset(skip).limit(size)
    sorted_ = settle(df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id()))
    counts = {r["part__"]: r["count"] for r in sorted_.groupBy("part__").count().collect()}     # one row for each partition
    before, wanted, ahead = 0, [], 0
    for part in sorted(counts):
        if before < skip + size and before + counts[part] > skip:
            wanted, ahead = [*wanted, part], ahead if wanted else before
        before += counts[part]
    return sorted_.filter(F.col("part__").isin(wanted)).drop("part__").orderBy(*order).offset(skip - ahead if wanted else 0).limit(size)


def paged(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    """A page together with the row count of everything it was cut from."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return page(df, order, number, size).withColumn("total", total)


def conversation_detail(messages: DataFrame, scores: DataFrame, cases: DataFrame,
                        prefixes: Sequence[str], version: int = METRIC_VERSION) -> DataFrame:
    """Every message with its own scores; kept flat so a huge session stays splittable."""
    answer = F.col("role") == "assistant"
    own = current_version(scores, version).filter(F.col("message_id").isNotNull()).select(
        F.col("message_id").alias("id"), "context_relevance", "groundedness", "answer_relevance")
    open_cases = cases.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("cases"), F.max("case_id").alias("last_case"))
    return (
        messages.join(own, "id", "left").join(open_cases, "session_id", "left")
        .select(
            "session_id", "id", "role", "message",
            F.when(F.col("role") == "user", F.col("frustration_score")).alias("frustration_score"),
            *[F.when(answer, F.col(c)).alias(c)
              for c in ("context_relevance", "groundedness", "answer_relevance", "feedback")],
            F.when(answer, is_declined(F.col("message"), prefixes)).alias("declined"),
            F.coalesce("cases", F.lit(0).cast("bigint")).alias("cases"),
            padded_ref("H", F.col("last_case")).alias("last_case_ref"),
        )
    )


def trends(messages: DataFrame, scores: DataFrame, cases: DataFrame, prefixes: Sequence[str],
           end: str, days: int = 14, version: int = METRIC_VERSION) -> DataFrame:
    """One row per day up to ``end``; days without data keep zero counts and NULL means."""
    days = max(1, min(days, MAX_TREND_DAYS))
    first = F.date_sub(F.to_date(F.lit(end)), days - 1)
    since = first.cast("timestamp_ntz")
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    talk = messages.filter(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day")).agg(
        F.countDistinct("session_id").alias("conversations"),
        count_if(user).alias("questions"),
        count_if(user & (F.col("sentiment_label") == "frustrated")).alias("frustrated"),
        count_if(answer & is_declined(F.col("message"), prefixes)).alias("declined"),
    )
    quality = current_version(scores, version).filter(F.col("created_at") >= since).groupBy(
        F.to_date("created_at").alias("day")).agg(
        F.round(F.avg("groundedness"), 3).alias("groundedness"),
        F.round(F.avg("answer_relevance"), 3).alias("answer_relevance"),
    )
    rated = messages.filter(F.col("feedback_at") >= since).groupBy(F.to_date("feedback_at").alias("day")).agg(
        count_if(F.col("feedback") == "up").alias("rated_up"),
        count_if(F.col("feedback") == "down").alias("rated_down"),
    )
    handed = cases.filter(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("handovers"))
    spine = messages.sparkSession.range(1).select(
        F.explode(F.sequence(first, F.to_date(F.lit(end)))).alias("day"))
    out = spine
    for part in (talk, quality, rated, handed):
        out = out.join(part, "day", "left")
    counts = ("conversations", "questions", "frustrated", "declined", "rated_up", "rated_down", "handovers")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts})


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def quality_overview(scores: DataFrame, limit: int = 200, version: int = METRIC_VERSION) -> DataFrame:
    newest = current_version(scores, version).orderBy(F.desc("id")).limit(limit)

    def mean(name):
        return F.round(F.coalesce(F.avg(name), F.lit(0.0)), 4)

    return newest.agg(
        F.count(F.lit(1)).alias("scored"),
        mean("context_relevance").alias("context_relevance"),
        mean("groundedness").alias("groundedness"),
        mean("answer_relevance").alias("answer_relevance"),
        F.round(F.coalesce(1 - F.avg("groundedness"), F.lit(0.0)), 4).alias("hallucination"),
    )


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key as a min_by aggregate: partial results combine before the shuffle."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(row, order).alias("row")).select(key, "row.*")


def latest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("row")).select(key, "row.*")


def tail_per(df: DataFrame, key: str, order: str, n: int = 30) -> DataFrame:
    """Last n rows per key, numbered oldest first. The rank filter is pushed below
    the shuffle by Spark, so a hot key sends at most n rows per task."""
    newest = W.partitionBy(key).orderBy(F.desc(order))
    kept = df.withColumn("from_end", F.row_number().over(newest)).filter(F.col("from_end") <= n)
    return kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(order)))


def order_by_status(df: DataFrame, statuses: Sequence[str], ident: str) -> DataFrame:
    rank = F.lit(len(statuses))
    for i, status in reversed(list(enumerate(statuses))):
        rank = F.when(F.col("status") == status, i).otherwise(rank)
    return df.withColumn("status_rank", rank).orderBy("status_rank", F.desc(ident))


def case_queue(cases: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Open then claimed cases, newest first, each with the last user message."""
    active = cases.filter(F.col("status").isin("open", "claimed"))
    last = messages.filter(F.col("role") == "user").groupBy("session_id").agg(
        F.max_by("message", "id").alias("last_message"))
    top = order_by_status(active, ("open", "claimed"), "case_id").limit(limit)
    return top.join(last, "session_id", "left")


def list_threads(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Pinned threads first, then the most recent; threads without messages are dropped."""
    talk = messages.groupBy("session_id").agg(
        F.min_by("message", F.when(F.col("role") == "user", F.col("id"))).alias("title"),
        F.max("created_at").alias("last_at"))
    return (
        sessions.join(talk, "session_id")
        .orderBy(F.desc("pinned"), F.desc("last_at"), F.desc("session_id")).limit(limit)
    )


def since(df: DataFrame, key: str, value, after: int, role: str) -> DataFrame:
    """Messages of one session after a cursor, oldest first."""
    return df.filter((F.col(key) == value) & (F.col("id") > after) & (F.col("role") == role)).orderBy("id")


def filter_audit(df: DataFrame, user=None, action: str | None = None) -> DataFrame:
    if user is not None:
        df = df.filter(F.col("username") == user)
    if action:
        df = df.filter(F.col("action") == action)
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def recent_failures(lookups: DataFrame, now: str, hours: int = 1) -> DataFrame:
    start = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return lookups.filter(~F.col("found") & (F.col("created_at") >= start)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("failures"))
