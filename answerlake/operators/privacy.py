"""Erasure, retention and lookup of personal data over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.functions.masking import PHONE

ACTIVE_CASES = ("open", "claimed")


@dataclass(frozen=True)
class Desk:
    """The tables personal data lives in. ``state`` holds per-session tables that are
    simply deleted (context, offers, lookups, requests, session rows)."""

    messages: DataFrame
    cases: DataFrame
    scores: DataFrame
    ledger: DataFrame
    sessions: DataFrame
    state: Sequence[tuple[str, DataFrame]] = ()


@dataclass(frozen=True)
class Retention:
    """Default retention periods."""

    session_days: int = 30
    payment_days: int = 90
    memory_minutes: int = 30
    audit_days: int = 365


def cutoff(now: str, days: int = 0, minutes: int = 0) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days), mins=F.lit(minutes))


def stale_sessions(sessions: DataFrame, cases: DataFrame, before: Column) -> DataFrame:
    """Sessions idle since ``before`` that no open or claimed case holds."""
    held = cases.filter(F.col("status").isin(*ACTIVE_CASES)).select("session_id")
    return sessions.filter(F.col("last_seen_at") < before).select("session_id").join(held, "session_id", "left_anti")


def orphan_sessions(messages: DataFrame, sessions: DataFrame, cases: DataFrame, before: Column) -> DataFrame:
    """Sessions of old messages that have neither a session row nor an active case.
    Distinct comes first: the anti joins then move one row per session."""
    held = cases.filter(F.col("status").isin(*ACTIVE_CASES)).select("session_id")
    return (messages.filter(F.col("created_at") < before).select("session_id").distinct()
            .join(sessions.select("session_id"), "session_id", "left_anti").join(held, "session_id", "left_anti"))


def union_ids(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("session_id")
    for part in parts[1:]:
        out = out.union(part.select("session_id"))
    return out.filter(F.col("session_id").isNotNull()).distinct()


def inactive_sessions(events: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Sessions whose last activity is too old; a session ages out as a whole."""
    return events.groupBy("session_id").agg(F.max("created_at").alias("last_at")).filter(
        F.col("last_at") < cutoff(now, days))


def sessions_for_phone(ledger: DataFrame, messages: DataFrame, phones: DataFrame, pattern: str = PHONE) -> DataFrame:
    """(phone_tail, session_id) of every session that paid with or mentioned a number,
    in any spelling; numbers are compared on their last nine digits."""
    def tail(c: Column) -> Column:
        return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(9))

    wanted = phones.select(tail(F.col("phone")).alias("phone_tail")).filter(F.length("phone_tail") == 9).distinct()
    paid = ledger.filter(F.col("phone_number").isNotNull()).select(tail(F.col("phone_number")).alias("phone_tail"), "session_id")
    said = messages.filter(F.col("role") == "user").select(
        "session_id", F.explode(F.regexp_extract_all("message", F.lit(pattern), F.lit(0))).alias("hit")).select(
        tail(F.col("hit")).alias("phone_tail"), "session_id")
    return paid.union(said).join(wanted, "phone_tail", "left_semi").distinct()


def erase(desk: Desk, ids: DataFrame) -> tuple[Desk, DataFrame]:
    """The tables without anything personal of ``ids`` and one row of counts.

    Payments stay without their phone number and scores stay without their question,
    also when another session asked the very same question.
    """
    gone = ids.select("session_id").distinct()
    mark = gone.withColumn("erased", F.lit(True))
    questions = desk.messages.filter((F.col("role") == "user") & F.col("message").isNotNull()).join(gone, "session_id", "left_semi").select(
        F.col("message").alias("query")).distinct().withColumn("asked", F.lit(True))
    # scores without a question have nothing to erase; as a join key their NULL would be one hot group
    asked = desk.scores.filter(F.col("query").isNotNull()).join(mark, "session_id", "left").join(questions, "query", "left")
    hit = F.coalesce("erased", F.lit(False)) | F.coalesce("asked", F.lit(False))
    scores = asked.withColumn("hit", hit).select(*desk.scores.columns, "hit").union(
        desk.scores.filter(F.col("query").isNull()).withColumn("hit", F.lit(False)))
    ledger = desk.ledger.join(mark, "session_id", "left").withColumn(
        "hit", F.coalesce("erased", F.lit(False)) & F.col("phone_number").isNotNull())

    def kept(df: DataFrame) -> DataFrame:
        return df.join(gone, "session_id", "left_anti")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    parts = [
        count(gone, "sessions"),
        count(desk.messages.join(gone, "session_id", "left_semi"), "messages"),
        count(desk.cases.join(gone, "session_id", "left_semi"), "handover_cases"),
        count(ledger.filter("hit"), "payment_contacts"),
        count(scores.filter("hit"), "evaluation_texts"),
    ]
    first, *rest = parts
    counts = first.withColumns({p.columns[0]: p.scalar() for p in rest})
    after = Desk(
        messages=kept(desk.messages), cases=kept(desk.cases), sessions=kept(desk.sessions),
        scores=scores.withColumn("query", F.when(~F.col("hit"), F.col("query"))).select(desk.scores.columns),
        ledger=ledger.withColumn("phone_number", F.when(~F.col("hit"), F.col("phone_number"))).select(desk.ledger.columns),
        state=[(name, kept(df)) for name, df in desk.state])
    return after, counts


def preview_erasure(desk: Desk, ids: DataFrame) -> DataFrame:
    return erase(desk, ids)[1]


def purge(desk: Desk, now: str, memory: DataFrame, audit: DataFrame, policy: Retention = Retention()) -> tuple[Desk, DataFrame]:
    """One retention sweep: whole stale sessions, old phone numbers of settled payments,
    old question texts, expired memory and old audit rows."""
    old = cutoff(now, policy.session_days)
    stale = stale_sessions(desk.sessions, desk.cases, old)
    orphans = orphan_sessions(desk.messages, desk.sessions, desk.cases, old)
    after, counts = erase(desk, union_ids(stale, orphans))
    late_text = F.col("query").isNotNull() & (F.col("created_at") < old)
    settled = (F.col("phone_number").isNotNull() & (F.col("created_at") < cutoff(now, policy.payment_days))
               & (F.col("status") != "pending"))
    dead_memory = F.col("updated_at") < cutoff(now, minutes=policy.memory_minutes)
    dead_audit = F.col("created_at") < cutoff(now, policy.audit_days)

    def n(df: DataFrame, test: Column) -> Column:
        return df.filter(test).agg(F.count(F.lit(1)).alias("n")).scalar()

    counts = counts.withColumns({
        "sessions": stale.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "evaluation_texts": F.col("evaluation_texts") + n(after.scores, late_text),
        "payment_contacts": F.col("payment_contacts") + n(after.ledger, settled),
        "expired_memory": n(memory, dead_memory), "audit_entries": n(audit, dead_audit)})
    swept = Desk(
        messages=after.messages, cases=after.cases, sessions=after.sessions,
        scores=after.scores.withColumn("query", F.when(~F.coalesce(late_text, F.lit(False)), F.col("query"))),
        ledger=after.ledger.withColumn("phone_number", F.when(~F.coalesce(settled, F.lit(False)), F.col("phone_number"))),
        state=[*after.state, ("memory", memory.filter(~dead_memory)), ("audit", audit.filter(~dead_audit))])
    return swept, counts
