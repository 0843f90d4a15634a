"""Structured Streaming form of the stateful rules.

State lives in Spark's state store (checkpointed with the query), keyed and shuffled by
Spark; a processor only advances one key. The store must be RocksDB-backed:
``spark.sql.streaming.stateStore.providerClass`` set to ``STATE_STORE``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from answerlake.streaming import rules
from answerlake.streaming.sequences import Step, frame_of, plain_rows
from answerlake.streaming.rules import SECOND

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedProcessor(StatefulProcessor):
    """Takes a key's events in event time with the step that the batch form uses.

    Events wait in list state until the watermark has passed them, so late and shuffled input
    gives what ordered input gives. The rule's few numbers go once nothing has come for as long
    as the rule remembers (``memory_us``), so a key that falls silent leaves nothing behind.
    """

    def __init__(self, step: Step, order: Sequence[str], columns: Sequence[str], held: str, schema: T.StructType, memory_us: int):
        self.step, self.order, self.columns, self.held_schema = step, list(order), list(columns), held
        self.schema, self.memory_us = schema, memory_us
        self.at = self.columns.index(self.order[0])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.state = handle.getValueState("state", "json string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        whole = [c.split()[1] in ("bigint", "int") for c in self.held_schema.split(", ")]
        for frame in rows:
            # a whole number beside a missing one comes as a float
            new = [tuple(int(v) if n and v is not None else v for v, n in zip(r, whole, strict=True)) for r in plain_rows(frame[self.columns])]
            self.held.appendList(new)
            for ms in {r[self.at] // 1000 + 1 for r in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        due, rest = [r for r in waiting if r[self.at] < now], [r for r in waiting if r[self.at] >= now]
        if due:
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
            places = [self.columns.index(c) for c in self.order]
            state, out = None, []
            if self.state.exists():
                held, until = self.state.get()
                state = json.loads(held)
                self.handle.deleteTimer(until // 1000 + 1)
            for row in sorted(due, key=lambda r: [r[i] for i in places]):
                state, result = self.step(state, row)
                if result is not None:
                    out.append(result)
            until = max(r[self.at] for r in due) + self.memory_us
            if state is not None:
                self.state.update((json.dumps(state), until))
                self.handle.registerTimer(until // 1000 + 1)
            elif self.state.exists():
                self.state.clear()
            yield frame_of(out, self.schema)
        elif self.state.exists() and self.state.get()[1] < now:
            self.state.clear()

    def close(self) -> None:
        pass


LATENESS = "10 minutes"
KEEP = 30 * 86400 * SECOND      # how long cases, requests, attempts and session memory outlast their last event


def fold_stream(df: DataFrame, key: str, order: Sequence[str], step: Step, schema: str, memory_us: int, lateness: str = LATENESS) -> DataFrame:
    """Streaming twin of the batch rules. ``df`` has an ``event_time`` beside the step's columns,
    of which the first of ``order`` is the same time in microseconds."""
    out = T.StructType.fromDDL(schema)
    columns = [c for c in df.columns if c != "event_time"]
    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "event_time")
    return df.withWatermark("event_time", lateness).groupBy(key).transformWithStateInPandas(
        OrderedProcessor(step, order, columns, held, out, memory_us), out, "Append", "EventTime")


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _timed(events: DataFrame, at: str, *columns) -> DataFrame:
    return events.select(F.col(at).cast("timestamp").alias("event_time"), *columns)


def rate_limit_stream(events: DataFrame, key: str, at: str, ident: str, limit: int, window_s: int, lateness: str = LATENESS) -> DataFrame:
    rows = _timed(events.filter(F.col(key).isNotNull()), at, key, _micros(at).alias("at"), ident)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return fold_stream(rows, key, ["at", ident], rules.sliding_window(limit, window_s),
                       f"{key} {kinds[key]}, {ident} {kinds[ident]}, allowed boolean, retry_after bigint", window_s * SECOND, lateness)


def throttle_stream(events: DataFrame, key: str, at: str, ident: str, seconds: int = rules.MIN_REQUERY_SECONDS, lateness: str = LATENESS) -> DataFrame:
    rows = _timed(events, at, key, _micros(at).alias("at"), ident)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return fold_stream(rows, key, ["at", ident], rules.throttle(seconds), f"{key} {kinds[key]}, {ident} {kinds[ident]}, accepted boolean",
                       seconds * SECOND, lateness)


def lockouts_stream(events: DataFrame, key: str, at: str, ident: str, failed: str, n: int = 5, seconds: int = 300, lateness: str = LATENESS) -> DataFrame:
    rows = _timed(events, at, key, _micros(at).alias("at"), ident, failed)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return fold_stream(rows, key, ["at", ident], rules.lockout(n, seconds),
                       f"{key} {kinds[key]}, {ident} {kinds[ident]}, locked boolean, failures bigint, remaining bigint", seconds * SECOND, lateness)


def session_memory_stream(events: DataFrame, ttl_minutes: int = rules.MEMORY_MINUTES, lateness: str = LATENESS, keep_us: int = KEEP) -> DataFrame:
    rows = _timed(events, "at", "session_id", _micros("at").alias("at_us"), "id", "query", "item").withColumnRenamed("at_us", "at")
    kind = rows.schema["session_id"].dataType.simpleString()
    return fold_stream(rows, "session_id", ["at", "id"], rules.session_memory(ttl_minutes),
                       f"session_id {kind}, id bigint, previous_query string, previous_item string", keep_us, lateness)


def dedupe_attempts_stream(attempts: DataFrame, lateness: str = LATENESS, keep_us: int = KEEP) -> DataFrame:
    rows = _timed(attempts, "created_at", "quote_id", _micros("created_at").alias("at"), "id", "status", _micros("closes_at").alias("closes_at"))
    return fold_stream(rows, "quote_id", ["at", "id"], rules.one_open_attempt(),
                       "quote_id string, id bigint, created boolean, attempt bigint", keep_us, lateness)


def state_machine_stream(events: DataFrame, transitions: Mapping, terminal: Sequence[str], lateness: str = LATENESS, keep_us: int = KEEP) -> DataFrame:
    rows = _timed(events, "at", "key", _micros("at").alias("at_us"), "id", "event").withColumnRenamed("at_us", "at")
    kind = rows.schema["key"].dataType.simpleString()
    return fold_stream(rows, "key", ["at", "id"], rules.machine(transitions, tuple(terminal)),
                       f"key {kind}, id bigint, case_no bigint, before string, after string, changed boolean", keep_us, lateness)


def request_lifecycle_stream(events: DataFrame, lateness: str = LATENESS, keep_us: int = KEEP) -> DataFrame:
    rows = _timed(events, "at", "session_id", _micros("at").alias("at_us"), "id", "event").withColumnRenamed("at_us", "at")
    kind = rows.schema["session_id"].dataType.simpleString()
    return fold_stream(rows, "session_id", ["at", "id"], rules.request_lifecycle(),
                       f"session_id {kind}, id bigint, request_no bigint, cancelled_no bigint, status string", keep_us, lateness)


PAYMENT_OUT = "id bigint, status string, receipt string, at timestamp"
HELD_OUTCOME = "at_us bigint, seq string, status string, amount_minor bigint, currency string, receipt string"


class PaymentProcessor(StatefulProcessor):
    """One payment attempt: waits for its decisive outcome or its deadline.

    Outcomes wait in list state until the watermark has passed them, so they count in event time
    however they arrive; one that is ahead of its attempt waits for it for the attempt's life
    time. Only a pending attempt moves, and not beyond its deadline: replayed and late callbacks
    change nothing but an empty mobile receipt. Where confirmations are asked for, a mobile
    success of the right amount holds up what comes after it until it is confirmed, and is
    dropped at the deadline if it isn't. All state goes ``keep_us`` after the deadline.
    """

    def __init__(self, ttl_minutes: int, confirm: bool, keep_us: int):
        self.ttl_us, self.confirm, self.keep_us = ttl_minutes * 60 * SECOND, confirm, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempt = handle.getValueState(
            "attempt", "status string, amount_minor bigint, currency string, method string, receipt string, deadline bigint")
        self.held = handle.getListState("held", HELD_OUTCOME)
        self.confirmed = handle.getValueState("confirmed", "at_us bigint")

    @staticmethod
    def _frame(key, changes: list) -> pd.DataFrame:
        return pd.DataFrame([{"id": key[0], "status": s, "receipt": r, "at": pd.Timestamp(us, unit="us")} for s, r, us in changes],
                            columns=["id", "status", "receipt", "at"])

    def _wake_after(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], []
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                us, minor = int(r.at_us), None if r.amount_minor is None else int(r.amount_minor)
                if r.kind == "attempt":
                    if not self.attempt.exists():
                        deadline = us + self.ttl_us
                        self.attempt.update((r.status, minor, r.currency, r.method, None, deadline))
                        out.append((r.status, None, us))
                        for t in (us, deadline, deadline + self.keep_us):
                            self._wake_after(t)
                elif r.kind == "confirmation":
                    self.confirmed.update((us,))
                    self._wake_after(us)
                    self._wake_after(us + self.ttl_us)
                elif r.status is not None:
                    held.append((us, r.seq, r.status, minor, r.currency, r.receipt))
                    self._wake_after(us)
                    self._wake_after(us + self.ttl_us)
        if held:
            self.held.appendList(held)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        if self.attempt.exists():
            state = self.attempt.get()
            if now > state[5] + self.keep_us:
                rest = []
                self.attempt.clear()
                if self.confirmed.exists():
                    self.confirmed.clear()
            else:
                state, rest, changes = self._advanced(state, waiting, now)
                self.attempt.update(state)
                yield self._frame(key, changes)
        else:
            rest = [h for h in waiting if h[0] + self.ttl_us >= now]
            if self.confirmed.exists() and self.confirmed.get()[0] + self.ttl_us < now:
                self.confirmed.clear()
        if rest != waiting:
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()

    def _advanced(self, state: tuple, waiting: list, now: int) -> tuple[tuple, list, list]:
        """The attempt after the outcomes before ``now``, those still to come, and the changes."""
        status, amount, currency, method, receipt, deadline = state
        card, changes, at = method == "card", [], 0
        while at < len(waiting) and waiting[at][0] < now:
            us, _, outcome, reported, reported_currency, new_receipt = waiting[at]
            if status == "pending" and us > deadline:
                break
            same = reported is not None and reported == amount and (
                not card or (reported_currency or "").upper() == (currency or "").upper())
            doubtful = self.confirm and not card and outcome == "paid" and same and not self.confirmed.exists()
            if doubtful and status == "pending" and now <= deadline:
                return (status, amount, currency, method, receipt, deadline), waiting[at:], changes
            at += 1
            if doubtful:
                continue
            if status == "pending":
                status, receipt = "needs_review" if outcome == "paid" and not same else outcome, new_receipt
            elif status == outcome == "paid" and same and not card and new_receipt and not receipt:
                receipt = new_receipt
            else:
                continue
            changes.append((status, receipt, us))
        if status == "pending" and now > deadline:
            status = "expired"
            changes.append((status, receipt, deadline))
            at = len([w for w in waiting if w[0] < now])
        return (status, amount, currency, method, receipt, deadline), waiting[at:], changes

    def close(self) -> None:
        pass


PAYMENT_COLUMNS = ("id", "at", "kind", "status", "amount_minor", "currency", "method", "receipt", "seq")


def payment_changes(attempts: DataFrame, outcomes: DataFrame, confirmations: DataFrame | None = None) -> DataFrame:
    """Attempts, outcomes and confirmations as one stream. Each needs id and ``at``; columns of
    ``payment_states_stream`` that one lacks are NULL. A confirmation says that the provider's
    status query agrees with the attempt's success."""
    def shaped(df: DataFrame, kind: str) -> DataFrame:
        kinds = {"amount_minor": "bigint", "id": "bigint", "at": "timestamp"}
        columns = {c: F.col(c) if c in df.columns else F.lit("" if c == "seq" else None) for c in PAYMENT_COLUMNS} | {"kind": F.lit(kind)}
        return df.select(*[v.cast(kinds.get(c, "string")).alias(c) for c, v in columns.items()])

    out = shaped(attempts, "attempt").unionByName(shaped(outcomes, "outcome"))
    return out if confirmations is None else out.unionByName(shaped(confirmations, "confirmation"))


def payment_states_stream(changes: DataFrame, ttl_minutes: int = 10, lateness: str = "10 minutes", confirm: bool = False,
                          keep_us: int = 86_400 * SECOND) -> DataFrame:
    """``changes``: attempts, outcomes and, with ``confirm``, confirmations as one stream with event
    time ``at``: id, at, kind ('attempt', 'outcome' or 'confirmation'), status, amount_minor, currency,
    receipt and, where there are any, method (card, else mobile) and seq (order of outcomes of one moment)."""
    optional = {"method": F.lit(None).cast("string"), "seq": F.lit("")}
    rows = changes.withColumns({c: F.coalesce(c, v) if c in changes.columns else v for c, v in optional.items()} | {"at_us": _micros("at")})
    return rows.withWatermark("at", lateness).groupBy("id").transformWithStateInPandas(
        PaymentProcessor(ttl_minutes, confirm, keep_us), PAYMENT_OUT, "Append", "EventTime")


class ExpiryProcessor(StatefulProcessor):
    """Reports a key once its latest offer has been open for the whole period."""

    def __init__(self, ttl_ms: int, kind: str):
        self.ttl_ms, self.kind = ttl_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pd.Timestamp(frame["at"].max()).timestamp() * 1000) for frame in rows)
        old = self.due.get()[0] if self.due.exists() else None
        due = newest + self.ttl_ms
        if old is None or due > old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.due.update((due,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield pd.DataFrame({"key": [key[0]], "expired_at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")]})

    def close(self) -> None:
        pass


def expire_stream(offers: DataFrame, key: str, at: str, ttl_minutes: int, lateness: str = "1 minute") -> DataFrame:
    """(key, expired_at) for quotes or sessions whose last activity is ``ttl_minutes`` old."""
    rows = offers.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", lateness)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(
        ExpiryProcessor(ttl_minutes * 60 * 1000, kind), f"key {kind}, expired_at timestamp", "Append", "EventTime")


def unique_callbacks(outcomes: DataFrame, keys: Sequence[str], at: str, lateness: str = "1 hour") -> DataFrame:
    """Drops replayed callbacks inside the lateness bound before they reach any state."""
    return outcomes.withWatermark(at, lateness).dropDuplicatesWithinWatermark(list(keys))


def trends_stream(events: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Daily counts as windowed aggregates, one row for each day once the watermark has passed it.

    Two aggregations follow one another: a row for each session and day first, so that distinct
    sessions are counted exactly and a busy session costs one row; the state of both ends with the day.
    """
    kind = F.col("event_type")
    per_session = events.withWatermark(at, lateness).groupBy(F.window(at, "1 day").alias("day"), "session_id").agg(
        F.count(F.when(kind.isin("view", "click"), 1)).alias("questions"), F.count(F.when(kind == "error", 1)).alias("declined"),
        F.count(F.when(kind == "purchase", 1)).alias("handovers"))
    return per_session.groupBy(F.window("day", "1 day").alias("day")).agg(
        F.count("session_id").alias("conversations"), F.sum("questions").alias("questions"), F.sum("declined").alias("declined"),
        F.sum("handovers").alias("handovers")).select(
        F.to_date("day.start").alias("day"), "conversations", "questions", "declined", "handovers")


def append_events(df: DataFrame, path: str, checkpoint: str, partition: str | None = None):
    """Append-only event table as a stream sink that takes what is there and stops."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition:
        writer = writer.partitionBy(partition)
    return writer.trigger(availableNow=True).start(path)


def retention_stream(ticks: DataFrame, sweep, checkpoint: str, every: str = "60 minutes"):
    """Runs ``sweep(epoch)`` once per trigger: the periodic retention job."""
    return (ticks.writeStream.foreachBatch(lambda _, epoch: sweep(epoch)).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())
