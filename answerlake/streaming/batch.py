"""Batch form of the stateful rules: a bounded table in, the stream's rows out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.streaming import rules
from answerlake.streaming.sequences import apply_to, state_before, walk_islands, with_islands


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _typed(df: DataFrame, key: str):
    return df.schema[key].dataType.simpleString()


def rate_limit(df: DataFrame, key: str, at: str, ident: str, limit: int, window_s: int) -> DataFrame:
    """One rule for all keys: (key, ident, allowed, retry_after)."""
    rule = df.sparkSession.createDataFrame([("all", limit, window_s)], "bucket string, max_events int, window_s int")
    return rate_limits(df.withColumn("bucket", F.lit("all")), key, at, ident, rule).select(key, ident, "allowed", "retry_after")


def limits_table(spark, limits: Mapping[str, tuple[int, int]] = rules.LIMITS) -> DataFrame:
    return spark.createDataFrame([(b, n, s) for b, (n, s) in limits.items()], "bucket string, max_events int, window_s int")


def rate_limits(df: DataFrame, key: str, at: str, ident: str, limits: DataFrame) -> DataFrame:
    """Every bucket's own limit in one pass: (bucket, key, ident, allowed, retry_after). ``limits``
    has bucket, max_events and window_s. Rows without a key or of an unknown bucket aren't limited
    and aren't returned."""
    rows = df.filter(F.col(key).isNotNull()).join(F.broadcast(limits), "bucket").select(
        "bucket", key, _micros(at).alias("at"), ident, "max_events", "window_s")
    rows = with_islands(rows, ["bucket", key], F.col("window_s").cast("long") * rules.SECOND)
    schema = f"bucket string, {key} {_typed(df, key)}, {ident} {_typed(df, ident)}, allowed boolean, retry_after bigint"
    return walk_islands(rows, ["bucket", key], ["at", ident], rules.bucket_windows(), schema)


def lockouts(df: DataFrame, key: str, at: str, ident: str, failed: str, n: int = 5, seconds: int = 300) -> DataFrame:
    rows = df.select(key, _micros(at).alias("at"), ident, failed)
    # a pause of just the span still counts towards the first failure
    rows = with_islands(rows, [key], F.lit(seconds * rules.SECOND + 1))
    schema = f"{key} {_typed(df, key)}, {ident} {_typed(df, ident)}, locked boolean, failures bigint, remaining bigint"
    return walk_islands(rows, [key], ["at", ident], rules.lockout(n, seconds), schema)


def throttle(df: DataFrame, key: str, at: str, ident: str, seconds: int = rules.MIN_REQUERY_SECONDS) -> DataFrame:
    rows = with_islands(df.select(key, _micros(at).alias("at"), ident), [key], F.lit(seconds * rules.SECOND))
    schema = f"{key} {_typed(df, key)}, {ident} {_typed(df, ident)}, accepted boolean"
    return walk_islands(rows, [key], ["at", ident], rules.throttle(seconds), schema)


def dedupe_attempts(attempts: DataFrame) -> DataFrame:
    """``attempts`` has quote_id, created_at, id, status and closes_at (NULL while open).

    A quote's islands end where every attempt that could block has closed: where the latest
    closing time so far is over. Until then a quote is a few attempts, walked in order.
    """
    never = F.lit((1 << 63) - 1)
    blocks = F.col("status").isin("pending", "paid")
    rows = attempts.select("quote_id", _micros("created_at").alias("at"), "id", "status", _micros("closes_at").alias("closes_at"))
    order = W.partitionBy("quote_id").orderBy("at", "id")
    until = F.max(F.when(blocks, F.coalesce("closes_at", never))).over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = F.when(F.coalesce(until <= F.col("at"), F.lit(True)), F.col("at"))
    rows = rows.withColumn("begun", begun).withColumn(
        "island", F.last("begun", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("begun")
    schema = f"quote_id string, id {_typed(attempts, 'id')}, created boolean, attempt {_typed(attempts, 'id')}"
    return walk_islands(rows, ["quote_id"], ["at", "id"], rules.one_open_attempt(), schema)


def session_memory(events: DataFrame, ttl_minutes: int = rules.MEMORY_MINUTES) -> DataFrame:
    """``events`` has session_id, at, id, query and item. What is remembered when an event arrives
    is the last value of each kind, unless the last of any is older than the time to live."""
    earlier = W.partitionBy("session_id").orderBy("at", "id").rowsBetween(W.unboundedPreceding, -1)
    said = F.col("query").isNotNull() | F.col("item").isNotNull()
    rows = events.select("session_id", _micros("at").alias("at"), "id", "query", "item")
    rows = rows.withColumns({
        "q": F.last("query", ignorenulls=True).over(earlier), "i": F.last("item", ignorenulls=True).over(earlier),
        "updated": F.last(F.when(said, F.col("at")), ignorenulls=True).over(earlier)})
    fresh = F.col("at") - F.col("updated") <= ttl_minutes * 60 * rules.SECOND
    return rows.select("session_id", "id", F.when(fresh, F.col("q")).alias("previous_query"), F.when(fresh, F.col("i")).alias("previous_item"))


def _functions(event: Column, table: Mapping[str, list[tuple[int, int]]], states: int) -> Column:
    """An event's function as an array of (to, add); an event without one changes nothing."""
    def packed(moves) -> Column:
        return F.array(*[F.struct(F.lit(to).alias("to"), F.lit(add).cast("long").alias("add")) for to, add in moves])

    known = F.create_map(*[x for name, moves in table.items() for x in (F.lit(name), packed(moves))])
    return F.coalesce(F.element_at(known, event), packed([(s, 0) for s in range(states)]))


def run_state_machine(events: DataFrame, transitions, terminal) -> DataFrame:
    """``events`` has key, at, id and event."""
    names = [None, *sorted({a for a in transitions.values()} | {b for b, _ in transitions if b is not None})]
    number = {n: i for i, n in enumerate(names)}
    table = {}
    for event in {e for _, e in transitions}:
        moves = []
        for name in names:
            before = None if name in terminal else name
            after = transitions.get((before, event))
            moves.append((number[name], 0) if after is None else (number[after], int(before is None)))
        table[event] = moves
    rows = events.select("key", _micros("at").alias("at"), "id", "event").withColumn("function", _functions(F.col("event"), table, len(names)))
    rows = state_before(rows, "key", ["at", "id"], F.col("function"), len(names))
    rows = rows.withColumn("after", apply_to(F.col("function"), F.col("state")))
    named = F.array(*[F.lit(n).cast("string") for n in names])
    changes = F.lit(False)
    for event in sorted(table):
        froms = [number[b] for b in names if (None if b in terminal else b, event) in transitions]
        changes = changes | ((F.col("event") == event) & F.col("state.at").isin(*froms))
    return rows.select("key", "id", F.col("after.n").alias("case_no"), F.element_at(named, F.col("state.at") + 1).alias("before"),
                       F.element_at(named, F.col("after.at") + 1).alias("after"), F.coalesce(changes, F.lit(False)).alias("changed"))


def request_lifecycle(events: DataFrame) -> DataFrame:
    """``events`` has session_id, at, id and event."""
    names = [None, *rules.REQUEST_STATES]
    number = {n: i for i, n in enumerate(names)}
    table = {}
    for event in rules.REQUEST_EVENTS:
        moves = []
        for name in names:
            status, opened, _ = rules.request_move(name, event)
            moves.append((number[status], int(opened)))
        table[event] = moves
    rows = events.select("session_id", _micros("at").alias("at"), "id", "event").withColumn("function", _functions(F.col("event"), table, len(names)))
    rows = state_before(rows, "session_id", ["at", "id"], F.col("function"), len(names))
    rows = rows.withColumn("after", apply_to(F.col("function"), F.col("state")))
    named = F.array(*[F.lit(n).cast("string") for n in names])
    ends = F.lit(False)
    for event in rules.REQUEST_EVENTS:
        froms = [number[n] for n in names if rules.request_move(n, event)[2]]
        if froms:
            ends = ends | ((F.col("event") == event) & F.col("state.at").isin(*froms))
    return rows.select("session_id", "id", F.col("after.n").alias("request_no"), F.when(ends, F.col("state.n")).alias("cancelled_no"),
                       F.element_at(named, F.col("after.at") + 1).alias("status"))

