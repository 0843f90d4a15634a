"""Stream form against batch form, on the event log and on small hand-made tables."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from answerlake.streaming import batch, followups, rules, streams
from answerlake.streaming.sequences import with_islands


def as_stream(spark, df, folder, files=3, order="at"):
    """The table as a file stream: ``files`` files in time order, one per micro-batch."""
    path = str(folder / "in")
    ranged = df.repartitionByRange(files, order).withColumn("slice", F.spark_partition_id()).cache()
    for i in range(files):
        ranged.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled(spark, df, folder, at="at", key="user_id"):
    """The table in three files of any order, and last rows far in the future of a key of their own:
    the first lets the events out, the second lets the state end."""
    path = str(folder / ("in" + uuid.uuid4().hex))
    for i in range(3):
        df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    for year in ("2034", "2035"):
        end = df.limit(1).withColumns({at: F.lit(f"{year}-01-01").cast("timestamp"), key: F.lit(-1).cast(df.schema[key].dataType)})
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


LATE = "60 days"        # of the whole log


def drain(spark, stream, folder, mode="append"):
    name = "t" + uuid.uuid4().hex
    query = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    out = spark.table(name)
    return out.filter(~F.col(out.columns[0]).cast("string").isin("-1", "Q-1", "2034-01-01"))     # the far future's


@pytest.fixture(scope="module")
def events(tables):
    return tables.events.select("event_id", "user_id", "event_type", "props", "value", F.col("ts").cast("timestamp").alias("at"))


def test_rate_limit_stream_equals_batch(spark, events, tmp_path, rows):
    out = drain(spark, streams.rate_limit_stream(shuffled(spark, events, tmp_path), "user_id", "at", "event_id", 2, 172800, LATE), tmp_path)
    want = batch.rate_limit(events, "user_id", "at", "event_id", 2, 172800)
    assert rows(out) == rows(want) and out.filter("NOT allowed").count() > 0


def test_throttle_stream_ends_its_state(spark, events, tmp_path, rows):
    name = "t" + uuid.uuid4().hex
    stream = streams.throttle_stream(shuffled(spark, events, tmp_path), "user_id", "at", "event_id", 86400, LATE)
    query = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
             .trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert rows(spark.table(name).filter("user_id >= 0")) == rows(batch.throttle(events, "user_id", "at", "event_id", 86400))
    held = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / name))
    assert held.filter("key.user_id >= 0").count() == 0


def test_machine_stream_equals_batch(spark, events, tmp_path, rows):
    shape = lambda df: df.select(
        F.col("user_id").alias("key"), "at", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "view", "claim").otherwise("close").alias("event"))
    stream = shape(shuffled(spark, events, tmp_path))
    out = drain(spark, streams.state_machine_stream(stream, rules.CASE_TRANSITIONS, rules.CASE_TERMINAL, LATE), tmp_path)
    assert rows(out) == rows(batch.run_state_machine(shape(events), rules.CASE_TRANSITIONS, rules.CASE_TERMINAL))


def test_memory_and_lockout_streams_equal_batch(spark, events, tmp_path, rows):
    stream = shuffled(spark, events, tmp_path)
    shape = lambda df: df.select(
        F.col("user_id").alias("session_id"), "at", F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("query"), F.lit(None).cast("string").alias("item"))
    out = drain(spark, streams.session_memory_stream(shape(stream), 2880, LATE), tmp_path)
    assert rows(out) == rows(batch.session_memory(shape(events), 2880))
    failed = lambda df: df.withColumn("failed", F.col("event_type") != "view")
    out = drain(spark, streams.lockouts_stream(failed(stream), "user_id", "at", "event_id", "failed", 2, 172800, LATE), tmp_path)
    assert rows(out) == rows(batch.lockouts(failed(events), "user_id", "at", "event_id", "failed", 2, 172800))


def test_requests_and_attempts_streams_equal_batch(spark, events, tmp_path, rows):
    stream = shuffled(spark, events, tmp_path)
    steps = F.array(*[F.lit(s) for s in ("start", "booked", "name", "confirm", "pay", "complete", "cancel")])
    shape = lambda df: df.select(F.col("user_id").alias("session_id"), "at", F.col("event_id").alias("id"),
                                 F.element_at(steps, (F.col("event_id") % 7 + 1).cast("int")).alias("event"))
    out = drain(spark, streams.request_lifecycle_stream(shape(stream), LATE), tmp_path)
    assert rows(out) == rows(batch.request_lifecycle(shape(events)))
    tries = lambda df: df.select(
        F.concat(F.lit("Q"), F.when(F.col("user_id") < 0, -1).otherwise(F.col("user_id") % 9).cast("string")).alias("quote_id"),
        F.col("at").alias("created_at"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"),
        F.when(F.col("event_id") % 2 == 0, F.col("at") + F.expr("INTERVAL 1 DAY")).alias("closes_at"))
    out = drain(spark, streams.dedupe_attempts_stream(tries(stream), LATE), tmp_path)
    assert rows(out) == rows(batch.dedupe_attempts(tries(events)))


def stepped(df, key, step, width):
    """A rule's step over whole keys, one row after the other."""
    out, state = [], {}
    for r in sorted(df.collect(), key=lambda r: r[1:3]):
        state[r[0]], made = step(state.get(r[0]), tuple(r)[:width])
        out.append(made)
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "window"), [(1, 3600), (2, 86400), (5, 864000)])
def test_islands_equal_whole_keys(events, rows, limit, window):
    """Every key hot, with and without pauses."""
    one = events.withColumn("user_id", F.col("user_id") % 2)
    flat = one.select("user_id", F.unix_micros("at").alias("at"), "event_id", (F.col("event_type") != "view").alias("failed"))
    assert rows(batch.rate_limit(one, "user_id", "at", "event_id", limit, window)) == stepped(flat, 0, rules.sliding_window(limit, window), 3)
    assert rows(batch.throttle(one, "user_id", "at", "event_id", window)) == stepped(flat, 0, rules.throttle(window), 3)
    failed = one.withColumn("failed", F.col("event_type") != "view")
    assert rows(batch.lockouts(failed, "user_id", "at", "event_id", "failed", limit, window)) == stepped(flat, 0, rules.lockout(limit, window), 4)


def test_islands_begin_after_pauses(spark, rows):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 15), ("a", 15), ("a", 40), ("b", 3), (None, 1), (None, 30)], "k string, at long")
    for slice_us in (1, 4, 7, 1000):
        got = rows(with_islands(df, ["k"], F.lit(10), slice_us), "k", "at", "island")
        assert got == sorted([("a", 0, 0), ("a", 5, 0), ("a", 15, 15), ("a", 15, 15), ("a", 40, 40), ("b", 3, 3), (None, 1, 1), (None, 30, 30)], key=str)


def test_buckets_have_their_own_limits(spark, rows):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    made = [("poll_session", "u", t(i // 3), i) for i in range(400)] + [("mobile_phone", "u", t(i * 50), 1000 + i) for i in range(30)] + [
        ("mobile_phone", None, t(1), 5000), ("other", "u", t(1), 5001)]
    df = spark.createDataFrame(made, "bucket string, who string, at timestamp, id long")
    got = rows(batch.rate_limits(df, "who", "at", "id", batch.limits_table(spark)), "bucket", "id", "allowed")
    want = []
    for name in ("poll_session", "mobile_phone"):
        step, state = rules.sliding_window(*rules.LIMITS[name]), None
        for _, who, at, ident in (m for m in made if m[0] == name and m[1]):
            state, out = step(state, (who, int((at - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), ident))
            want.append((name, ident, out[2]))
    assert got == sorted(want, key=str) and {a for _, _, a in got} == {True, False}


def test_scanned_states_equal_stepping(spark, events, rows):
    """One key over many slices of slices, and many keys."""
    for keys in (1, 40):
        shape = events.select((F.col("event_id") % keys).alias("key"), F.unix_micros("at").alias("us"), F.col("event_id").alias("id"),
                              F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "view", "claim").otherwise("close").alias("event"), "at")
        got = batch.run_state_machine(shape.drop("us"), rules.CASE_TRANSITIONS, rules.CASE_TERMINAL)
        assert rows(got) == stepped(shape, 0, rules.machine(rules.CASE_TRANSITIONS, rules.CASE_TERMINAL), 4)
    steps = F.array(*[F.lit(s) for s in (*rules.REQUEST_EVENTS, "other")])
    shape = events.select((F.col("event_id") % 3).alias("session_id"), F.unix_micros("at").alias("us"), F.col("event_id").alias("id"),
                          F.element_at(steps, (F.hash("event_id") % 4 + 5).cast("int")).alias("event"), "at")
    assert rows(batch.request_lifecycle(shape.drop("us"))) == stepped(shape, 0, rules.request_lifecycle(), 4)


def _payments(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    schema = "id long, at timestamp, kind string, status string, amount_minor long, currency string, receipt string"
    return spark.createDataFrame([
        (1, t(0), "attempt", "pending", 100, "KES", None), (1, t(2), "outcome", "paid", 100, "kes", None),
        (1, t(3), "outcome", "paid", 100, "KES", "R1"), (1, t(4), "outcome", "failed", 100, "KES", None),
        (2, t(0), "attempt", "pending", 100, "KES", None), (2, t(1), "outcome", "paid", 90, "KES", "R2"),
        (3, t(0), "attempt", "pending", 100, "KES", None), (4, t(0), "attempt", "simulated", 100, "KES", None),
        (4, t(1), "outcome", "paid", 100, "KES", "R4"), (9, t(50), "attempt", "failed", 1, "KES", None),
        (10, t(59), "attempt", "failed", 1, "KES", None)], schema)


def test_payment_stream_settles_once_and_expires(spark, tmp_path):
    out = drain(spark, streams.payment_states_stream(as_stream(spark, _payments(spark), tmp_path, 4), 10, "5 minutes"), tmp_path)
    by = {}
    for r in out.orderBy("at").collect():
        by.setdefault(r.id, []).append((r.status, r.receipt))
    assert by[1] == [("pending", None), ("paid", None), ("paid", "R1")]
    assert by[2][-1] == ("needs_review", "R2")
    assert by[3] == [("pending", None), ("expired", None)]
    assert by[4] == [("simulated", None)]


def test_payment_stream_equals_batch_on_early_late_and_shuffled_outcomes(spark, tmp_path):
    from answerlake.operators import ledger

    t = lambda m, s=0: dt.datetime(2024, 1, 1, 10, m, s)
    rows = [
        # id, minute of arrival, kind, at, status, amount, currency, method, receipt, seq
        (1, 0, "outcome", t(2), "paid", 100, None, "mobile", "E1", "a"), (1, 1, "attempt", t(3), "pending", 100, "KES", "mobile", None, ""),
        (2, 0, "attempt", t(0), "pending", 100, "KES", "card", None, ""), (2, 1, "outcome", t(5), "paid", 100, None, "card", "C2", "a"),
        (3, 0, "attempt", t(0), "pending", 100, "KES", "mobile", None, ""), (3, 2, "outcome", t(20), "paid", 100, None, "mobile", "M3", "a"),
        (4, 0, "attempt", t(0), "pending", 100, "KES", "mobile", None, ""), (4, 0, "outcome", t(6), "paid", 100, None, "mobile", None, "a"),
        (4, 1, "outcome", t(4), "failed", None, None, "mobile", None, "b"),
        (5, 0, "attempt", t(0), "pending", 100, "KES", "mobile", None, ""), (5, 0, "outcome", t(4), "paid", 100, None, "mobile", None, "b"),
        (5, 1, "outcome", t(5), "paid", 100, None, "mobile", "L5", "c"), (5, 1, "outcome", t(4, 30), "paid", 99, None, "mobile", "X5", "a"),
        (6, 0, "attempt", t(0), "pending", 100, "KES", "mobile", None, ""), (6, 0, "outcome", t(4), "cancelled", None, None, "mobile", None, "b"),
        (6, 0, "outcome", t(4), "paid", 100, None, "mobile", "S6", "a"),
        (9, 3, "attempt", t(50), "failed", 1, "KES", "card", None, ""), (9, 4, "attempt", t(59), "failed", 1, "KES", "card", None, "")]
    df = spark.createDataFrame(rows, "id long, arrival int, kind string, at timestamp, status string, amount_minor long, currency string, "
                                     "method string, receipt string, seq string")
    out = drain(spark, streams.payment_states_stream(as_stream(spark, df, tmp_path, 5, "arrival"), 10, "30 minutes"), tmp_path)
    last = {}
    for r in out.collect():
        last.setdefault(r.id, []).append((r.status, r.receipt))
    tries = df.filter("kind = 'attempt'").withColumn("created_at", F.col("at"))
    outcomes = df.filter("kind = 'outcome'").select(
        F.col("id").alias("attempt_id"), "seq", F.col("status").alias("outcome"), (F.col("amount_minor") / 100).alias("reported"),
        F.col("currency").alias("reported_currency"), "receipt", "at")
    want = {r.id: (r.after, r.receipt) for r in ledger.payment_states(tries, outcomes).collect() if r.id != 9}
    assert want == {1: ("paid", "E1"), 2: ("needs_review", "C2"), 3: ("expired", None), 4: ("failed", None), 5: ("paid", "L5"), 6: ("paid", "S6")}
    assert {k: v[-1] for k, v in last.items() if k != 9} == want


def test_expiry_stream_reports_idle_keys(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([("a", t(0)), ("a", t(10)), ("b", t(1)), ("z", t(45)), ("z", t(58))], "k string, at timestamp")
    out = drain(spark, streams.expire_stream(as_stream(spark, df, tmp_path, 4), "k", "at", 15), tmp_path)
    assert {(r.key, r.expired_at.minute) for r in out.collect()} == {("a", 25), ("b", 16)}


def test_replayed_callbacks_are_dropped(spark, tmp_path):
    df = _payments(spark)
    out = drain(spark, streams.unique_callbacks(as_stream(spark, df.union(df), tmp_path), ["id", "status", "receipt", "kind"], "at"), tmp_path)
    assert out.count() == df.dropDuplicates(["id", "status", "receipt", "kind"]).count()


def test_confirmations_are_a_third_input(spark, tmp_path):
    """An unconfirmed success leaves its attempt pending for what comes after it, as in the batch."""
    from answerlake.operators import ledger

    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    tries = spark.createDataFrame(
        [(i, t(0), "pending", 100, "KES", "card" if i == 6 else "mobile") for i in range(1, 8)] + [(99, dt.datetime(2034, 1, 1), "failed", 1, "KES", "card")],
        "id long, at timestamp, status string, amount_minor long, currency string, method string")
    said = [(1, t(2), "paid", 100, "R1", "a"), (2, t(2), "paid", 100, "R2", "a"), (3, t(2), "paid", 100, "R3", "a"), (3, t(4), "failed", None, None, "b"),
            (4, t(2), "paid", 90, "R4", "a"), (5, t(2), "paid", 100, "R5", "a"), (5, t(3), "failed", None, None, "b"), (6, t(2), "paid", 100, "R6", "a")]
    outcomes = spark.createDataFrame([(i, at, s, m, "KES", r, q) for i, at, s, m, r, q in said],
                                     "id long, at timestamp, status string, amount_minor long, currency string, receipt string, seq string")
    agreed = spark.createDataFrame([(1, t(1)), (5, t(6))], "id long, at timestamp")

    def stream(df, name, files, order="at"):
        folder = tmp_path / name
        folder.mkdir()
        return as_stream(spark, df, folder, files, order)
    changes = streams.payment_changes(stream(tries, "tries", 2), stream(outcomes, "outcomes", 1), stream(agreed, "agreed", 1))
    out = drain(spark, streams.payment_states_stream(changes, 10, "30 minutes", confirm=True), tmp_path)
    last = {}
    for r in out.collect():
        last.setdefault(r.id, []).append((r.status, r.receipt))
    got = {k: v[-1] for k, v in last.items() if k != 99}
    assert got == {1: ("paid", "R1"), 2: ("expired", None), 3: ("failed", None), 4: ("needs_review", "R4"), 5: ("paid", "R5"),
                   6: ("paid", "R6"), 7: ("expired", None)}
    keyed = tries.filter("id < 99").select("id", "method", F.col("id").cast("string").alias("checkout_id"), "status", "amount_minor", "currency")
    batch_out = ledger.apply_outcomes(keyed, outcomes.join(keyed.select("id", "method", "checkout_id"), "id").select(
        "method", "checkout_id", F.col("status").alias("outcome"), (F.col("amount_minor") / 100).alias("reported"),
        F.col("currency").alias("reported_currency"), "receipt", "seq"), agreed.select(F.lit("mobile").alias("method"), F.col("id").cast("string").alias("checkout_id")))
    want = {r.id: ("expired" if r.after == "pending" else r.after, r.receipt) for r in batch_out.collect()}
    assert got == want


def test_trend_stream_equals_batch(spark, events, tmp_path, rows):
    shape = lambda df: df.withColumn("session_id", F.col("user_id"))
    out = drain(spark, streams.trends_stream(shape(shuffled(spark, events, tmp_path)), lateness=LATE), tmp_path)
    want = shape(events).groupBy(F.to_date("at").alias("day")).agg(
        F.countDistinct("session_id").alias("conversations"), F.count(F.when(F.col("event_type").isin("view", "click"), 1)).alias("questions"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("declined"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("handovers"))
    assert rows(out) == rows(want.select(*out.columns))


def test_event_sink_appends_once(spark, events, tmp_path):
    stream = as_stream(spark, events, tmp_path)
    for _ in range(2):
        streams.append_events(stream, str(tmp_path / "out"), str(tmp_path / "check"), "event_type").awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


TALKS = [
    [("How many bags can I check in Economy from Oslo to London?", None),
     ("What about Business class?", "How many bags can I check in Business class from Oslo to London?"),
     ("Same for Paris", "How many bags can I check in Business class from Oslo to Paris?"),
     ("And from Dubai?", "How many bags can I check in Business class to Paris from Dubai?"),
     ("And with a dog?", "How many bags can I check in Business class to Paris from Dubai with a dog?"),
     ("also flights please", "How many bags can I check in Business class to Paris from Dubai with a dog?"),
     ("How long does a refund take for a lost bag today?", None)],
    [("When do international check-in counters close?", None), ("What about domestic flights?", "When do domestic check-in counters close?"),
     ("And to Paris in economy", "When do domestic check-in counters close to Paris in economy?"),
     ("first class?", "When do domestic check-in counters close to Paris in first class?")],
    [("Business or economy from Oslo?", None), ("And first class?", "first class or from Oslo?")],
    [("", None), (None, None), ("And?", "?")],
]


def test_follow_ups_are_completed_from_their_chain(spark):
    from answerlake.functions.vocabulary import Vocabulary
    vocab = Vocabulary(places={"london": (), "dubai": (), "paris": (), "oslo": ()})
    said = [(s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, m) for s, talk in enumerate(TALKS) for i, (m, _) in enumerate(talk)]
    df = spark.createDataFrame(said, "session_id long, at timestamp, id long, message string")
    got = {(r.session_id, r.id): (r.follow_up, r.resolved) for r in followups.resolve_followups(df, vocab).collect()}
    assert got == {(s, i): (w is not None, w if w is not None else m or "") for s, talk in enumerate(TALKS) for i, (m, w) in enumerate(talk)}
    late = df.withColumn("at", F.col("at") + F.col("id") * F.expr("INTERVAL 1 HOUR"))
    assert not followups.resolve_followups(late, vocab).filter("follow_up").count()


def test_follow_ups_close_up_across_messages(spark):
    from answerlake.functions.vocabulary import Vocabulary
    vocab = Vocabulary(places={"oslo": (), "rome": ()})
    said = [(1, "\nBags in economy , to oslo"), (2, "and to rome")]
    rows = spark.createDataFrame(said, "id long, message string").selectExpr(
        "1L AS session_id", "id", "message", "timestamp_seconds(id) AS at")
    got = {r.id: r.resolved for r in followups.resolve_followups(rows, vocab).collect()}
    assert got[2] == "\nBags in economy, to rome?"
