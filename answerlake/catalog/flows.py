"""Batch form of the stateful rules, with recursive oracles."""

import re

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog.registry import query
from answerlake.catalog.texts import PLACES
from answerlake.streaming import batch, followups, rules

NUMBERED = """n AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events)"""


def window_sql(limit, window_s):
    w = window_s * 1000000
    keep = f"list_filter(r.kept, lambda k: k > n.us - {w})"
    return f"""WITH RECURSIVE {NUMBERED}, r AS (
  SELECT user_id, rn, event_id, [us] AS kept, true AS allowed, NULL::BIGINT AS retry_after FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.rn, n.event_id, CASE WHEN length({keep}) >= {limit} THEN {keep} ELSE list_append({keep}, n.us) END,
    length({keep}) < {limit}, CASE WHEN length({keep}) >= {limit} THEN greatest(1, CAST(ceil(({keep}[1] + {w} - n.us) / 1000000.0) AS BIGINT)) END
  FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, event_id, allowed, retry_after FROM r"""


# The event log is sparse per user, so the windows here are hours instead of minutes.
@query("rate_limit", "W6 ST1", window_sql(3, 172800))
def _(t):
    return batch.rate_limit(t.events, "user_id", "ts", "event_id", 3, 172800)


@query("lockouts", "W7 ST8", f"""WITH RECURSIVE {NUMBERED}, r AS (
  SELECT user_id, rn, event_id, false AS locked, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS c,
    CASE WHEN event_type IN ('error', 'click') THEN us END AS f, 0::BIGINT AS remaining FROM n WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, locked, CASE WHEN locked THEN c WHEN NOT fails THEN 0 WHEN c0 = 0 OR us - f0 > 86400000000 THEN 1 ELSE c0 + 1 END,
    CASE WHEN locked THEN f WHEN NOT fails THEN NULL WHEN c0 = 0 OR us - f0 > 86400000000 THEN us ELSE f0 END,
    CASE WHEN locked THEN (86400000000 - (us - f)) // 1000000 + 1 ELSE 0 END
  FROM (SELECT n.user_id, n.rn, n.event_id, n.us, n.event_type IN ('error', 'click') AS fails, r.c, r.f, r.c >= 2 AND n.us - r.f < 86400000000 AS locked,
      CASE WHEN r.c >= 2 AND n.us - r.f >= 86400000000 THEN 0 ELSE r.c END AS c0, CASE WHEN r.c >= 2 AND n.us - r.f >= 86400000000 THEN NULL ELSE r.f END AS f0
    FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1))
SELECT user_id, event_id, locked, CAST(c AS BIGINT) AS failures, remaining FROM r""")
def _(t):
    events = t.events.withColumn("failed", F.col("event_type").isin("error", "click"))
    return batch.lockouts(events, "user_id", "ts", "event_id", "failed", 2, 86400)


@query("throttle", "ST12", f"""WITH RECURSIVE {NUMBERED}, r AS (
  SELECT user_id, rn, event_id, us AS last, true AS accepted FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.rn, n.event_id, CASE WHEN n.us - r.last < 21600000000 THEN r.last ELSE n.us END, n.us - r.last >= 21600000000
  FROM r JOIN n ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, event_id, accepted FROM r""")
def _(t):
    return batch.throttle(t.events, "user_id", "ts", "event_id", 21600)


@query("open_attempts", "ST4", f"""WITH RECURSIVE {b.ATTEMPTS}, n AS (SELECT quote_id, id, status, epoch_us(created_at) AS us,
   CASE WHEN id % 3 = 0 THEN epoch_us(created_at + INTERVAL 200 DAY) END AS closes, row_number() OVER (PARTITION BY quote_id ORDER BY epoch_us(created_at), id) AS rn FROM attempts),
r AS (SELECT quote_id, rn, id, true AS created, id AS attempt, CASE WHEN status <> 'failed' THEN id END AS open_id, CASE WHEN status <> 'failed' THEN closes END AS open_until FROM n WHERE rn = 1
  UNION ALL SELECT quote_id, rn, id, status = 'failed' OR NOT blocked, CASE WHEN status <> 'failed' AND blocked THEN open_id ELSE id END,
    CASE WHEN status = 'failed' OR blocked THEN open_id ELSE id END, CASE WHEN status = 'failed' OR blocked THEN open_until ELSE closes END
  FROM (SELECT n.*, r.open_id, r.open_until, r.open_id IS NOT NULL AND (r.open_until IS NULL OR r.open_until > n.us) AS blocked
    FROM r JOIN n ON n.quote_id = r.quote_id AND n.rn = r.rn + 1))
SELECT quote_id, id, created, attempt FROM r""")
def _(t):
    closes = F.when(F.col("id") % 3 == 0, F.col("created_at") + F.make_dt_interval(days=F.lit(200)))
    return batch.dedupe_attempts(b.attempts(t).withColumn("closes_at", closes))


@query("session_memory", "ST3", """WITH m AS (SELECT user_id AS session_id, event_id AS id, epoch_us(ts) AS us,
  CASE WHEN event_type = 'view' THEN props END AS query, CASE WHEN event_type = 'purchase' THEN 'item ' || CAST(event_id AS VARCHAR) END AS item FROM events),
w AS (SELECT *, last_value(query IGNORE NULLS) OVER p AS q, last_value(item IGNORE NULLS) OVER p AS i,
  max(CASE WHEN query IS NOT NULL OR item IS NOT NULL THEN us END) OVER p AS updated FROM m
  WINDOW p AS (PARTITION BY session_id ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, id, CASE WHEN us - updated <= 43200000000 THEN q END AS previous_query, CASE WHEN us - updated <= 43200000000 THEN i END AS previous_item FROM w""")
def _(t):
    kind = F.col("event_type")
    events = t.events.select(
        F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
        F.when(kind == "view", F.col("props")).alias("query"),
        F.when(kind == "purchase", F.concat(F.lit("item "), F.col("event_id").cast("string"))).alias("item"))
    return batch.session_memory(events, 720)


CASE_EVENT = {"signup": "open", "view": "claim", "purchase": "close", "error": "withdraw"}


@query("case_machine", "ST6", f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT *, CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'withdraw' ELSE 'click' END AS e FROM n),
r AS (SELECT user_id, rn, event_id, CASE WHEN e = 'open' THEN 1 ELSE 0 END AS no, NULL::VARCHAR AS before, CASE WHEN e = 'open' THEN 'open' END AS after, e = 'open' AS changed FROM s WHERE rn = 1
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN nxt = 'open' THEN no + 1 ELSE no END, cur, coalesce(nxt, cur), nxt IS NOT NULL
  FROM (SELECT s.user_id, s.rn, s.event_id, r.no, r.after AS cur, CASE
      WHEN e = 'open' AND (r.after IS NULL OR r.after = 'closed') THEN 'open' WHEN e = 'claim' AND r.after = 'open' THEN 'claimed'
      WHEN e IN ('close', 'withdraw') AND r.after IN ('open', 'claimed') THEN 'closed' END AS nxt
    FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1))
SELECT user_id AS key, event_id AS id, CAST(no AS BIGINT) AS case_no, before, after, changed FROM r""")
def _(t):
    named = F.create_map(*[F.lit(v) for pair in CASE_EVENT.items() for v in pair])
    events = t.events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
                             F.coalesce(named[F.col("event_type")], F.lit("click")).alias("event"))
    return batch.run_state_machine(events, rules.CASE_TRANSITIONS, rules.CASE_TERMINAL)


@query("request_lifecycle", "ST7", f"""WITH RECURSIVE {NUMBERED}, s AS (SELECT *, ['start', 'booked', 'name', 'confirm', 'pay', 'complete', 'cancel'][event_id % 7 + 1] AS e FROM n),
r AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0::BIGINT AS no, NULL::BIGINT AS gone, NULL::VARCHAR AS status FROM (SELECT DISTINCT user_id FROM n)
  UNION ALL SELECT s.user_id, s.rn, s.event_id, CASE WHEN e IN ('start', 'booked') AND status IS DISTINCT FROM 'awaiting_booking' THEN no + 1 ELSE no END,
    CASE WHEN (e IN ('start', 'booked') AND status IN ('awaiting_new_name', 'awaiting_confirmation'))
      OR (e = 'cancel' AND status IN ('awaiting_booking', 'awaiting_new_name', 'awaiting_confirmation')) THEN no END,
    CASE e WHEN 'start' THEN 'awaiting_booking' WHEN 'booked' THEN 'awaiting_new_name'
      WHEN 'name' THEN CASE WHEN status = 'awaiting_new_name' THEN 'awaiting_confirmation' ELSE status END
      WHEN 'confirm' THEN CASE WHEN status = 'awaiting_confirmation' THEN 'awaiting_payment' ELSE status END
      WHEN 'pay' THEN CASE WHEN status = 'awaiting_payment' THEN 'submitted' ELSE status END
      WHEN 'complete' THEN CASE WHEN status = 'submitted' THEN 'completed' ELSE status END
      ELSE CASE WHEN status IN ('awaiting_booking', 'awaiting_new_name', 'awaiting_confirmation') THEN 'cancelled' ELSE status END END
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)
SELECT user_id AS session_id, event_id AS id, no AS request_no, gone AS cancelled_no, status FROM r WHERE rn > 0""")
def _(t):
    steps = F.array(*[F.lit(s) for s in ("start", "booked", "name", "confirm", "pay", "complete", "cancel")])
    events = t.events.select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"),
                             F.element_at(steps, (F.col("event_id") % 7 + 1).cast("int")).alias("event"))
    return batch.request_lifecycle(events)


# The seven buckets as they are, their windows in hours instead of seconds as the log is sparse.
BUCKETS = {name: (-(-n // 10), s * 3600) for name, (n, s) in rules.LIMITS.items()}
BUCKET_NAMES = tuple(BUCKETS)


def buckets_sql():
    table = ", ".join(f"('{b}', {n}, {s}000000::BIGINT)" for b, (n, s) in BUCKETS.items())
    keep = "list_filter(r.kept, lambda k: k > n.us - n.w)"
    return f"""WITH RECURSIVE l AS (SELECT * FROM (VALUES {table}) AS v(bucket, most, w)),
n AS (SELECT event_id, user_id, bucket, most, w, epoch_us(ts) AS us, row_number() OVER (PARTITION BY bucket, user_id ORDER BY epoch_us(ts), event_id) AS rn
  FROM (SELECT *, [{", ".join(f"'{b}'" for b in BUCKET_NAMES)}][event_id % 8 + 1] AS bucket FROM events) JOIN l USING (bucket)),
r AS (
  SELECT bucket, user_id, rn, event_id, [us] AS kept, true AS allowed, NULL::BIGINT AS retry_after FROM n WHERE rn = 1
  UNION ALL SELECT n.bucket, n.user_id, n.rn, n.event_id, CASE WHEN length({keep}) >= n.most THEN {keep} ELSE list_append({keep}, n.us) END,
    length({keep}) < n.most, CASE WHEN length({keep}) >= n.most THEN greatest(1, CAST(ceil(({keep}[1] + n.w - n.us) / 1000000.0) AS BIGINT)) END
  FROM r JOIN n ON n.bucket = r.bucket AND n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT bucket, user_id, event_id, allowed, retry_after FROM r"""


@query("bucket_limits", "W6 ST1", buckets_sql())
def _(t):
    names = F.array(*[F.lit(b) for b in BUCKET_NAMES], F.lit(None).cast("string"))
    events = t.events.withColumn("bucket", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")))
    return batch.rate_limits(events, "user_id", "ts", "event_id", batch.limits_table(t.spark, BUCKETS))


def followups_sql():
    """The questions merged one after the other."""
    forms = r"\b(?:" + "|".join(re.escape(p) for p in PLACES.place_forms()) + r")\b"
    codes = r"|(?-i:\b(?:" + "|".join(c.upper() for c in PLACES.place_codes) + r")\b)" if PLACES.place_codes else ""
    place = f"(?:{forms}{codes})"
    fence = "text"
    for phrase in PLACES.not_places:    # a word that no form matches
        fence = f"regexp_replace({fence}, '(?i)\\b((?:{phrase}))\\b', 'ZQZQ\\1', 'g')"
    filler = "[" + ", ".join(f"'{w}'" for w in followups.FILLER) + "]"
    known = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys((*followups.FILLER, *PLACES.place_words()))) + "]"
    slots = [f"(?i)(?:{s})" for s in followups.SLOTS]
    words = "regexp_extract_all(lower(replace(text, 'ZQZQ', '')), '[a-z]+')"
    has = " OR ".join([f"regexp_matches(text, '{s}')" for s in slots] + [f"regexp_matches(text, '(?i){place}')"])
    values = "|".join(f"(?:{s})" for s in followups.SLOTS)
    step = f"""SELECT n.session_id, n.rn, n.id, n.us, n.text, n.us - r.us <= 1800000000 AND n.fu AS follow, r.resolved AS prev,
      regexp_replace(n.text, '{followups.MARKER}', '') AS d FROM r JOIN n ON n.session_id = r.session_id AND n.rn = r.rn + 1"""
    for s in slots:
        both = f"regexp_matches(prev, '{s}') AND regexp_matches(d, '{s}')"
        step = f"""SELECT * REPLACE (CASE WHEN {both} THEN replace(regexp_replace(regexp_replace(prev, '{s}', chr(1)), '{s}', '', 'g'), chr(1), regexp_extract(d, '{s}')) ELSE prev END AS prev,
      CASE WHEN {both} THEN regexp_replace(d, '{s}', '', 'g') ELSE d END AS d) FROM ({step})"""
    step = f"SELECT * REPLACE (trim(regexp_replace(prev, '\\s{{2,}}', ' ', 'g')) AS prev, trim(regexp_replace(d, '\\s{{2,}}', ' ', 'g'), ' ,') AS d) FROM ({step})"
    step = f"SELECT * REPLACE (CASE WHEN length(list_filter(regexp_extract_all(lower(d), '[a-z]+'), lambda w: NOT list_contains({filler}, w))) = 0 THEN '' ELSE d END AS d) FROM ({step})"
    step = f"SELECT * REPLACE (CASE WHEN regexp_matches(d, '^(?i){place}') THEN 'to ' || d ELSE d END AS d) FROM ({step})"
    ends = "string_split(regexp_replace({0}, '(?i)(\\bfrom\\s+" + place + ")', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    ends = ends
    step = f"SELECT *, {ends.format('d')} AS dp, {ends.format('prev')} AS pp FROM ({step})"
    step = f"SELECT *, length(dp) > 1 AS has_from, length(list_filter(dp, lambda p, i: i % 2 = 1 AND regexp_matches(p, '(?i){place}'))) > 0 AS has_to FROM ({step})"
    cut = f"regexp_replace(p, '(?i)(?:\\b(?:to|for|from|in|at|into)\\s+)?{place}', '', 'g')"
    step = f"""SELECT *, array_to_string(list_transform(pp, lambda p, i: CASE WHEN i % 2 = 0 THEN CASE WHEN has_from THEN '' ELSE p END WHEN has_to THEN {cut} ELSE p END), '') AS left_over FROM ({step})"""
    squeezed = "trim(regexp_replace(regexp_replace(left_over, '\\s+([?.!,])', '\\1', 'g'), '\\s{2,}', ' ', 'g'))"
    step = f"SELECT *, CASE WHEN has_from OR has_to THEN {squeezed} ELSE prev END AS merged FROM ({step})"
    return f"""WITH RECURSIVE {b.MESSAGES}, said AS ({SAID_SQL}),
n AS (SELECT *, coalesce(regexp_matches(text, '{followups.OPENED}') OR (length({words}) BETWEEN 1 AND 6 AND ({has})
    AND length(list_filter({words}, lambda w: NOT list_contains({known}, w) AND NOT regexp_full_match(w, '{values}'))) = 0), false) AS fu
  FROM (SELECT session_id, id, us, row_number() OVER (PARTITION BY session_id ORDER BY us, id) AS rn, {fence} AS text FROM said)),
r AS (SELECT session_id, rn, id, us, false AS follow_up, text AS resolved FROM n WHERE rn = 1
  UNION ALL SELECT session_id, rn, id, us, follow, CASE WHEN follow THEN array_to_string(list_filter([rtrim(merged, ' ?.!'), rtrim(d, ' ?.!')], lambda p: length(p) > 0), ' ') || '?' ELSE text END
  FROM ({step}))
SELECT session_id, id, follow_up, replace(resolved, 'ZQZQ', '') AS resolved FROM r"""


# Whole messages with a journey behind them; every fourth continues with a new destination.
SAID_SQL = """SELECT session_id, id, epoch_us(created_at) AS us, CASE WHEN turn % 4 = 2 THEN 'And to nation_' || CAST(id % 25 AS VARCHAR) || ': ' || message
    WHEN id % 5 = 0 THEN 'Business class from nation_' || CAST(id % 25 AS VARCHAR) || '?'
    ELSE message || ' in economy from nation_1 to nation_' || CAST(id % 25 AS VARCHAR) || '?' END AS text FROM messages WHERE role = 'user'"""


@query("resolved_followups", "T30", followups_sql())
def _(t):
    said = b.messages(t).filter("role = 'user'")
    nation = F.concat(F.lit("nation_"), (F.col("id") % 25).cast("string"))
    text = (F.when(F.col("turn") % 4 == 2, F.concat(F.lit("And to "), nation, F.lit(": "), F.col("message")))
            .when(F.col("id") % 5 == 0, F.concat(F.lit("Business class from "), nation, F.lit("?")))
            .otherwise(F.concat("message", F.lit(" in economy from nation_1 to "), nation, F.lit("?"))))
    return followups.resolve_followups(said.select("session_id", F.col("created_at").alias("at"), "id", text.alias("message")), PLACES)


@query("quote_expiry", "ST5", """SELECT user_id, strftime(max(ts) + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS expires_at,
  max(ts) + INTERVAL 15 MINUTE <= TIMESTAMP '2024-01-30 12:00:00' AS expired FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def _(t):
    from answerlake.operators.ledger import QUOTE_TTL_MINUTES, is_expired
    due = F.max(F.col("ts").cast("timestamp_ntz")) + F.make_dt_interval(mins=F.lit(QUOTE_TTL_MINUTES))
    last = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(due.alias("due"))
    return last.select("user_id", b.stamp("due").alias("expires_at"),
                       is_expired(F.col("due"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).alias("expired"))


@query("daily_counts", "ST10", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS conversations,
  count(*) FILTER (WHERE event_type IN ('view', 'click')) AS questions, count(*) FILTER (WHERE event_type = 'error') AS declined,
  count(*) FILTER (WHERE event_type = 'purchase') AS handovers FROM events GROUP BY 1""")
def _(t):
    kind = F.col("event_type")
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.countDistinct("user_id").alias("conversations"), F.count(F.when(kind.isin("view", "click"), 1)).alias("questions"),
        F.count(F.when(kind == "error", 1)).alias("declined"), F.count(F.when(kind == "purchase", 1)).alias("handovers"))
