"""Review-desk queries."""

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog.registry import query
from answerlake.operators import review

DECL = " OR ".join(f"starts_with(message, '{p}')" for p in b.DECLINED)

ROLLUP = f"""rollup AS (
  SELECT m.*, s.min_groundedness, s.min_relevance, coalesce(c.handovers, 0) AS handovers FROM (
    SELECT session_id, min(created_at) AS started_at, max(created_at) AS last_at,
      CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS questions,
      max(CASE WHEN role = 'user' THEN frustration_score END) AS max_frustration,
      CAST(sum(CASE WHEN feedback = 'up' THEN 1 ELSE 0 END) AS BIGINT) AS rated_up,
      CAST(sum(CASE WHEN feedback = 'down' THEN 1 ELSE 0 END) AS BIGINT) AS rated_down,
      CAST(sum(CASE WHEN role = 'assistant' AND ({DECL}) THEN 1 ELSE 0 END) AS BIGINT) AS declined
    FROM messages GROUP BY session_id) m
  LEFT JOIN (SELECT session_id, min(groundedness) AS min_groundedness, min(answer_relevance) AS min_relevance
             FROM scores WHERE metric_version = 2 GROUP BY session_id) s USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS handovers FROM cases GROUP BY session_id) c USING (session_id))"""
BASE = f"WITH {b.MESSAGES}, {b.SCORES}, {b.CASES}, {ROLLUP}"
ROLLUP_COLUMNS = """session_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at,
  questions, max_frustration, rated_up, rated_down, declined, min_groundedness, min_relevance, handovers"""
FLAGS = """concat_ws(',', CASE WHEN min_groundedness < 0.9 THEN 'low' END, CASE WHEN rated_down > 0 THEN 'down' END,
  CASE WHEN max_frustration >= 0.55 THEN 'frustrated' END, CASE WHEN handovers > 0 THEN 'handover' END,
  CASE WHEN declined > 0 THEN 'declined' END) AS flags"""


def rollup(t):
    return review.conversation_rollup(b.messages(t), b.scores(t), b.cases(t), b.DECLINED)


def readable(df):
    return df.withColumns({c: b.stamp(c) for c in ("started_at", "last_at") if c in df.columns})


@query("conversation_rollup", "A1 J4 P4 P5 W1", f"""{BASE}
SELECT {ROLLUP_COLUMNS},
  (SELECT arg_min(message, id) FROM messages m WHERE m.session_id = r.session_id AND role = 'user') AS first_question
FROM rollup r""")
def _(t):
    return readable(rollup(t))


@query("conversation_flags", "P3 P6", f"""{BASE}
SELECT session_id, left(CAST(session_id AS VARCHAR), 8) AS short_id, {FLAGS} FROM rollup""")
def _(t):
    return review.flag(rollup(t)).select(
        "session_id", review.short_id(F.col("session_id")).alias("short_id"),
        F.array_join("flags", ",").alias("flags"))


@query("conversation_flag_filter", "P3", f"""{BASE}
SELECT session_id, max_frustration, questions FROM rollup WHERE max_frustration >= 0.55""")
def _(t):
    return review.with_flag(review.flag(rollup(t)), "frustrated").select("session_id", "max_frustration", "questions")


@query("conversation_search", "J1", f"""{BASE}
SELECT session_id, questions FROM rollup
WHERE session_id IN (SELECT session_id FROM messages WHERE contains(lower(message), 'ation'))""")
def _(t):
    return review.search_sessions(rollup(t), b.messages(t), " Ation ").select("session_id", "questions")


@query("conversation_page", "L1 A19", f"""{BASE}
SELECT session_id, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, (SELECT count(*) FROM rollup) AS total
FROM rollup ORDER BY rollup.last_at DESC, session_id DESC LIMIT 25 OFFSET 25""")
def _(t):
    page = review.paged(rollup(t).select("session_id", "last_at"), [F.desc("last_at"), F.desc("session_id")], 2, 25)
    return readable(page)


@query("deep_page", "L1 A19", """SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY value DESC, event_id DESC LIMIT 25 OFFSET 9000""")
def _(t):
    return review.paged(t.events.select("event_id", "value"), [F.desc("value"), F.desc("event_id")], 361, 25).select("event_id", "total")


@query("conversation_detail", "J5 P5", f"""WITH {b.MESSAGES}, {b.SCORES}, {b.CASES}
SELECT m.session_id, m.id, m.role, m.message, CASE WHEN m.role = 'user' THEN m.frustration_score END AS frustration_score,
  CASE WHEN m.role = 'assistant' THEN s.context_relevance END AS context_relevance,
  CASE WHEN m.role = 'assistant' THEN s.groundedness END AS groundedness,
  CASE WHEN m.role = 'assistant' THEN s.answer_relevance END AS answer_relevance,
  CASE WHEN m.role = 'assistant' THEN m.feedback END AS feedback,
  CASE WHEN m.role = 'assistant' THEN ({DECL}) END AS declined,
  coalesce(c.cases, 0) AS cases, printf('H-%05d', c.last_case) AS last_case_ref
FROM messages m LEFT JOIN scores s ON s.message_id = m.id AND s.metric_version = 2
LEFT JOIN (SELECT session_id, count(*) AS cases, max(case_id) AS last_case FROM cases GROUP BY 1) c
  ON c.session_id = m.session_id""")
def _(t):
    detail = review.conversation_detail(b.messages(t), b.scores(t), b.cases(t), b.DECLINED)
    return detail.withColumn("last_case_ref", F.when(F.col("cases") > 0, F.col("last_case_ref")))


TREND_SQL = f"""
SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(conversations, 0) AS conversations, coalesce(questions, 0) AS questions,
  coalesce(frustrated, 0) AS frustrated, coalesce(declined, 0) AS declined, groundedness, answer_relevance,
  coalesce(rated_up, 0) AS rated_up, coalesce(rated_down, 0) AS rated_down, coalesce(handovers, 0) AS handovers
FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '{{start}}', TIMESTAMP '{{end}}', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(DISTINCT session_id) AS conversations,
    CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS questions,
    CAST(sum(CASE WHEN role = 'user' AND sentiment_label = 'frustrated' THEN 1 ELSE 0 END) AS BIGINT) AS frustrated,
    CAST(sum(CASE WHEN role = 'assistant' AND ({DECL}) THEN 1 ELSE 0 END) AS BIGINT) AS declined
  FROM messages WHERE created_at >= TIMESTAMP '{{start}}' GROUP BY 1) a USING (day)
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, round(avg(groundedness), 3) AS groundedness,
    round(avg(answer_relevance), 3) AS answer_relevance
  FROM scores WHERE metric_version = 2 AND created_at >= TIMESTAMP '{{start}}' GROUP BY 1) s USING (day)
LEFT JOIN (SELECT CAST(feedback_at AS DATE) AS day,
    CAST(sum(CASE WHEN feedback = 'up' THEN 1 ELSE 0 END) AS BIGINT) AS rated_up,
    CAST(sum(CASE WHEN feedback = 'down' THEN 1 ELSE 0 END) AS BIGINT) AS rated_down
  FROM messages WHERE feedback_at >= TIMESTAMP '{{start}}' GROUP BY 1) f USING (day)
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS handovers FROM cases
  WHERE created_at >= TIMESTAMP '{{start}}' GROUP BY 1) h USING (day)"""


@query("transcript_trends", "A4 J6", f"WITH {b.MESSAGES}, {b.SCORES}, {b.CASES}"
       + TREND_SQL.format(start="2024-01-17", end="2024-02-05"))
def _(t):
    out = review.trends(b.messages(t), b.scores(t), b.cases(t), b.DECLINED, "2024-02-05", 20)
    return out.withColumn("day", F.col("day").cast("string"))


# The event log read as desk activity: one row per event.
EVENT_DESK = """messages AS (
  SELECT event_id AS id, user_id AS session_id, ts AS created_at,
    CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role,
    CASE WHEN event_type = 'error' THEN 'Er' ELSE event_type END AS message,
    CASE WHEN event_type = 'click' AND value >= 50 THEN 'frustrated' END AS sentiment_label,
    CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 20 THEN 'up' ELSE 'down' END END AS feedback,
    CASE WHEN event_type = 'signup' THEN ts END AS feedback_at FROM events),
scores AS (SELECT event_id AS id, least(value, 100.0) / 100.0 AS groundedness, least(value, 50.0) / 50.0 AS answer_relevance,
    CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS metric_version, ts AS created_at FROM events WHERE event_type = 'view'),
cases AS (SELECT event_id AS case_id, user_id AS session_id, ts AS created_at FROM events WHERE event_type = 'purchase')"""


def event_desk(t):
    kind, ts = F.col("event_type"), F.col("ts").cast("timestamp_ntz")
    events = t.events
    messages = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), ts.alias("created_at"),
        F.when(kind.isin("view", "click"), "user").otherwise("assistant").alias("role"),
        F.when(kind == "error", "Er").otherwise(kind).alias("message"),
        F.when((kind == "click") & (F.col("value") >= 50), "frustrated").alias("sentiment_label"),
        F.when(kind == "signup", F.when(F.col("value") >= 20, "up").otherwise("down")).alias("feedback"),
        F.when(kind == "signup", ts).alias("feedback_at"))
    scores = events.filter(kind == "view").select(
        F.col("event_id").alias("id"), (F.least("value", F.lit(100.0)) / 100.0).alias("groundedness"),
        (F.least("value", F.lit(50.0)) / 50.0).alias("answer_relevance"),
        F.when(F.col("event_id") % 4 == 0, 1).otherwise(2).alias("metric_version"), ts.alias("created_at"))
    cases = events.filter(kind == "purchase").select(
        F.col("event_id").alias("case_id"), F.col("user_id").alias("session_id"), ts.alias("created_at"))
    return messages, scores, cases


@query("daily_trends", "A4 J6", f"WITH {EVENT_DESK}" + TREND_SQL.format(start="2024-01-10", end="2024-02-08"))
def _(t):
    out = review.trends(*event_desk(t), b.DECLINED, "2024-02-08", 30)
    return out.withColumn("day", F.col("day").cast("string"))


@query("label_distribution", "A2", f"""WITH {b.MESSAGES}
SELECT sentiment_label, count(*) AS n FROM messages WHERE sentiment_label IS NOT NULL GROUP BY 1""")
def _(t):
    return review.label_distribution(b.messages(t), "sentiment_label")


@query("quality_label_distribution", "A2", "SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def _(t):
    return review.label_distribution(t.labels, "quality")


@query("quality_overview", "A5 P5", f"""WITH {b.SCORES},
newest AS (SELECT * FROM scores WHERE metric_version = 2 ORDER BY id DESC LIMIT 200)
SELECT count(*) AS scored, round(coalesce(avg(context_relevance), 0), 4) AS context_relevance,
  round(coalesce(avg(groundedness), 0), 4) AS groundedness, round(coalesce(avg(answer_relevance), 0), 4) AS answer_relevance,
  round(coalesce(1 - avg(groundedness), 0), 4) AS hallucination FROM newest""")
def _(t):
    return review.quality_overview(b.scores(t))


@query("current_version_scores", "P5", f"""WITH {b.SCORES}
SELECT metric_version, model, count(*) AS n, round(avg(groundedness), 4) AS groundedness
FROM scores WHERE metric_version = 2 GROUP BY 1, 2""")
def _(t):
    return review.current_version(b.scores(t)).groupBy("metric_version", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("groundedness"), 4).alias("groundedness"))


@query("first_questions", "W1", f"""WITH {b.MESSAGES}
SELECT session_id, id, message FROM messages WHERE role = 'user'
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id) = 1""")
def _(t):
    asked = b.messages(t).filter(F.col("role") == "user").select("session_id", "id", "message")
    return review.first_per(asked, "session_id", "id")


@query("latest_attempts", "W2", f"""WITH {b.ATTEMPTS}
SELECT session_id, id, status, reference FROM attempts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) = 1""")
def _(t):
    return review.latest_per(b.attempts(t).select("session_id", "id", "status", "reference"), "session_id", "id")


@query("transcript_tail", "W3", f"""WITH {b.MESSAGES}
SELECT session_id, id, role, from_end, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS from_end FROM messages) WHERE from_end <= 3""")
def _(t):
    kept = review.tail_per(b.messages(t).select("session_id", "id", "role"), "session_id", "id", 3)
    return kept.withColumns({c: F.col(c).cast("bigint") for c in ("from_end", "position")})


@query("case_queue", "L2 W2 P6", f"""WITH {b.MESSAGES}, {b.CASES}
SELECT printf('H-%05d', case_id) AS case_ref, c.session_id, c.status, last_message FROM (
  SELECT * FROM cases WHERE status IN ('open', 'claimed') ORDER BY CASE status WHEN 'open' THEN 0 ELSE 1 END, case_id DESC LIMIT 50) c
LEFT JOIN (SELECT session_id, arg_max(message, id) AS last_message FROM messages WHERE role = 'user' GROUP BY 1) m USING (session_id)""")
def _(t):
    return review.case_queue(b.cases(t), b.messages(t)).select(
        review.padded_ref("H", F.col("case_id")).alias("case_ref"), "session_id", "status", "last_message")


@query("thread_list", "L4", f"""WITH {b.MESSAGES}
SELECT s.session_id, pinned, title, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at
FROM (SELECT c_custkey AS session_id, c_acctbal > 9000 AS pinned FROM customer) s
JOIN (SELECT session_id, max(created_at) AS last_at, arg_min(message, id) FILTER (WHERE role = 'user') AS title
      FROM messages GROUP BY 1) m USING (session_id)
ORDER BY pinned DESC, m.last_at DESC, s.session_id DESC LIMIT 50""")
def _(t):
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), (F.col("c_acctbal") > 9000).alias("pinned"))
    return readable(review.list_threads(sessions, b.messages(t)))


@query("messages_since", "L5", f"""WITH {b.MESSAGES}
SELECT id, message FROM messages WHERE session_id = 3 AND id > 300001 AND role = 'assistant'""")
def _(t):
    return review.since(b.messages(t), "session_id", 3, 300001, "assistant").select("id", "message")


@query("audit_filter", "P2 L1", f"""WITH {b.AUDIT}
SELECT id, username, action, detail, (SELECT count(*) FROM audit WHERE username = 7 AND action = 'error') AS total
FROM audit WHERE username = 7 AND action = 'error' ORDER BY id DESC LIMIT 50""")
def _(t):
    entries = review.filter_audit(b.audit(t), 7, "error").select("id", "username", "action", "detail")
    return review.paged(entries, [F.desc("id")], 1, 50)


@query("audit_actions", "A22", "SELECT DISTINCT event_type AS action FROM events WHERE event_type IS NOT NULL")
def _(t):
    return review.distinct_values(b.audit(t), "action")


@query("recent_failures", "A20 ST8", """SELECT user_id AS session_id, count(*) AS failures FROM events
WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 11:00:00' GROUP BY 1""")
def _(t):
    lookups = t.events.select(F.col("user_id").alias("session_id"), (F.col("event_type") != "error").alias("found"),
                              F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return review.recent_failures(lookups, "2024-01-20 12:00:00")
