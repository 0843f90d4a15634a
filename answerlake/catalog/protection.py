"""Masking, erasure, retention, upserts and imports."""

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.functions import masking
from answerlake.operators import lifecycle, privacy

DIGITS8 = "lpad(CAST({} AS VARCHAR), 8, '0')"


def eight(name):
    return F.lpad(F.col(name).cast("string"), 8, "0")


PHONE_KINDS = f"""CASE c_custkey % 5 WHEN 0 THEN '07' || {DIGITS8.format('c_custkey')} WHEN 1 THEN '+254 7' || {DIGITS8.format('c_custkey')}
  WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '' END"""


def phone_kinds():
    turn = F.col("c_custkey") % 5
    return (F.when(turn == 0, F.concat(F.lit("07"), eight("c_custkey"))).when(turn == 1, F.concat(F.lit("+254 7"), eight("c_custkey")))
            .when(turn == 2, F.col("c_custkey").cast("string")).when(turn == 3, F.lit("")))


MASKED = """CASE WHEN phone IS NULL OR phone = '' THEN phone WHEN length(d) < 7 THEN repeat('*', length(d))
  ELSE left(d, 4) || repeat('*', length(d) - 7) || right(d, 3) END"""


@query("masked_phones", "P7", f"""SELECT c_custkey, {MASKED} AS masked FROM (SELECT c_custkey, phone,
  CASE WHEN length(r) = 10 AND starts_with(r, '0') THEN '254' || substr(r, 2) ELSE r END AS d
  FROM (SELECT c_custkey, phone, regexp_replace(phone, '[^0-9]', '', 'g') AS r FROM (SELECT c_custkey, {PHONE_KINDS} AS phone FROM customer)))""")
def _(t):
    return t.customer.select("c_custkey", masking.mask_phone(phone_kinds()).alias("masked"))


@query("masked_texts", "P8", """SELECT doc_id, text || ' Call 2547*****' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ', 2541*****' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0')
  || ' or 00712345' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '.' AS masked FROM documents""")
def _(t):
    last = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    text = F.concat("text", F.lit(" Call 0712 345-"), last, F.lit(", +254112345"), last, F.lit(" or 00712345"), last, F.lit("."))
    return t.texts.select("doc_id", masking.mask_text(text).alias("masked"))


@query("masked_checkouts", "P9", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'ws_CO_' || strftime(o_orderdate, '%Y%m%d') || '123456' || repeat('*', 8)
  WHEN 1 THEN 'PAY-' || CASE WHEN o_orderkey < 10 THEN '' ELSE left(CAST(o_orderkey AS VARCHAR), length(CAST(o_orderkey AS VARCHAR)) - 1) END || repeat('*', 9)
  ELSE 'A' || CAST(o_orderkey AS VARCHAR) END AS masked FROM orders""")
def _(t):
    key = F.col("o_orderkey").cast("string")
    ident = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ws_CO_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("123456"), eight("o_orderkey"))
                   ).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("PAY-"), key, F.lit("00000000"))).otherwise(F.concat(F.lit("A"), key))
    return t.orders.select("o_orderkey", masking.mask_checkout(ident).alias("masked"))


@query("masked_rows", "P10", f"""SELECT o_orderkey AS id, '2547' || repeat('*', 5) || right({DIGITS8.format('o_custkey')}, 3) AS phone_number,
  'ws_CO_20240101123456********' AS checkout_id, 'order of 2547*****' || right({DIGITS8.format('o_custkey')}, 3) AS message, o_orderpriority AS note FROM orders""")
def _(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("07"), eight("o_custkey")).alias("phone_number"),
        F.concat(F.lit("ws_CO_20240101123456"), eight("o_orderkey")).alias("checkout_id"),
        F.concat(F.lit("order of 07"), eight("o_custkey")).alias("message"), F.col("o_orderpriority").alias("note"))
    return masking.mask_rows(rows)


@query("masked_json", "P11")
def _(t):
    steps = F.concat(
        F.lit('[{"step": "look up", "input": {"phone": "07'), eight("event_id"), F.lit('", "n": '), F.col("value").cast("string"),
        F.lit('}}, "stray", {"id": "ws_CO_20240101123456'), eight("event_id"), F.lit('", "props": '), F.col("props"), F.lit("}]"))
    raw = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(steps)
    return t.events.select("event_id", masking.mask_json(raw).alias("trace"))


EDGE_L, EDGE_R = "(^|[^\\p{L}\\p{N}_])", "($|[^\\p{L}\\p{N}_])"
REF = "|".join([f"[A-Z]{{{i}}}[0-9][A-Z0-9]{{{5 - i}}}|[0-9]{{{i}}}[A-Z][A-Z0-9]{{{5 - i}}}" for i in range(1, 6)])
SQL_SCRUB = [
    ("[phone]", "(^|[^0-9+])(\\+?254|0)[\\s-]?[17][0-9]{2}[\\s-]?[0-9]{3}[\\s-]?[0-9]{3}($|[^0-9])", "\\1[phone]\\3"),
    ("[email]", "[\\w.+-]+@[\\w-]+\\.[\\w.-]+", "[email]"),
    ("[number]", "(^|[^0-9])([0-9][ -]?){13,19}($|[^0-9])", "\\1[number]\\3"),
    ("[booking ref]", f"{EDGE_L}({REF}){EDGE_R}", "\\1[booking ref]\\3"),
]


def scrub_sql(source, text, ident):
    """Chained CTEs: one per rule, each with the text so far and the placeholders used."""
    out = [f"z0 AS (SELECT {ident}, {text} AS s, []::VARCHAR[] AS found FROM {source})"]
    for i, (name, pattern, to) in enumerate(SQL_SCRUB, 1):
        # A consumed edge hides a neighbouring match from the first pass, so replace twice.
        once = f"regexp_replace(s, '{pattern}', '{to}', 'g')"
        out.append(f"z{i} AS (SELECT {ident}, regexp_replace({once}, '{pattern}', '{to}', 'g') AS s, "
                   f"CASE WHEN regexp_matches(s, '{pattern}') THEN list_append(found, '{name}') ELSE found END AS found FROM z{i - 1})")
    return ", ".join(out)


OFFERED = """offered AS (SELECT d.doc_id AS row_no, text || CASE d.doc_id % 4 WHEN 0 THEN ' ring 0712 345 678' WHEN 1 THEN ' ref AB12C' || CAST(d.doc_id % 10 AS VARCHAR) ELSE '' END AS text,
  CASE WHEN toxic IS NULL THEN 'odd' WHEN quality = 1 THEN ' Calm' ELSE 'frustrated' END AS label, CASE WHEN lang <> 'de' THEN upper(lang) END AS language,
  CASE WHEN d.doc_id % 9 <> 0 THEN 'C' || CAST(d.doc_id AS VARCHAR) END AS consent_ref FROM documents d LEFT JOIN labels USING (doc_id))"""


def offered(t):
    ident = F.col("doc_id")
    tail = F.when(ident % 4 == 0, " ring 0712 345 678").when(ident % 4 == 1, F.concat(F.lit(" ref AB12C"), (ident % 10).cast("string"))).otherwise("")
    return t.texts.join(t.labels, "doc_id", "left").select(
        ident.alias("row_no"), F.concat("text", tail).alias("text"),
        F.when(F.col("toxic").isNull(), "odd").when(F.col("quality") == 1, " Calm").otherwise("frustrated").alias("label"),
        F.when(F.col("lang") != "de", F.upper("lang")).alias("language"),
        F.when(ident % 9 != 0, F.concat(F.lit("C"), ident.cast("string"))).alias("consent_ref"))


@query("scrubbed_texts", "P12", f"WITH {OFFERED}, {scrub_sql('offered', 'text', 'row_no')} SELECT row_no, s AS text, array_to_string(found, '|') AS found FROM z4")
def _(t):
    safe = masking.scrub(F.col("text"))
    return offered(t).select("row_no", safe["text"].alias("text"), F.array_join(safe["found"], "|").alias("found"))


NORM = "regexp_replace(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12))), '\\s+', ' ', 'g')"
IMPORTED = f"""WITH {OFFERED}, {scrub_sql('offered', q.strip('text'), 'row_no')},
r AS (SELECT row_no, lower(trim(label)) AS label, coalesce(lower(language), 'unknown') AS language, {q.strip('text')} AS raw, s, found, {NORM.format('s')} AS k,
  CASE WHEN consent_ref IS NULL THEN 'no consent reference' WHEN {q.strip('text')} = '' THEN 'empty text'
   WHEN lower(trim(label)) NOT IN ('calm', 'frustrated') THEN 'bad label' END AS reason FROM offered JOIN z4 USING (row_no)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_no) AS copy FROM r WHERE reason IS NULL),
known AS (SELECT {NORM.format('text')} AS k FROM benchmark UNION SELECT {NORM.format('text')} FROM conversations),
imported AS (SELECT row_no, s AS text, label, language, found, CASE WHEN copy > 1 OR k IN (SELECT k FROM known) THEN 'duplicate of training or challenge data' END AS reason FROM o
  UNION ALL SELECT row_no, raw, label, language, []::VARCHAR[], reason FROM r WHERE reason IS NOT NULL)"""


def imported(t):
    return lifecycle.import_messages(offered(t), t.benchmark, t.conversations, ("calm", "frustrated"))


@query("imported_messages", "M7 J14 P12", IMPORTED + " SELECT row_no, text, label, language, array_to_string(found, '|') AS found, reason FROM imported")
def _(t):
    return imported(t).withColumn("found", F.array_join("found", "|"))


@query("import_report", "A17", IMPORTED + """ SELECT 'accepted' AS part, language || '/' || label AS key, count(*) AS n FROM imported WHERE reason IS NULL GROUP BY 1, 2
UNION ALL SELECT 'rejected', reason, count(*) FROM imported WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'replaced', f, count(*) FROM (SELECT unnest(found) AS f FROM imported) GROUP BY 1, 2""")
def _(t):
    return lifecycle.import_report(imported(t))


@query("unseen_texts", "J14", f"""SELECT doc_id AS row_no FROM (SELECT doc_id, {NORM.format('text')} AS k FROM documents)
WHERE k NOT IN (SELECT {NORM.format('text')} FROM benchmark) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1""")
def _(t):
    new = t.texts.select(F.col("doc_id").alias("row_no"), "text")
    return lifecycle.drop_seen(new, t.benchmark).select("row_no")


# --------------------------------------------------------- erasure and retention

SESSIONS = """sessions AS (SELECT c_custkey AS session_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER)) AS last_seen_at
  FROM customer WHERE c_custkey % 10 <> 3)"""
DESK = f"""{b.MESSAGES}, {b.CASES}, {b.SCORES}, {b.ATTEMPTS}, {SESSIONS},
asked AS (SELECT s.*, m.message AS query FROM scores s LEFT JOIN messages m ON m.id = s.message_id - 1),
ledger AS (SELECT *, CASE WHEN id % 4 <> 0 THEN '07' || {DIGITS8.format('session_id')} END AS phone_number FROM attempts)"""
TARGETS = "SELECT c_custkey AS session_id FROM customer WHERE c_acctbal < 500"


def desk(t):
    messages, seen = b.messages(t), F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    before = messages.select((F.col("id") + 1).alias("message_id"), F.col("message").alias("query"))
    sessions = t.customer.filter("c_custkey % 10 <> 3").select(
        F.col("c_custkey").alias("session_id"), (seen + F.make_dt_interval(days=(F.col("c_custkey") % 60).cast("int"))).alias("last_seen_at"))
    ledger = b.attempts(t).withColumn("phone_number", F.when(F.col("id") % 4 != 0, F.concat(F.lit("07"), eight("session_id"))))
    return privacy.Desk(messages=messages, cases=b.cases(t), scores=b.scores(t).join(before, "message_id", "left"), ledger=ledger, sessions=sessions)


def targets(t):
    return t.customer.filter("c_acctbal < 500").select(F.col("c_custkey").alias("session_id"))


ERASED = f"""WITH {DESK}, gone AS ({TARGETS}),
q AS (SELECT DISTINCT message FROM messages WHERE role = 'user' AND session_id IN (FROM gone)),
hit AS (SELECT id FROM asked WHERE query IS NOT NULL AND (session_id IN (FROM gone) OR query IN (FROM q)))"""
COUNTS = """(SELECT count(*) FROM messages WHERE session_id IN (FROM gone)) AS messages,
  (SELECT count(*) FROM cases WHERE session_id IN (FROM gone)) AS handover_cases"""


@query("erasure_counts", "M2 M5 U1", ERASED + f""" SELECT (SELECT count(*) FROM gone) AS sessions, {COUNTS},
  (SELECT count(*) FROM ledger WHERE phone_number IS NOT NULL AND session_id IN (FROM gone)) AS payment_contacts, (SELECT count(*) FROM hit) AS evaluation_texts""")
def _(t):
    return privacy.preview_erasure(desk(t), targets(t))


@query("erased_ledger", "M2", ERASED + " SELECT id, session_id, amount, CASE WHEN session_id NOT IN (FROM gone) THEN phone_number END AS phone_number FROM ledger")
def _(t):
    return privacy.erase(desk(t), targets(t))[0].ledger.select("id", "session_id", "amount", "phone_number")


@query("erased_scores", "M2", ERASED + " SELECT id, groundedness, CASE WHEN id NOT IN (FROM hit) THEN query END AS query FROM asked")
def _(t):
    return privacy.erase(desk(t), targets(t))[0].scores.select("id", "groundedness", "query")


NOW, OLD = "2024-02-25 12:00:00", "TIMESTAMP '2024-01-26 12:00:00'"


@query("stale_sessions", "J2", f"""WITH {DESK} SELECT session_id FROM sessions s WHERE last_seen_at < {OLD}
  AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.session_id = s.session_id AND c.status IN ('open', 'claimed'))""")
def _(t):
    d = desk(t)
    return privacy.stale_sessions(d.sessions, d.cases, privacy.cutoff(NOW, 30))


ORPHANS = f"""SELECT DISTINCT session_id FROM messages m WHERE created_at < {OLD} AND NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = m.session_id)
  AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.session_id = m.session_id AND c.status IN ('open', 'claimed'))"""


@query("orphan_sessions", "J3", f"WITH {DESK} {ORPHANS}")
def _(t):
    d = desk(t)
    return privacy.orphan_sessions(d.messages, d.sessions, d.cases, privacy.cutoff(NOW, 30))


STALE = f"""SELECT session_id FROM sessions s WHERE last_seen_at < {OLD}
  AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.session_id = s.session_id AND c.status IN ('open', 'claimed'))"""


@query("erasure_targets", "U1", f"WITH {DESK} SELECT session_id FROM ({STALE} UNION {ORPHANS})")
def _(t):
    d, old = desk(t), privacy.cutoff(NOW, 30)
    return privacy.union_ids(privacy.stale_sessions(d.sessions, d.cases, old), privacy.orphan_sessions(d.messages, d.sessions, d.cases, old))


@query("retention_sweep", "M3 ST11", f"""WITH {DESK}, stale AS ({STALE}), gone AS (SELECT session_id FROM stale UNION {ORPHANS}),
q AS (SELECT DISTINCT message FROM messages WHERE role = 'user' AND session_id IN (FROM gone)),
hit AS (SELECT id FROM asked WHERE query IS NOT NULL AND (session_id IN (FROM gone) OR query IN (FROM q)))
SELECT (SELECT count(*) FROM stale) AS sessions, {COUNTS},
  (SELECT count(*) FROM ledger WHERE phone_number IS NOT NULL AND (session_id IN (FROM gone) OR (created_at < TIMESTAMP '2023-11-27 12:00:00' AND status <> 'pending'))) AS payment_contacts,
  (SELECT count(*) FROM asked WHERE query IS NOT NULL AND (id IN (FROM hit) OR created_at < {OLD})) AS evaluation_texts,
  (SELECT count(*) FROM events WHERE event_type = 'view' AND ts + INTERVAL 30 DAY < TIMESTAMP '2024-02-25 11:30:00') AS expired_memory,
  (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '2023-02-25 12:00:00') AS audit_entries""")
def _(t):
    memory = t.events.filter("event_type = 'view'").select(
        "event_id", (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(30))).alias("updated_at"))
    audit = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return privacy.purge(desk(t), NOW, memory, audit)[1]


@query("inactive_sessions", "ST13", """SELECT user_id AS session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events
GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'""")
def _(t):
    events = t.events.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return privacy.inactive_sessions(events, "2024-02-29 12:00:00", 30).withColumn("last_at", b.stamp("last_at"))


@query("sessions_for_phone", "M4 U1", f"""WITH wanted AS (SELECT right('7' || {DIGITS8.format('c_custkey')}, 9) AS phone_tail FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT DISTINCT phone_tail, session_id FROM (
  SELECT '7' || {DIGITS8.format('o_custkey')} AS phone_tail, o_custkey AS session_id FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT '7' || {DIGITS8.format('conv_id * 7')}, conv_id FROM conversations WHERE role = 'user' AND turn % 2 = 0) WHERE phone_tail IN (FROM wanted)""")
def _(t):
    ledger = desk(t).ledger.select("session_id", "phone_number")
    padded = F.lpad((F.col("conv_id") * 7).cast("string"), 8, "0")
    said = t.conversations.select(F.col("conv_id").alias("session_id"), "role", F.when(F.col("turn") % 2 == 0, F.concat(
        "text", F.lit(" my number is +254 7"), F.left(padded, F.lit(2)), F.lit("-"), F.substring(padded, 3, 3), F.lit(" "),
        F.right(padded, F.lit(3)), F.lit(" thanks"))).otherwise(F.col("text")).alias("message"))
    phones = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("07"), eight("c_custkey")).alias("phone"))
    return privacy.sessions_for_phone(ledger, said, phones)


# ------------------------------------------------------------- table versions

CHANGES = """changes AS (SELECT o_custkey AS c_custkey, o_orderpriority AS c_mktsegment, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS c_acctbal,
  o_orderkey AS change_no FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT s_suppkey + 10000000, 'NEW', s_acctbal, s_suppkey FROM supplier)"""


def changes(t):
    return t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("c_acctbal"), F.col("o_orderkey").alias("change_no")
    ).unionByName(t.supplier.select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"),
                                    F.col("s_acctbal").alias("c_acctbal"), F.col("s_suppkey").alias("change_no")))


def upsert_sql(balance):
    return f"""WITH {CHANGES}, l AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY change_no DESC) = 1)
SELECT coalesce(c.c_custkey, l.c_custkey) AS c_custkey, c.c_name, CASE WHEN l.change_no IS NOT NULL THEN l.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment,
  {balance} AS c_acctbal FROM customer c FULL JOIN l ON l.c_custkey = c.c_custkey"""


@query("upsert_replace", "M1", upsert_sql("CASE WHEN l.change_no IS NOT NULL THEN l.c_acctbal ELSE c.c_acctbal END"))
def _(t):
    target = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return lifecycle.upsert(target, changes(t), "c_custkey", "change_no")


@query("upsert_coalesce", "M1 P15", upsert_sql("coalesce(l.c_acctbal, c.c_acctbal)"))
def _(t):
    target = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return lifecycle.upsert(target, changes(t), "c_custkey", "change_no", ["c_acctbal"])


RATINGS = """ratings AS (SELECT user_id % 100 * 100000 + event_id % 8 AS message_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE user_id % 100 END AS session_id,
  CASE WHEN value > 20 THEN 'up' ELSE 'down' END AS rating, event_id AS rated_no FROM events)"""


@query("applied_feedback", "M6 W2", f"""WITH {b.MESSAGES}, {RATINGS},
l AS (SELECT * FROM ratings QUALIFY row_number() OVER (PARTITION BY message_id, session_id ORDER BY rated_no DESC) = 1)
SELECT m.id, m.role, CASE WHEN m.role = 'assistant' THEN coalesce(l.rating, m.feedback) ELSE m.feedback END AS feedback
FROM messages m LEFT JOIN l ON l.message_id = m.id AND l.session_id = m.session_id""")
def _(t):
    user = F.col("user_id") % 100
    ratings = t.events.select(
        (user * 100000 + F.col("event_id") % 8).alias("message_id"), F.when(F.col("event_id") % 10 == 0, -1).otherwise(user).alias("session_id"),
        F.when(F.col("value") > 20, "up").otherwise("down").alias("rating"), F.col("event_id").alias("rated_no"))
    return lifecycle.apply_feedback(b.messages(t), ratings).select("id", "role", "feedback")
