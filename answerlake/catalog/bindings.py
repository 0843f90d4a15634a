"""How the desk's tables are read from the shared test tables, once for Spark and
once as SQL for the oracle. Each pair describes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.session import Tables

DECLINED = ("Er", "La ")

# messages: the transcript, with a clock made of the conversation and turn numbers
MESSAGES = """messages AS (
  SELECT conv_id AS session_id, conv_id * 100000 + turn AS id, turn, role, text AS message,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) + to_minutes(CAST(turn AS BIGINT)) AS created_at,
         CASE WHEN role = 'user' THEN (length(text) % 100) / 100.0::DOUBLE END AS frustration_score,
         CASE WHEN role = 'user' THEN CASE WHEN length(text) % 100 >= 55 THEN 'frustrated' ELSE 'calm' END END AS sentiment_label,
         CASE WHEN role = 'assistant' AND length(text) % 7 = 0 THEN 'up'
              WHEN role = 'assistant' AND length(text) % 11 = 0 THEN 'down' END AS feedback,
         CASE WHEN role = 'assistant' AND (length(text) % 7 = 0 OR length(text) % 11 = 0)
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 + 1 AS INTEGER)) END AS feedback_at
  FROM conversations)"""

SCORES = """scores AS (
  SELECT conv_id * 100000 + turn AS id, conv_id * 100000 + turn AS message_id, conv_id AS session_id,
         (length(text) % 17) / 16.0::DOUBLE AS context_relevance, (length(text) % 21) / 20.0::DOUBLE AS groundedness,
         (length(text) % 13) / 12.0::DOUBLE AS answer_relevance,
         CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 2 END AS metric_version,
         CASE WHEN turn % 3 = 0 THEN 'small' WHEN turn % 3 = 1 THEN 'large' ELSE 'offline' END AS model,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) AS created_at
  FROM conversations WHERE role = 'assistant')"""

CASES = """cases AS (
  SELECT conv_id * 100 + turn AS case_id, conv_id AS session_id,
         CASE length(text) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'claimed' ELSE 'closed' END AS status,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(conv_id % 30 AS INTEGER)) AS created_at
  FROM conversations WHERE length(text) % 4 = 0)"""

ATTEMPTS = """attempts AS (
  SELECT o_orderkey AS id, o_custkey AS session_id,
         CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' WHEN o_orderpriority <> '5-LOW' THEN 'mobile' END AS method,
         o_totalprice AS amount, CAST(round(CAST(o_totalprice AS DECIMAL(28,10)) * 100) AS BIGINT) AS amount_minor,
         CASE o_orderkey % 3 WHEN 0 THEN 'KES' WHEN 1 THEN 'usd' END AS currency,
         'ORD-' || CAST(o_orderkey AS VARCHAR) AS reference, 'CK' || CAST(o_orderkey // 2 AS VARCHAR) AS checkout_id,
         'Q' || CAST(o_custkey AS VARCHAR) AS quote_id, o_orderdate AS created_at
  FROM orders)"""

# outcomes: provider callbacks; the order of a checkout's rows is fixed by seq
OUTCOMES = """outcomes AS (
  SELECT l_orderkey AS attempt_id, 'CK' || CAST(l_orderkey // 2 AS VARCHAR) AS checkout_id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' WHEN o_orderpriority <> '5-LOW' THEN 'mobile' END AS method,
         strftime(l_shipdate, '%Y%m%d') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
           || '-' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS seq,
         CASE l_returnflag WHEN 'A' THEN 'paid' WHEN 'R' THEN 'failed' END AS outcome,
         CASE WHEN l_discount <= 0.06 THEN o_totalprice ELSE l_extendedprice END AS reported,
         CASE o_orderkey % 3 WHEN 0 THEN 'kes' WHEN 1 THEN 'USD' END AS reported_currency,
         CASE WHEN l_linenumber % 2 = 0 THEN 'R' || CAST(l_partkey AS VARCHAR) END AS receipt,
         o_orderdate + to_minutes(CAST(l_quantity AS BIGINT)) AS at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

AUDIT = """audit AS (
  SELECT event_id AS id, user_id AS username, event_type AS action, props AS detail, ts AS created_at FROM events)"""


def messages(t: Tables) -> DataFrame:
    base = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    day = F.make_dt_interval(days=(F.col("conv_id") % 30).cast("int"))
    size = F.length("text")
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    feedback = F.when(answer & (size % 7 == 0), "up").when(answer & (size % 11 == 0), "down")
    return t.conversations.select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "turn", "role",
        F.col("text").alias("message"),
        (base + day + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created_at"),
        F.when(user, (size % 100) / F.lit(100.0)).alias("frustration_score"),
        F.when(user, F.when(size % 100 >= 55, "frustrated").otherwise("calm")).alias("sentiment_label"),
        feedback.alias("feedback"),
        F.when(feedback.isNotNull(),
               base + F.make_dt_interval(days=(F.col("conv_id") % 30 + 1).cast("int"))).alias("feedback_at"))


def scores(t: Tables) -> DataFrame:
    size = F.length("text")
    ident = F.col("conv_id") * 100000 + F.col("turn")
    return t.conversations.filter(F.col("role") == "assistant").select(
        ident.alias("id"), ident.alias("message_id"), F.col("conv_id").alias("session_id"),
        ((size % 17) / F.lit(16.0)).alias("context_relevance"), ((size % 21) / F.lit(20.0)).alias("groundedness"),
        ((size % 13) / F.lit(12.0)).alias("answer_relevance"),
        F.when(size % 5 == 0, 1).otherwise(2).alias("metric_version"),
        F.when(F.col("turn") % 3 == 0, "small").when(F.col("turn") % 3 == 1, "large").otherwise("offline").alias("model"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'")
         + F.make_dt_interval(days=(F.col("conv_id") % 30).cast("int"))).alias("created_at"))


def cases(t: Tables) -> DataFrame:
    size = F.length("text")
    return t.conversations.filter(size % 4 == 0).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.col("conv_id").alias("session_id"),
        F.when(size % 3 == 0, "open").when(size % 3 == 1, "claimed").otherwise("closed").alias("status"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'")
         + F.make_dt_interval(days=(F.col("conv_id") % 30).cast("int"))).alias("created_at"))


def _method():
    return (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "card")
            .when(F.col("o_orderpriority") != "5-LOW", "mobile"))


def attempts(t: Tables) -> DataFrame:
    from answerlake.operators.ledger import to_minor
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("id"), F.col("o_custkey").alias("session_id"),
        F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "pending")
        .otherwise("failed").alias("status"),
        _method().alias("method"), F.col("o_totalprice").alias("amount"),
        to_minor(F.col("o_totalprice")).alias("amount_minor"),
        F.when(key % 3 == 0, "KES").when(key % 3 == 1, "usd").alias("currency"),
        F.concat(F.lit("ORD-"), key.cast("string")).alias("reference"),
        F.concat(F.lit("CK"), F.floor(key / 2).cast("string")).alias("checkout_id"),
        F.concat(F.lit("Q"), F.col("o_custkey").cast("string")).alias("quote_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def outcomes(t: Tables) -> DataFrame:
    def digits(name, width):
        return F.lpad(F.col(name).cast("string"), width, "0")

    cents = F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 12, "0")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("attempt_id"),
        F.concat(F.lit("CK"), F.floor(F.col("l_orderkey") / 2).cast("string")).alias("checkout_id"),
        _method().alias("method"),
        F.concat_ws("-", F.date_format("l_shipdate", "yyyyMMdd"), digits("l_linenumber", 2), digits("l_partkey", 9),
                    digits("l_suppkey", 9), cents).alias("seq"),
        F.when(F.col("l_returnflag") == "A", "paid").when(F.col("l_returnflag") == "R", "failed").alias("outcome"),
        F.when(F.col("l_discount") <= 0.06, F.col("o_totalprice")).otherwise(F.col("l_extendedprice")).alias("reported"),
        F.when(F.col("o_orderkey") % 3 == 0, "kes").when(F.col("o_orderkey") % 3 == 1, "USD").alias("reported_currency"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("R"), F.col("l_partkey").cast("string"))).alias("receipt"),
        (F.col("o_orderdate").cast("timestamp_ntz")
         + F.make_dt_interval(mins=F.col("l_quantity").cast("int"))).alias("at"))


def audit(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("username"),
                           F.col("event_type").alias("action"), F.col("props").alias("detail"),
                           F.col("ts").cast("timestamp_ntz").alias("created_at"))


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
