"""Ledger queries."""

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog.registry import query
from answerlake.operators import ledger, review


@query("ledger_filter", "P1", f"""WITH {b.ATTEMPTS}
SELECT id, session_id, status, method, reference FROM attempts WHERE status = 'pending' AND method = 'card'
  AND (contains(lower(reference), '12') OR starts_with(lower(CAST(session_id AS VARCHAR)), '12'))""")
def _(t):
    return ledger.filter_ledger(b.attempts(t), "pending", "card", " 12 ").select(
        "id", "session_id", "status", "method", "reference")


@query("ledger_page", "L1 A19 P1", f"""WITH {b.ATTEMPTS}
SELECT id, reference, (SELECT count(*) FROM attempts WHERE status = 'paid') AS total
FROM attempts WHERE status = 'paid' ORDER BY id DESC LIMIT 100 OFFSET 100""")
def _(t):
    rows = ledger.filter_ledger(b.attempts(t), "paid").select("id", "reference")
    return review.paged(rows, [F.desc("id")], 2, 500)


@query("ledger_summary", "A3", f"""WITH {b.ATTEMPTS}, l AS (SELECT status, coalesce(method, 'mobile') AS method,
  upper(coalesce(currency, 'KES')) AS currency, amount_minor FROM attempts)
SELECT 'status' AS part, status AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS amount FROM l GROUP BY status
UNION ALL SELECT 'method', method, count(*), NULL FROM l GROUP BY method
UNION ALL SELECT 'all', 'all', count(*), NULL FROM l
UNION ALL SELECT 'settled', currency, count(*), CAST(sum(amount_minor) AS DOUBLE) / 100.0 FROM l WHERE status = 'paid' GROUP BY currency
UNION ALL SELECT 'pending', currency, count(*), CAST(sum(amount_minor) AS DOUBLE) / 100.0 FROM l WHERE status = 'pending' GROUP BY currency""")
def _(t):
    return ledger.ledger_summary(b.attempts(t))


@query("ledger_backfill", "P13", """SELECT CASE s WHEN 'initiated' THEN 'pending' WHEN 'simulated-demo' THEN 'simulated' ELSE s END AS status,
  count(*) AS n, CAST(sum(minor) AS BIGINT) AS minor FROM (
  SELECT CASE o_orderstatus WHEN 'P' THEN 'initiated' WHEN 'O' THEN 'simulated-demo' ELSE 'paid' END AS s,
    CAST(round(CAST(o_totalprice AS DECIMAL(28,10)) * 100) AS BIGINT) AS minor FROM orders) GROUP BY 1""")
def _(t):
    status = F.col("o_orderstatus")
    old = t.orders.select(
        F.when(status == "P", "initiated").when(status == "O", "simulated-demo").otherwise("paid").alias("status"),
        F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderkey") % 2 == 0, ledger.to_minor(F.col("o_totalprice"))).alias("amount_minor"))
    return ledger.backfill_ledger(old).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("minor"))


@query("minor_units", "P14", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, minor, minor / 100.0::DOUBLE AS back FROM (
  SELECT *, CAST(round(CAST(l_extendedprice AS DECIMAL(28,10)) * 100) AS BIGINT) AS minor FROM lineitem)""")
def _(t):
    minor = ledger.to_minor(F.col("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", minor.alias("minor"),
                             ledger.from_minor(minor).alias("back"))


@query("coalesce_update", "P15", """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN 'closed' END, o_orderpriority) AS detail,
  coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice + 1 END, o_totalprice) AS amount FROM orders""")
def _(t):
    changed = t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("detail"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "O", "closed").alias("detail_new"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).alias("amount_new"))
    return ledger.coalesce_update(changed, ["detail", "amount"])


@query("expiry_predicate", "P16 ST5", """SELECT event_id, CASE WHEN expires IS NULL THEN true
  ELSE TIMESTAMP '2024-01-15 12:00:00' >= expires END AS expired
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts + INTERVAL 15 MINUTE END AS expires FROM events)""")
def _(t):
    expires = F.when(F.col("event_type") != "error",
                     F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(ledger.QUOTE_TTL_MINUTES)))
    return t.events.select(
        "event_id", ledger.is_expired(expires, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("expired"))


@query("local_money", "T24", f"""WITH {b.ATTEMPTS}
SELECT id, CASE WHEN coalesce(upper(currency), 'KES') = 'KES' THEN amount ELSE round(amount * 129.5, 0) END AS local_amount,
  coalesce(upper(currency), 'KES') <> 'KES' AS converted FROM attempts""")
def _(t):
    code = F.coalesce(F.upper("currency"), F.lit("KES"))
    return b.attempts(t).select(
        "id", ledger.to_local(F.col("amount"), code, 129.5).alias("local_amount"), (code != "KES").alias("converted"))


DECISIVE = """decisive AS (SELECT method, checkout_id, arg_min(struct_pack(outcome := outcome, reported := reported,
  ccy := reported_currency, receipt := receipt), seq) AS o FROM outcomes WHERE outcome IS NOT NULL AND method IS NOT NULL GROUP BY 1, 2),
latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY method, checkout_id ORDER BY id DESC) = 1)"""
AFTER = """CASE WHEN status <> 'pending' OR o IS NULL THEN status
  WHEN o.outcome = 'paid' AND NOT (CAST(round(CAST(o.reported AS DECIMAL(28,10)) * 100) AS BIGINT) = amount_minor
     AND (l.method <> 'card' OR upper(coalesce(o.ccy, '')) = upper(coalesce(currency, '')))) THEN 'needs_review' ELSE o.outcome END"""


@query("apply_outcomes", "J7 W2", f"""WITH {b.ATTEMPTS}, {b.OUTCOMES}, {DECISIVE}
SELECT id, l.method, l.checkout_id, status AS before, {AFTER} AS after,
  CASE WHEN status = 'pending' AND o IS NOT NULL THEN o.receipt END AS receipt
FROM latest l LEFT JOIN decisive d ON d.method = l.method AND d.checkout_id = l.checkout_id""")
def _(t):
    return ledger.apply_outcomes(b.attempts(t), b.outcomes(t))


@query("confirmed_outcomes", "J7", f"""WITH {b.ATTEMPTS}, {b.OUTCOMES},
latest AS (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY method, checkout_id ORDER BY id DESC) = 1),
agreed AS (SELECT DISTINCT method, checkout_id FROM outcomes WHERE receipt IS NOT NULL),
decisive AS (SELECT c.method, c.checkout_id, arg_min(struct_pack(outcome := c.outcome, reported := c.reported, ccy := c.reported_currency, receipt := c.receipt), c.seq) AS o
  FROM outcomes c JOIN latest a ON a.method = c.method AND a.checkout_id = c.checkout_id
  WHERE c.outcome IS NOT NULL AND NOT (c.outcome = 'paid' AND c.method = 'mobile' AND CAST(round(CAST(c.reported AS DECIMAL(28,10)) * 100) AS BIGINT) = a.amount_minor
    AND NOT EXISTS (SELECT 1 FROM agreed g WHERE g.method = c.method AND g.checkout_id = c.checkout_id)) GROUP BY 1, 2)
SELECT id, status AS before, {AFTER} AS after FROM latest l LEFT JOIN decisive d ON d.method = l.method AND d.checkout_id = l.checkout_id""")
def _(t):
    # The status query knows the checkouts for which some receipt was issued.
    outcomes = b.outcomes(t)
    agreed = outcomes.filter("receipt IS NOT NULL").select("method", "checkout_id")
    return ledger.apply_outcomes(b.attempts(t), outcomes, agreed).select("id", "before", "after")


@query("settle_requests", "J8", f"""WITH {b.ATTEMPTS}
SELECT c_custkey AS request_id, q.quote_id, 'submitted' AS status, payment_reference FROM
  (SELECT c_custkey, 'Q' || CAST(c_custkey AS VARCHAR) AS quote_id FROM customer WHERE c_acctbal > 0) q
JOIN (SELECT quote_id, arg_max(reference, id) AS payment_reference FROM attempts WHERE status = 'paid' GROUP BY 1) p USING (quote_id)""")
def _(t):
    requests = t.customer.select(
        F.col("c_custkey").alias("request_id"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("quote_id"),
        F.when(F.col("c_acctbal") > 0, "awaiting_payment").otherwise("completed").alias("status"))
    return ledger.settle_requests(requests, b.attempts(t))


@query("oldest_pending", "L3", f"""WITH {b.ATTEMPTS}
SELECT id, reference, amount FROM attempts WHERE status = 'pending' ORDER BY id LIMIT 50""")
def _(t):
    return ledger.oldest_pending(b.attempts(t)).select("id", "reference", "amount")


@query("payment_states", "ST2 ST9", f"""WITH {b.ATTEMPTS}, {b.OUTCOMES}, j AS (
  SELECT a.id, a.status, o.outcome, o.receipt, (CAST(round(CAST(reported AS DECIMAL(28,10)) * 100) AS BIGINT) = amount_minor
     AND (coalesce(a.method, '') <> 'card' OR upper(coalesce(reported_currency, '')) = upper(coalesce(currency, '')))) AS same,
     coalesce(a.method, '') = 'card' AS card, strftime(o.at, '%Y%m%d%H%M%S') || seq AS place,
     o.at <= a.created_at + INTERVAL 10 MINUTE AS in_time
  FROM attempts a LEFT JOIN outcomes o ON o.attempt_id = a.id),
g AS (SELECT id, any_value(status) AS before, count(outcome) AS outcomes,
  arg_min(struct_pack(state := CASE WHEN outcome = 'paid' AND NOT coalesce(same, false) THEN 'needs_review' ELSE outcome END,
    receipt := receipt), place) FILTER (WHERE outcome IS NOT NULL AND in_time) AS f,
  arg_min(receipt, place) FILTER (WHERE receipt IS NOT NULL AND outcome = 'paid' AND same AND NOT card) AS late FROM j GROUP BY id)
SELECT id, before, CASE WHEN before <> 'pending' THEN before WHEN f IS NOT NULL THEN f.state ELSE 'expired' END AS after, outcomes,
  CASE WHEN before = 'pending' AND f IS NOT NULL THEN CASE WHEN f.state = 'paid' THEN coalesce(f.receipt, late) ELSE f.receipt END END AS receipt
FROM g""")
def _(t):
    return ledger.payment_states(b.attempts(t), b.outcomes(t))


@query("reconcile_pending", "M8 L3 J7", f"""WITH {b.ATTEMPTS}, {b.OUTCOMES},
batch AS (SELECT * FROM attempts WHERE status = 'pending' ORDER BY id LIMIT 500),
decisive AS (SELECT method, checkout_id, arg_min(struct_pack(outcome := outcome, reported := reported,
  ccy := reported_currency, receipt := receipt), seq) AS o FROM outcomes WHERE outcome IS NOT NULL AND method IS NOT NULL GROUP BY 1, 2),
latest AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY method, checkout_id ORDER BY id DESC) = 1),
moved AS (SELECT id, created_at, {AFTER} AS after, CASE WHEN status = 'pending' AND o IS NOT NULL THEN o.receipt END AS receipt
  FROM latest l LEFT JOIN decisive d ON d.method = l.method AND d.checkout_id = l.checkout_id)
SELECT id, CASE WHEN after = 'pending' AND created_at < TIMESTAMP '1997-06-01' - INTERVAL 10 MINUTE THEN 'expired' ELSE after END AS status,
  receipt FROM moved""")
def _(t):
    return ledger.reconcile(b.attempts(t), b.outcomes(t), "1997-06-01 00:00:00", 500)
