"""Payment ledger: filters, money, summaries, outcomes and settlement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The life-cycle states of a payment attempt.
PENDING, PAID, FAILED, CANCELLED, EXPIRED = "pending", "paid", "failed", "cancelled", "expired"
NEEDS_REVIEW, SIMULATED = "needs_review", "simulated"
FINAL = (PAID, FAILED, CANCELLED, EXPIRED, NEEDS_REVIEW)
PENDING_TTL_MINUTES = 10
QUOTE_TTL_MINUTES = 15


def to_minor(amount: Column) -> Column:
    """Amount in minor units, rounded half up on its decimal spelling."""
    return F.round(amount.cast("decimal(28,10)") * 100, 0).cast("bigint")


def from_minor(minor: Column) -> Column:
    return F.coalesce(minor, F.lit(0)) / F.lit(100.0)


def filter_ledger(df: DataFrame, status: str | None = None, method: str | None = None,
                  q: str | None = None, methods: Sequence[str] = ("mobile", "card")) -> DataFrame:
    if status:
        df = df.filter(F.col("status") == status)
    if method in methods:
        df = df.filter(F.col("method") == method)
    if q and q.strip():
        needle = q.strip()[:60].lower()
        df = df.filter(F.lower("reference").contains(needle)
                       | F.lower(F.col("session_id").cast("string")).startswith(needle))
    return df


def backfill_ledger(df: DataFrame) -> DataFrame:
    """Brings old rows to the current codes and fills missing minor amounts."""
    status = F.col("status")
    return df.withColumns({
        "status": F.when(status == "initiated", PENDING).when(status.startswith(SIMULATED), SIMULATED)
        .otherwise(status),
        "amount_minor": F.coalesce("amount_minor", to_minor(F.col("amount"))),
    })


def ledger_summary(df: DataFrame, default_currency: str = "KES", default_method: str = "mobile") -> DataFrame:
    """Counts by status, by method, in all, and settled/pending money per currency,
    from one pass over the ledger with grouping sets."""
    keyed = df.select(
        "status", F.coalesce("method", F.lit(default_method)).alias("method"),
        F.upper(F.coalesce("currency", F.lit(default_currency))).alias("currency"), "amount_minor")
    sets = keyed.groupingSets(
        [("status",), ("method",), ("status", "currency"), ()], "status", "method", "currency",
    ).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.sum("amount_minor").alias("minor"),
    )
    status_only, method_only, money, total = 0b011, 0b101, 0b010, 0b111
    level = F.col("level")
    return (
        sets.withColumn(
            "part",
            F.when(level == status_only, "status").when(level == method_only, "method")
            .when((level == money) & (F.col("status") == PAID), "settled")
            .when((level == money) & (F.col("status") == PENDING), "pending")
            .when(level == total, "all"))
        .filter(F.col("part").isNotNull())
        .select(
            "part",
            F.when(F.col("part") == "status", F.col("status"))
            .when(F.col("part") == "method", F.col("method"))
            .when(F.col("part") == "all", F.lit("all")).otherwise(F.col("currency")).alias("key"),
            "n",
            F.when(level == money, from_minor(F.col("minor"))).alias("amount"))
    )


def coalesce_update(df: DataFrame, columns: Sequence[str], suffix: str = "_new") -> DataFrame:
    """Takes each new value where there is one and keeps the old value otherwise."""
    return df.withColumns({c: F.coalesce(c + suffix, c) for c in columns}).drop(*[c + suffix for c in columns])


def is_expired(expires_at: Column, now: Column) -> Column:
    """A missing expiry counts as expired."""
    return F.when(expires_at.isNull(), True).otherwise(now >= expires_at)


def to_local(amount: Column, currency: Column, rate: float, local: str = "KES") -> Column:
    """Amount in local money with the declared rate; converted amounts are whole."""
    return F.when(currency == local, amount).otherwise(F.round(amount * F.lit(rate), 0))


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """The newest attempt per (method, checkout_id)."""
    row = F.struct(*[c for c in attempts.columns if c not in ("method", "checkout_id")])
    return attempts.groupBy("method", "checkout_id").agg(F.max_by(row, "id").alias("row")).select(
        "method", "checkout_id", "row.*")


def is_card(method: Column) -> Column:
    return F.coalesce(method == "card", F.lit(False))


def same_money(row: dict[str, Column]) -> Column:
    """The reported amount is the charged one; a card must also report its currency, while
    a mobile provider settles in one currency and reports none."""
    amount = F.coalesce(row["reported_minor"] == row["minor"], F.lit(False))
    currency = F.upper(F.coalesce(row["reported_currency"], F.lit(""))) == F.upper(F.coalesce(row["currency"], F.lit("")))
    return amount & (~is_card(row["method"]) | currency)


def without_unconfirmed(outcomes: DataFrame, attempts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Outcomes but for mobile successes of the right amount that no status query agrees
    with: those leave their attempt pending. ``confirmed``: method, checkout_id."""
    keys = ["method", "checkout_id"]
    charged = attempts.select(*keys, F.col("amount_minor").alias("_charged"))
    agreed = confirmed.select(*keys).distinct().withColumn("_agreed", F.lit(True))
    rows = outcomes.join(charged, keys, "left").join(agreed, keys, "left")
    doubtful = (~is_card(F.col("method")) & (F.col("outcome") == PAID) & (to_minor(F.col("reported")) == F.col("_charged"))
                & F.col("_agreed").isNull())
    return rows.filter(~F.coalesce(doubtful, F.lit(False))).drop("_charged", "_agreed")


def apply_outcomes(attempts: DataFrame, outcomes: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """First decisive outcome of each pending attempt -> paid / needs_review / other.

    Outcomes are reduced to one row per checkout before the join, so replays and
    a checkout with very many callbacks cost one aggregate row each. With ``confirmed``
    (method, checkout_id of successes the provider's status query agrees with) a mobile
    success must be among them to count.
    """
    latest = latest_attempts(attempts)
    decisive = outcomes.filter(F.col("outcome").isNotNull())
    if confirmed is not None:
        decisive = without_unconfirmed(decisive, latest, confirmed)
    decisive = decisive.groupBy("method", "checkout_id").agg(
        F.min_by(F.struct("outcome", "reported", "reported_currency", "receipt"), "seq").alias("o"))
    joined = latest.join(decisive, ["method", "checkout_id"], "left")
    match = same_money({
        "reported_minor": to_minor(F.col("o.reported")), "minor": F.col("amount_minor"), "method": F.col("method"),
        "reported_currency": F.col("o.reported_currency"), "currency": F.col("currency")})
    moves = (F.col("status") == PENDING) & F.col("o.outcome").isNotNull()
    return joined.select(
        "id", "method", "checkout_id", F.col("status").alias("before"),
        F.when(~moves, F.col("status"))
        .when((F.col("o.outcome") == PAID) & ~match, F.lit(NEEDS_REVIEW))
        .otherwise(F.col("o.outcome")).alias("after"),
        F.when(moves, F.col("o.receipt")).alias("receipt"),
    )


def settle_requests(requests: DataFrame, payments: DataFrame) -> DataFrame:
    """Requests awaiting payment become submitted once their quote is paid."""
    paid = payments.filter((F.col("status") == PAID) & F.col("quote_id").isNotNull()).groupBy("quote_id").agg(
        F.max_by("reference", "id").alias("payment_reference"))
    waiting = requests.filter(F.col("status") == "awaiting_payment")
    return waiting.join(paid, "quote_id").select(
        "request_id", "quote_id", F.lit("submitted").alias("status"), "payment_reference")


def oldest_pending(attempts: DataFrame, n: int = 50) -> DataFrame:
    return attempts.filter(F.col("status") == PENDING).orderBy("id").limit(n)


def payment_states(attempts: DataFrame, outcomes: DataFrame, ttl_minutes: int = PENDING_TTL_MINUTES) -> DataFrame:
    """Final state of every attempt after all its outcomes, in event order.

    Only a pending attempt moves and it moves once, so the result is decided by
    its first decisive outcome (or by its expiry when that comes first) and is a
    plain min_by aggregate: replays, late rows and hot checkouts need no fold.
    Outcomes are ordered by event time, then seq, as in the stream form. A receipt
    that arrives later still fills an empty one on a paid mobile row of the same amount.
    """
    limit = F.make_dt_interval(mins=F.lit(ttl_minutes))
    method = F.col("method") if "method" in attempts.columns else F.lit(None).cast("string")      # none: mobile
    rows = attempts.select("id", "status", method.alias("method"), "amount_minor", "currency", "created_at").join(
        outcomes.select("attempt_id", "seq", "outcome", "reported", "reported_currency", "receipt", "at"),
        F.col("id") == F.col("attempt_id"), "left")
    match = same_money({
        "reported_minor": to_minor(F.col("reported")), "minor": F.col("amount_minor"), "method": F.col("method"),
        "reported_currency": F.col("reported_currency"), "currency": F.col("currency")})
    order = F.struct("at", "seq")
    # Still pending at the deadline: whatever arrives afterwards finds it expired.
    in_time = F.col("at") <= F.col("created_at") + limit
    decided = F.when((F.col("outcome") == PAID) & ~match, NEEDS_REVIEW).otherwise(F.col("outcome"))
    good_receipt = F.col("receipt").isNotNull() & (F.col("outcome") == PAID) & match & ~is_card(F.col("method"))
    grouped = rows.groupBy("id").agg(
        F.first("status").alias("before"),
        F.min_by(F.struct(decided.alias("state"), "receipt"),
                 F.when(F.col("outcome").isNotNull() & in_time, order)).alias("first"),
        F.min_by("receipt", F.when(good_receipt, order)).alias("late_receipt"),
        F.count("outcome").alias("outcomes"),
    )
    after = (F.when(F.col("before") != PENDING, F.col("before"))
             .when(F.col("first").isNotNull(), F.col("first.state")).otherwise(F.lit(EXPIRED)))
    return grouped.withColumn("after", after).select(
        "id", "before", "after", "outcomes",
        F.when((F.col("before") == PENDING) & F.col("first").isNotNull(),
               F.when(F.col("after") == PAID, F.coalesce("first.receipt", "late_receipt"))
               .otherwise(F.col("first.receipt"))).alias("receipt"))


def reconcile(attempts: DataFrame, outcomes: DataFrame, now: str, n: int = 50,
              ttl_minutes: int = PENDING_TTL_MINUTES, confirmed: DataFrame | None = None) -> DataFrame:
    """The n oldest pending attempts, brought up to date and expired when too old."""
    batch = oldest_pending(attempts, n)
    wanted = F.broadcast(batch.select("method", "checkout_id").distinct())      # n rows at most
    own = outcomes.join(wanted, ["method", "checkout_id"], "left_semi")
    updated = apply_outcomes(batch, own, confirmed).select("id", "after", "receipt")
    age_limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(ttl_minutes))
    return batch.select("id", "created_at").join(updated, "id").select(
        "id", F.when((F.col("after") == PENDING) & (F.col("created_at") < age_limit), EXPIRED)
        .otherwise(F.col("after")).alias("status"), "receipt")
