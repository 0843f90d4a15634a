"""Step functions of the sequential rules, shared by the batch and the stream form.

Times are microseconds. Every step is ``(state, row) -> (state, output)`` with a small
JSON-safe state, as ``sequences.walk_islands`` and ``streams.fold_stream`` expect.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

SECOND = 1_000_000

# Bucket -> (events, window in seconds).
LIMITS = {
    "chat_session": (12, 60), "chat_ip": (120, 60), "session_ip": (60, 600), "mobile_session": (5, 600),
    "mobile_phone": (5, 600), "poll_session": (120, 60), "receipt_session": (20, 60),
}
LOCKOUT = (5, 300)
MIN_REQUERY_SECONDS = 15
MEMORY_MINUTES = 30


def sliding_window(limit: int, window_s: int):
    """Row (key, at, id) -> (key, id, allowed, retry_after). A refused event does not count."""
    window = window_s * SECOND

    def step(state, row):
        key, at, ident = row
        kept = [t for t in (state or []) if t > at - window]
        if len(kept) >= limit:
            wait = max(1, math.ceil((kept[0] + window - at) / SECOND))
            return kept, (key, ident, False, wait)
        kept.append(at)
        return kept, (key, ident, True, None)

    return step


def bucket_windows():
    """Row (bucket, key, at, id, limit, window_s) -> (bucket, key, id, allowed, retry_after)."""
    steps = {}

    def step(state, row):
        bucket, key, at, ident, limit, window_s = row
        if (limit, window_s) not in steps:
            steps[limit, window_s] = sliding_window(limit, window_s)
        state, out = steps[limit, window_s](state, (key, at, ident))
        return state, (bucket, *out)

    return step


def lockout(n: int = LOCKOUT[0], seconds: int = LOCKOUT[1]):
    """Row (key, at, id, failed) -> (key, id, locked, failures, remaining). Failures are
    anchored at the first one; while locked nothing is recorded; success clears."""
    span = seconds * SECOND

    def step(state, row):
        key, at, ident, failed = row
        count, first = state or (0, None)
        if count >= n:
            left = span - (at - first)
            if left > 0:
                return [count, first], (key, ident, True, count, left // SECOND + 1)
            count, first = 0, None
        if not failed:
            return None, (key, ident, False, 0, 0)
        if first is None or at - first > span:
            count, first = 0, at
        return [count + 1, first], (key, ident, False, count + 1, 0)

    return step


def throttle(seconds: int = MIN_REQUERY_SECONDS):
    """Row (key, at, id) -> (key, id, accepted): at most one accepted per interval."""
    span = seconds * SECOND

    def step(state, row):
        key, at, ident = row
        if state is not None and at - state < span:
            return state, (key, ident, False)
        return at, (key, ident, True)

    return step


def one_open_attempt():
    """Row (quote, at, id, status, closes_at) -> (quote, id, created, attempt). A pending
    or paid attempt blocks further ones until it closes; failures never block."""

    def step(state, row):
        quote, at, ident, status, closes_at = row
        if status not in ("pending", "paid"):
            return state, (quote, ident, True, ident)
        if state is not None and (state[1] is None or state[1] > at):
            return state, (quote, ident, False, state[0])
        return [ident, closes_at], (quote, ident, True, ident)

    return step


def session_memory(ttl_minutes: int = MEMORY_MINUTES):
    """Row (session, at, id, query, item) -> (session, id, previous_query, previous_item):
    what is remembered when the row arrives; then its own values are merged in."""
    ttl = ttl_minutes * 60 * SECOND

    def step(state, row):
        session, at, ident, query, item = row
        fresh = state is not None and at - state[2] <= ttl
        out = (session, ident, state[0] if fresh else None, state[1] if fresh else None)
        if query is None and item is None:
            return state, out
        old = state or [None, None, at]
        return [query if query is not None else old[0], item if item is not None else old[1], at], out

    return step


def machine(transitions: Mapping[tuple[str | None, str], str], terminal: tuple[str, ...] = ()):
    """Row (key, at, id, event) -> (key, id, case_no, before, after, changed). An event
    without a transition changes nothing; from a terminal state only an event that is
    allowed from nothing starts the key's next case."""

    def step(state, row):
        key, at, ident, event = row
        number, current = state or [0, None]
        before = None if current in terminal else current
        after = transitions.get((before, event))
        if after is None:
            return state, (key, ident, number, current, current, False)
        if before is None:
            number += 1
        return [number, after], (key, ident, number, current, after, True)

    return step


# The case and request life cycles.
CASE_TERMINAL = ("closed",)
CASE_TRANSITIONS = {
    (None, "open"): "open", ("open", "claim"): "claimed", ("open", "close"): "closed", ("claimed", "close"): "closed",
    ("open", "withdraw"): "closed", ("claimed", "withdraw"): "closed",
}
REQUEST_STATES = ("awaiting_booking", "awaiting_new_name", "awaiting_confirmation", "awaiting_payment", "submitted",
                  "completed", "cancelled")
IN_DIALOG = REQUEST_STATES[:3]


REQUEST_EVENTS = ("start", "booked", "name", "confirm", "pay", "cancel", "complete")
REQUEST_MOVES = {
    ("name", "awaiting_new_name"): "awaiting_confirmation", ("confirm", "awaiting_confirmation"): "awaiting_payment",
    ("pay", "awaiting_payment"): "submitted", ("complete", "submitted"): "completed",
    ("cancel", "awaiting_booking"): "cancelled", ("cancel", "awaiting_new_name"): "cancelled", ("cancel", "awaiting_confirmation"): "cancelled",
}


def request_move(status: str | None, event: str) -> tuple[str | None, bool, bool]:
    """(status, whether a request opens, whether the one before is cancelled).

    ``start`` opens a request (awaiting the booking), ``booked`` starts at the name; both
    resume a request that was waiting for the booking. Any other request still in the
    dialogue is cancelled by a new one; one being paid or with staff is left alone.
    """
    if event in ("start", "booked"):
        opens = status != "awaiting_booking"
        return ("awaiting_booking" if event == "start" else "awaiting_new_name"), opens, opens and status in IN_DIALOG
    after = REQUEST_MOVES.get((event, status), status)
    return after, False, event == "cancel" and after != status


def request_lifecycle():
    """Row (session, at, id, event) -> (session, id, request_no, cancelled_no, status)."""

    def step(state, row):
        session, at, ident, event = row
        number, status = state or [0, None]
        after, opens, ends = request_move(status, event)
        return [number + opens, after], (session, ident, number + opens, number if ends else None, after)

    return step
