"""Follow-up questions completed from the questions before them, as one set of window aggregates.

A message that continues its session belongs to the chain of the last message that does not. A
message is cut once into parts: plain text, values of a slot (a cabin, a kind of journey) and
places with the preposition in front. What a message of a chain asks is the parts of the chain so
far, in order, of which a slot's first mention shows the latest value and its other mentions go,
and a place stays while no later message names one for the same end of the journey.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.functions.vocabulary import Vocabulary
from answerlake.streaming.rules import MEMORY_MINUTES, SECOND

# Openings that continue a question, and words without a subject.
OPENERS = (
    "and", "but", "also", "so", r"ok(?:ay)?,?\s+(?:and|what\s+about)", r"what\s+about", r"how\s+about", r"what\s+if",
    r"same\s+(?:for|with|question|thing)", r"is\s+(?:that|it)\s+the\s+same", r"does\s+(?:that|this|it)\s+(?:also\s+)?apply",
)
LEADING = ("and", "but", "also", "so", "ok(?:ay)?,?", r"what\s+about", r"how\s+about", r"what\s+if",
           r"same\s+(?:for|with|question|thing)(?:\s+for)?")
FILLER = tuple("""
and but also so what about how if for to from in on with the a an my class please
same then flight flights flying travelling traveling
""".split())
# Default slots of a travel desk (pass your own): a later value replaces the earlier one where it stood.
SLOTS = (
    r"\b(?:premium\s+economy|economy|business|first)(?:\s+class)?\b|\bclass\b",
    r"\b(?:domestic|international|regional|long[\s-]?haul|short[\s-]?haul)\b",
)
MAX_WORDS = 6

OPENED = rf"(?i)^\s*(?:{'|'.join(OPENERS)})\b"
MARKER = rf"(?i)^\s*(?:{'|'.join(LEADING)})\s*[,:]?\s*"
BEFORE_PLACE = r"(?:\b(?:to|for|from|in|at|into)\s+)?"
EDGE, KIND = "\x01", "\x02"     # around a part that is not plain, and behind its kind
OPEN, SHUT = "\x03", "\x04"     # around a phrase that is no place


def place_pattern(vocab: Vocabulary) -> str | None:
    """Forms of places in any case, codes in capitals only."""
    forms = [r"\b(?:" + "|".join(map(re.escape, vocab.place_forms())) + r")\b"] if vocab.place_forms() else []
    codes = [r"(?-i:\b(?:" + "|".join(c.upper() for c in vocab.place_codes) + r")\b)"] if vocab.place_codes else []
    return f"(?:{'|'.join(forms + codes)})(?![^{OPEN}{SHUT}]*{SHUT})" if forms or codes else None


def _fenced(text: Column, vocab: Vocabulary) -> Column:
    """Phrases that only look like places between fences, inside which no place is found."""
    for phrase in vocab.not_places:
        text = F.regexp_replace(text, rf"(?i)\b((?:{phrase}))\b", f"{OPEN}$1{SHUT}")
    return text


def _of(*kinds: str):
    return lambda p: p["kind"].isin(*kinds)


def is_follow_up(message: Column, vocab: Vocabulary, slots: tuple[str, ...] = SLOTS) -> Column:
    """Opens as a continuation, or consists of at most six words that name a slot or a place."""
    words = x.extract_all(F.lower(message), "[a-z]+")
    place = place_pattern(vocab)
    named = [message.rlike(f"(?i){s}") for s in slots] + ([_fenced(message, vocab).rlike(f"(?i){place}")] if place else [])
    slot = named[0] if named else F.lit(False)
    for test in named[1:]:
        slot = slot | test
    known = x.word_set(tuple(dict.fromkeys((*FILLER, *vocab.place_words()))))
    values = "|".join(f"(?:{s})" for s in slots)
    rest = F.filter(words, lambda w: ~F.array_contains(known, w) & (~w.rlike(f"^(?:{values})$") if slots else F.lit(True)))
    return F.coalesce(message.rlike(OPENED) | ((F.size(words) > 0) & (F.size(words) <= MAX_WORDS) & slot & (F.size(rest) == 0)), F.lit(False))


def _parts(text: Column, vocab: Vocabulary, slots: tuple[str, ...], number: Column) -> Column:
    """Array of (kind, value, first, message): kind is '' for plain text, a slot's number, 'from'
    or 'to' of a place; first marks a slot's first mention in the text."""
    for i, slot in enumerate(slots):
        text = F.regexp_replace(text, f"(?i)({slot})", f"{EDGE}{i}{KIND}$1{EDGE}")
    place = place_pattern(vocab)
    if place:
        text = _fenced(text, vocab)
        text = F.regexp_replace(text, rf"(?i)(\bfrom\s+{place})", f"{EDGE}from{KIND}$1{EDGE}")
        # a place behind "from" is cut out already: its part ends with the place
        text = F.regexp_replace(text, rf"(?i)(?<!{KIND})({BEFORE_PLACE}{place})(?!{EDGE})", f"{EDGE}to{KIND}$1{EDGE}")
    text = F.translate(text, OPEN + SHUT, "")
    cut = F.filter(F.split(text, EDGE), lambda p: F.length(p) > 0)
    split = F.transform(cut, lambda p: F.when(F.contains(p, F.lit(KIND)), F.struct(
        F.substring_index(p, KIND, 1).alias("kind"), F.substring_index(p, KIND, -1).alias("value"))).otherwise(
        F.struct(F.lit("").alias("kind"), p.alias("value"))))
    return x.let(split, lambda all_: F.transform(all_, lambda p, i: F.struct(
        p["kind"].alias("kind"), p["value"].alias("value"),
        (i == F.array_position(F.transform(all_, lambda q: q["kind"]), p["kind"]) - 1).alias("first"), number.alias("message"))))


def resolve_followups(messages: DataFrame, vocab: Vocabulary, slots: tuple[str, ...] = SLOTS,
                      ttl_minutes: int = MEMORY_MINUTES) -> DataFrame:
    """(session_id, id, follow_up, resolved) of ``messages`` with session_id, at, id and message
    (user messages only). A null message is empty."""
    kinds = [str(i) for i in range(len(slots))]
    session = W.partitionBy("session_id").orderBy("at", "id")
    rows = messages.select("session_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "id",
                           F.coalesce("message", F.lit("")).alias("message"))
    fresh = F.col("at") - F.lag("at").over(session) <= ttl_minutes * 60 * SECOND
    rows = rows.withColumn("follow_up", F.coalesce(fresh & is_follow_up(F.col("message"), vocab, slots), F.lit(False)))
    rows = rows.withColumn("chain", F.sum((~F.col("follow_up")).cast("long")).over(session.rowsBetween(W.unboundedPreceding, W.currentRow)))
    chain = W.partitionBy("session_id", "chain").orderBy("at", "id")
    rows = rows.withColumn("number", F.row_number().over(chain).cast("long"))

    said = F.when(F.col("follow_up"), F.regexp_replace("message", MARKER, "")).otherwise(F.col("message"))
    rows = rows.withColumn("parts", _parts(said, vocab, slots, F.col("number")))

    so_far = chain.rowsBetween(W.unboundedPreceding, W.currentRow)
    known = {}
    for k in kinds:
        value = F.get(F.filter("parts", _of(k)), F.lit(0))["value"]
        rows = rows.withColumn(f"value_{k}", value)
        named = F.when(F.col(f"value_{k}").isNotNull(), F.col("number"))
        known |= {f"latest_{k}": F.last(f"value_{k}", ignorenulls=True).over(so_far),
                  f"since_{k}": F.min(named).over(so_far), f"until_{k}": F.max(named).over(so_far)}
    for end in ("from", "to"):
        known[f"until_{end}"] = F.max(F.when(F.exists("parts", _of(end)), F.col("number"))).over(so_far)
    rows = rows.withColumns(known)

    # slots that the chain has already are no detail; a detail of filler alone adds nothing
    def old(p: Column) -> Column:
        return _any([(p["kind"] == k) & (F.col(f"since_{k}") < F.col("number")) for k in kinds])

    new = F.filter("parts", lambda p: ~old(p))
    words = x.extract_all(F.lower(F.array_join(F.transform(new, lambda p: p["value"]), "")), "[a-z]+")
    empty = F.size(F.filter(words, lambda w: ~F.array_contains(x.word_set(FILLER), w))) == 0
    slots_only = F.filter("parts", _of(*kinds)) if kinds else F.slice("parts", 1, 0)
    kept = F.when(F.col("follow_up") & empty, slots_only).otherwise(F.col("parts"))
    # a detail that begins with a bare place names a destination
    head = F.array_position(F.transform(kept, lambda p: ~old(p) & ~p["value"].rlike("^[ ,]*$")), True) - 1
    rows = rows.withColumns({"kept": kept, "head": F.when(F.col("follow_up"), head)})
    place = place_pattern(vocab) or "$^"
    rows = rows.withColumn("kept", F.transform("kept", lambda p, i: p.withField("value", F.when(
        (i == F.col("head")) & (p["kind"] == "to") & p["value"].rlike(f"(?i)^{place}"), F.concat(F.lit("to "), p["value"])).otherwise(p["value"]))))

    def shown(p: Column) -> Column:
        out = p["value"]
        for k in kinds:
            replaced = F.when((p["message"] == F.col(f"since_{k}")) & p["first"], F.col(f"latest_{k}")).otherwise("")
            out = F.when((p["kind"] == k) & (F.col(f"until_{k}") > F.col(f"since_{k}")), replaced).otherwise(out)
        for end in ("from", "to"):
            out = F.when((p["kind"] == end) & (p["message"] < F.col(f"until_{end}")), "").otherwise(out)
        return out

    rows = rows.withColumn("whole", F.flatten(F.collect_list("kept").over(so_far)))
    moved = F.greatest(F.coalesce("until_from", F.lit(0)), F.coalesce("until_to", F.lit(0)))

    def text_of(n: Column) -> Column:
        said = F.array_join(F.transform(F.filter("whole", lambda p: p["message"] == n), shown), "")
        return F.regexp_replace(F.when(n > 1, F.regexp_replace(said, "^[ ,]+|[ ,]+$", "")).otherwise(said), r"[ ?.!]+$", "")

    texts = F.transform(F.sequence(F.lit(1).cast("long"), F.col("number")), text_of)

    def join(parts: Column) -> Column:
        return F.array_join(F.filter(parts, lambda t: F.length(t) > 0), " ")

    # what was said before the last message with a place has had places cut out: its punctuation closes up, across messages too
    cut = F.greatest(moved - 1, F.lit(0)).cast("int")
    closed = F.regexp_replace(join(F.slice("texts", F.lit(1), cut)), r"\s+([?.!,])", "$1")
    joined = join(F.array(closed, join(F.slice("texts", cut + 1, F.size("texts")))))
    asked = F.concat(F.regexp_replace(F.regexp_replace(joined, r"\s{2,}", " "), r"^ +|\s+$|[ ?.!]+$", ""), F.lit("?"))
    rows = rows.withColumn("texts", texts)
    return rows.select("session_id", "id", "follow_up", F.when(F.col("follow_up"), asked).otherwise(F.col("message")).alias("resolved"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out
