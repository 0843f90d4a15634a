"""Conversation structure repair by Wagner-Fischer target alignment (operator 11).

A conversation is sound if the initials of its roles, in order of turn, read (s?(ua)+)? and no
turn is blank, a copy of an earlier one, or cut short. The turns are aligned to the grammar's
string of every feasible length: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert
of an empty user or assistant turn 2, and a cut-short turn that stays 1; blank and copied turns
can only be deleted. Strings of different lengths that end alike are suffixes of one another, so
read from the end they are columns of one table, of which only an Ukkonen band is filled: a cell
w off the diagonal costs at least 2 * w more than the edits that no alignment avoids, and the
band doubles until the cheapest alignment found (the incumbent) proves what lies outside dearer.
Of every length that costs the least, the ASCII-least audit is traced back; the least of these
audits wins.

A conversation of more than SEGMENT turns is cut: each piece is aligned, in a task of its own, to
the target pieces between any two grammar states, costs are composed from the last piece to the
first, and audits from the first to the last. Inserted turns belong to the piece of the turn that
they stand before, so equal costs are settled as for the whole. Texts are held up to HOLD_BYTES
of a conversation; a longer one is read once more and hashed as a stream. What one task holds of
a conversation is a byte for each of its turns; one SHA-256 can't be split, so all turns of a
conversation pass through one task, in order.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own;
null turns come first and count for no gap; rows of equal turn are ordered by role, then text;
repeated rows are copies; very long texts pass through whole; an empty table gives an empty
result. A conversation without turns has zeros, an empty audit and the empty string's hash.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm.shared import written
from answerlake.llm.words import released

REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
SEGMENT = 512
HOLD_BYTES = 8 << 20
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)       # grammar states: what the repaired turns so far end with
LETTERS = b"suao"                               # initials; "o" is any other, upper case is cut short, "x" must go

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"
TALLY = f"conv_id CONV, {COUNTS}, cost long, audit string, repaired_sha256 string, segments array<binary>"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: a fifth of the rows damaged, by the CRC-32 of
    `conv_id:turn` modulo 20. Dropped rows stay with present = false."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       (F.crc32(key) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """The rows of a conversation together and in order, with a code: 4 * fault + initial, or
    -1 of a row that is not there. Faults: 0 none, 1 truncated, 2 duplicate, 3 blank."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       present.alias("present"))
    rows = rows.select("conv_id", "turn", "present", *[F.when(F.col("present"), F.col(c)).alias(c) for c in ("role", "text")])
    inked = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = (F.when(inked == "", 3).when(F.row_number().over(same) > 1, 2)
             .when(~F.substring(inked, -1, 1).isin(".", "!", "?"), 1).otherwise(0))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    rows = rows.repartition("conv_id").withColumn(
        "code", F.when(F.col("present"), 4 * fault + initial).otherwise(-1).cast("int")).drop("present")
    # of equal rows the first is no copy, so it comes first
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "code")


def _band(flags: bytes, end: int, w: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Wagner-Fischer from the end: [i, k - live[i] + w] is the cost of aligning the last i turns
    with the last k symbols of a target that ends in state `end`; live[i] turns may stay of them."""
    n = len(flags)
    live = np.concatenate([[0], np.cumsum([f != 120 for f in reversed(flags)])]).astype(np.int64)
    table = np.full((n + 1, 2 * w + 1), FAR, np.int64)
    span = np.arange(-w, w + 1)
    table[0, w] = 0
    if last:
        table[0, w:] = INSERT * np.arange(w + 1)
    for i in range(1, n + 1):
        flag, before, now = flags[n - i], table[i - 1], table[i]
        k = live[i] + span
        if flag == 120:
            now[:] = before + DELETE
        else:
            now[:-1] = before[1:] + DELETE      # k stays, the diagonal moves on by one
            low = flag | 32
            symbol = np.where((k % 2 == 1) == (end == ASSISTANT), 97, 117)
            stays = before + np.where(symbol == low, 0, REROLE) + (CUT_SHORT if flag < 97 else 0)
            np.minimum(now, np.where(k > 0, stays, FAR), out=now)
        now[k < 0] = FAR
        ramp = INSERT * span
        now[:] = np.minimum.accumulate(now - ramp) + ramp
        now[k < 0] = FAR
    return table, live


def _trace(flags: bytes, table: np.ndarray, live: np.ndarray, i: int, k: int, end: int) -> str:
    """The ASCII-least of the cheapest audits of the last i turns against k symbols."""
    n, w, out = len(flags), table.shape[1] // 2, []

    def at(i: int, k: int) -> int:
        j = k - live[i] + w
        return table[i, j] if k >= 0 and 0 <= j <= 2 * w else FAR

    while i or k:
        cost, flag = at(i, k), flags[n - i] if i else 120
        if i and at(i - 1, k) + DELETE == cost:
            out.append("D")
            i -= 1
        elif k and at(i, k - 1) + INSERT == cost:
            out.append("I")
            k -= 1
        else:
            symbol = 97 if (k % 2 == 1) == (end == ASSISTANT) else 117
            out.append("K" if symbol == flag | 32 else "R")
            i, k = i - 1, k - 1
    return "".join(out)


def _alignments(flags: bytes, state: int, last: bool, w: int, tables: dict):
    """(cost, end state, how): every target piece that leads from `state` to another state.
    how = (turns deleted before a kept system turn or None, turns left, symbols left)."""
    n = len(flags)
    if state in (START, SYSTEM):
        yield DELETE * n, state, (None, 0, 0)
    systems = [p for p, f in enumerate(flags) if f | 32 == 115] if state == START else []
    for p in systems:
        yield DELETE * (n - 1) + (CUT_SHORT if flags[p] < 97 else 0), SYSTEM, (p, 0, 0)
    for end in (USER, ASSISTANT):
        if (end, w) not in tables:
            tables[end, w] = _band(flags, end, w, last)
        table, live = tables[end, w]
        begins = [(None, n, 0, USER if state != USER else ASSISTANT)]
        begins += [(p, n - p - 1, DELETE * p + (CUT_SHORT if flags[p] < 97 else 0), USER) for p in systems]
        for p, i, spent, symbol in begins:
            k = np.arange(live[i] - w, live[i] + w + 1)
            fits = (k > 0) & (((k % 2 == 0) == (end == ASSISTANT)) == (symbol == USER))
            if p is None and state == end:
                fits |= k == 0
            for j in np.flatnonzero(fits & (table[i] < FAR)):
                yield spent + int(table[i, j]), end, (p, i, int(k[j]))


def _unavoidable(flags: bytes) -> tuple[int, int]:
    gone = flags.count(b"x")
    return DELETE * gone + CUT_SHORT * sum(f < 97 for f in flags), len(flags) - gone


def transitions(flags: bytes) -> list[int]:
    """Least cost of a piece between any two states, by 4 * from + to; FAR where none leads."""
    base, live = _unavoidable(flags)
    w = 4
    while True:
        out, tables = [FAR] * 16, {}
        for state in range(4):
            for cost, end, _ in _alignments(flags, state, False, w, tables):
                out[4 * state + end] = min(out[4 * state + end], cost)
        known = {(START, START), (START, SYSTEM), (SYSTEM, SYSTEM)}
        ways = [(s, e) for s in range(4) for e in range(4) if (s, e) in known or e in (USER, ASSISTANT)]
        if w > live + 4 or all((s, e) in known or out[4 * s + e] - base <= 2 * w + 1 for s, e in ways):
            return out
        w *= 2


def piece(flags: bytes, state: int, after: tuple[int, ...], last: bool) -> tuple[int, str, int]:
    """(cost with what follows, ASCII-least audit, end state) of a piece begun in `state`, where
    `after` holds the least cost of all that follows each end state."""
    base, live = _unavoidable(flags)
    w = 4
    while True:
        tables: dict = {}
        found = [(cost + after[end], end, how) for cost, end, how in _alignments(flags, state, last, w, tables)]
        least = min((x[0] for x in found), default=FAR)
        if w > live + 4 or least - min(after) - base <= 2 * w + 1:
            break
        w *= 2
    if least >= FAR:
        return FAR, "", state
    audits = []
    for cost, end, (p, i, k) in found:
        if cost == least:
            head = "D" * p + "K" if p is not None else ""
            if (i, k) == (0, 0) and end in (START, SYSTEM):
                audits.append((head + "D" * (len(flags) - len(head)), end))
            else:
                audits.append((head + _trace(flags, *tables[end, w], i, k, end), end))
    return least, *min(audits)


ENDS = (0, FAR, FAR, 0)


@lru_cache(maxsize=50_000)
def align(flags: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation of at most SEGMENT turns."""
    cost, audit, _ = piece(flags, START, ENDS, True)
    return cost, audit


def edits(audit: str) -> Iterator[tuple[str, str | None]]:
    """(letter, role) of each edit: the role that an inserted or reroled turn gets."""
    place = -(sum(c != "D" for c in audit) % 2)     # an odd length begins with a system turn
    for letter in audit:
        yield letter, ("user", "assistant")[place % 2] if letter in "IR" else None
        place += letter != "D"


class _Digest:
    """Hash of the repaired turns, fed by the turns in order."""

    def __init__(self, audit: str):
        self.todo, self.hash, self.any = edits(audit), hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.any else b"") + role.encode() + b":" + text.encode())
        self.any = True

    def turn(self, role: str, text: str) -> None:
        for letter, new in self.todo:
            if letter == "I":
                self._put(new, "")
                continue
            if letter != "D":
                self._put(new or role, text)
            return

    def close(self) -> str:
        for _, new in self.todo:
            self._put(new, "")
        return self.hash.hexdigest()


class _Tally:
    """Counts, flags and, up to a bound, the turns of one conversation."""

    def __init__(self, conv, segment: int, hold: int):
        self.segment, self.hold = segment, hold
        self.conv, self.flags, self.turns, self.held = conv, bytearray(), [], 0
        self.low = self.high = self.previous = None
        self.distinct, self.faults, self.illegal, self.initial = 0, [0, 0, 0, 0], 0, None

    def add(self, turn, role: str | None, text: str | None, code: int) -> None:
        if code < 0:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        fault, initial = divmod(code, 4)
        self.faults[fault] += 1
        if self.initial is not None and (self.initial, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.initial = initial
        flag = LETTERS[initial]
        self.flags.append(120 if fault > 1 else flag - 32 if fault else flag)
        if self.held <= self.hold:
            self.held += len(text) + len(role) + 64
            if self.held > self.hold:
                self.turns = []
            else:
                self.turns.append((role, text))

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        head = (self.conv, gaps, self.faults[3], self.faults[2], self.faults[1], self.illegal)
        if len(self.flags) > self.segment:
            cuts = [bytes(self.flags[i: i + self.segment]) for i in range(0, len(self.flags), self.segment)]
            return *head, None, None, None, cuts
        cost, audit = align(bytes(self.flags))
        if self.held > self.hold:
            return *head, cost, audit, None, None
        digest = _Digest(audit)
        for role, text in self.turns:
            digest.turn(role, text)
        return *head, cost, audit, digest.close(), None


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _tallied(batches: Iterator[pa.RecordBatch], segment: int, hold: int) -> Iterator[tuple]:
    tally = None
    for conv, turn, role, text, code in _rows(batches):
        if tally is None or conv != tally.conv:
            if tally:
                yield tally.row()
            tally = _Tally(conv, segment, hold)
        tally.add(turn, role, text, code)
    if tally:
        yield tally.row()


def _streamed(rows: DataFrame, function, schema: str) -> DataFrame:
    """Rows made by a generator over the rows of each partition."""
    empty = rows.sparkSession.createDataFrame([], schema)
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType.simpleString())) for f in empty.schema])
    return rows.mapInArrow(lambda x: released(_batches(function(x), arrow)), empty.schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(),
            "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}[kind]


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces come from the last to the first: adds the least cost of what follows each state."""
    conv, after = object(), ENDS
    for c, seg, flags, costs in _rows(batches):
        last = c != conv
        if last:
            conv, after = c, ENDS
        yield c, seg, flags, list(after), last
        if last:    # turns may be inserted after the last one, so its costs are not those of a piece within
            costs = [piece(flags, s, ENDS, True)[0] for s in range(4)]
            after = tuple(min(x, FAR) for x in costs)
        else:
            after = tuple(min(min(costs[4 * s + e] + after[e] for e in range(4)), FAR) for s in range(4))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces come in order, each with its audit from every state: follows the states."""
    conv, state, cost, out, begun = None, START, 0, [], False
    for c, _, costs, audits, ends in _rows(batches):
        if not begun or c != conv:
            if begun:
                yield conv, cost, "".join(out)
            conv, state, cost, out, begun = c, START, costs[START], [], True
        out.append(audits[state])
        state = ends[state]
    if begun:
        yield conv, cost, "".join(out)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for c, seg, flags, after, last in _rows(batches):
        found = [piece(flags, s, tuple(after), last) for s in range(4)]
        yield c, seg, [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation's audit comes first, then its turns in order."""
    conv, digest = None, None
    for c, audit, role, text in _rows(batches):
        if audit is not None:
            if digest:
                yield conv, digest.close()
            conv, digest = c, _Digest(audit)
        else:
            digest.turn(role, text)
    if digest:
        yield conv, digest.close()


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The repaired turns themselves, in the order of _hashed."""
    conv, todo, place = None, iter(()), 0
    for c, audit, role, text in _rows(batches):
        if audit is not None:
            for letter, new in todo:
                yield conv, place, letter, new, ""
                place += 1
            conv, todo, place = c, edits(audit), 0
            continue
        for letter, new in todo:
            if letter != "D":
                yield conv, place, letter, new or role, "" if letter == "I" else text
                place += 1
            if letter != "I":
                break
    for letter, new in todo:
        yield conv, place, letter, new, ""
        place += 1


def _aligned(coded: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, audit, role, text: each conversation's audit, then its turns in order."""
    names = audits.select(F.col("conv_id").alias("long_id"))
    turns = coded.filter("code >= 0").join(names, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    null = F.lit(None)
    stream = audits.select("conv_id", F.lit(0).alias("part"), null.cast("long").alias("turn"), null.cast("string").alias("role"),
                           null.cast("string").alias("text"), null.cast("int").alias("code"), "audit").union(
        turns.select("conv_id", F.lit(1), F.col("turn").cast("long"), "role", "text", "code", null.cast("string")))
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text", "code")
    return stream.select("conv_id", "audit", "role", "text")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations, by the audits of `found`."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    stream = _aligned(_coded(rows), found.select("conv_id", "audit"))
    return _streamed(stream, _rebuilt, f"conv_id {kind}, place long, edit string, role string, text string")


def _long_audits(tallied: DataFrame, kind: str) -> DataFrame:
    """conv_id, cost, audit of the conversations that came in pieces."""
    cut = tallied.filter("segments is not null").select("conv_id", F.posexplode("segments").alias("seg", "flags"))
    cut = cut.repartition("conv_id", "seg")
    costed = _streamed(cut, lambda x: ((c, s, f, transitions(f)) for c, s, f in _rows(x)), f"conv_id {kind}, seg int, flags binary, costs array<long>")
    costed = costed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    after = _streamed(costed, _followed, f"conv_id {kind}, seg int, flags binary, after array<long>, last boolean")
    found = _streamed(after.repartition("conv_id", "seg"), _pieces,
                      f"conv_id {kind}, seg int, costs array<long>, audits array<string>, ends array<int>")
    return _streamed(found.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), _walked, f"conv_id {kind}, cost long, audit string")


def repaired(rows: DataFrame, segment: int = SEGMENT, hold: int = HOLD_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation of (conv_id, turn, role, text); where there is a column present, its false rows
    are not turns, but their conversations are returned."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    coded = _coded(rows)
    tallied = written(_streamed(coded.select("conv_id", F.col("turn").cast("long"), "role", "text", "code"),
                                lambda x: _tallied(x, segment, hold), TALLY.replace("CONV", kind)), "tallied")
    columns = ["conv_id", *[c.split()[0] for c in COUNTS.split(", ")], "cost", "audit", "repaired_sha256"]
    done = tallied.filter("repaired_sha256 is not null").select(*columns)
    rest = tallied.filter("repaired_sha256 is null")
    if rest.isEmpty():
        return done
    audits = rest.filter("segments is null").select("conv_id", "cost", "audit").union(_long_audits(rest, kind))
    audits = written(audits, "audits")
    hashes = _streamed(_aligned(coded, audits), _hashed, f"conv_id {kind}, sha string")
    found = audits.toDF("a_id", "a_cost", "a_audit").join(hashes.toDF("h_id", "h_sha"), F.col("a_id").eqNullSafe(F.col("h_id")))
    rest = rest.join(found, F.col("conv_id").eqNullSafe(F.col("a_id"))).select(
        *columns[:-3], F.col("a_cost").alias("cost"), F.col("a_audit").alias("audit"), F.col("h_sha").alias("repaired_sha256"))
    return done.union(rest)
