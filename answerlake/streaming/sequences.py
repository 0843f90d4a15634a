"""Sequential rules over ordered events: where each decision depends on the ones before it.

Two shapes, neither of which folds whole keys:

* Rules that forget after a pause (limits, lockouts, throttles). A key is cut into islands where
  the gap between events reaches the rule's memory; the rule starts anew there, so islands are
  dealt to tasks one by one and a hot key spreads. A task walks its islands as a stream with the
  few numbers that the rule remembers. A key that never pauses is one island and so one stream.
* Rules with finitely many states (cases, requests). An event is a function from state to state;
  functions compose, so slices of a few events reduce to one function each, slices of slices
  likewise, and every event's state comes from a prefix scan in the JVM. A hot key is many slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from answerlake.session import settle

# step(state, row) -> (new state, output row or None); state is None at a start; row is a
# tuple in column order, output a tuple in schema order.
Step = Callable[[object, tuple], tuple[object, tuple | None]]

SLICE_US = 86_400_000_000       # a key's events are windowed a day at a time
FAN_BITS = 6                    # 64 functions reduce to one


def frame_of(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=schema.names, dtype=object)
    for f in schema.fields:
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            frame[f.name] = frame[f.name].astype("Int64" if isinstance(f.dataType, T.LongType) else "Int32")
        elif isinstance(f.dataType, T.DoubleType):
            frame[f.name] = frame[f.name].astype("float64")
    return frame


def plain_rows(frame: pd.DataFrame):
    """Rows as tuples of Python values with None for missing ones."""
    columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in frame.columns]
    return zip(*columns, strict=True)


# ------------------------------------------------------------------- islands

def with_islands(rows: DataFrame, key: Sequence[str], memory: Column, slice_us: int = SLICE_US) -> DataFrame:
    """Adds ``island``: the time of the event that began it. An event begins an island if the key's
    event before it lies at least ``memory`` microseconds back.

    Events are compared within slices of time; what crosses a slice comes from one row for each
    slice that has events.
    """
    rows = rows.withColumns({"memory": memory, "slice_no": F.floor(F.col("at") / slice_us)})
    here = [*key, "slice_no"]
    over_slices = W.partitionBy(*key).orderBy("slice_no")
    ends = rows.groupBy(*here).agg(F.max("at").alias("ended")).withColumn("before", F.lag("ended").over(over_slices)).drop("ended")
    inside = W.partitionBy(*here).orderBy("at")
    marked = _same(rows, ends, here).withColumn("before", F.coalesce(F.lag("at").over(inside), "before"))
    marked = marked.withColumn("begun", F.when(F.coalesce(F.col("at") - F.col("before") >= F.col("memory"), F.lit(True)), F.col("at")))
    marked = settle(marked.drop("before"))
    so_far = over_slices.rowsBetween(W.unboundedPreceding, -1)
    carried = marked.groupBy(*here).agg(F.max("begun").alias("begun")).withColumn(
        "carried", F.last("begun", ignorenulls=True).over(so_far)).drop("begun")
    latest = F.max("begun").over(inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    return _same(marked, carried, here).withColumn("island", F.coalesce(latest, "carried")).drop("begun", "carried", "memory", "slice_no")


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join on keys that may be null."""
    named = right.withColumnsRenamed({k: f"{k}__" for k in key})
    both = F.lit(True)
    for k in key:
        both = both & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return left.join(named, both).drop(*[f"{k}__" for k in key])


def walk_islands(rows: DataFrame, key: Sequence[str], order: Sequence[str], step: Step, schema: str) -> DataFrame:
    """Walks every island of ``rows`` in order. Rows reach the step without the island column."""
    out, head, width = T.StructType.fromDDL(schema), [*key, "island"], len(rows.columns) - 1
    names = [c for c in rows.columns if c != "island"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, at = None, None, [names.index(k) for k in key]
        for frame in frames:
            made = []
            for row in plain_rows(frame):
                now = (*[row[i] for i in at], row[width])
                if now != current:
                    current, state = now, None
                state, result = step(state, row[:width])
                if result is not None:
                    made.append(result)
            yield frame_of(made, out)

    placed = rows.select(*names, "island").repartition(*head).sortWithinPartitions(*head, *order)
    return placed.mapInPandas(run, out)


# ------------------------------------------------------------- finite states

def apply_to(function: Column, state: Column) -> Column:
    """function: array of (to, add) by state from 0; state: (at, n)."""
    went = F.element_at(function, state["at"] + 1)
    return F.struct(went["to"].alias("at"), (state["n"] + went["add"]).alias("n"))


def _then(first: Column, second: Column) -> Column:
    """The function that does the first and then the second."""
    return F.transform(first, lambda x: F.struct(
        F.element_at(second, x["to"] + 1)["to"].alias("to"), (x["add"] + F.element_at(second, x["to"] + 1)["add"]).alias("add")))


def _scanned(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``so_far``: the composition of the functions of a group up to and with this row, by
    doubling: after round r it covers 2^r rows."""
    order = W.partitionBy(*group).orderBy("place")
    rows = rows.withColumn("so_far", F.col("function"))
    for r in range(FAN_BITS):
        before = F.lag("so_far", 1 << r).over(order)
        rows = rows.withColumn("before", before).withColumn(
            "so_far", F.when(F.col("before").isNull(), F.col("so_far")).otherwise(_then(F.col("before"), F.col("so_far"))))
    return rows.withColumn("before", F.lag("so_far").over(order))


def state_before(rows: DataFrame, key: str, order: Sequence[str], function: Column, states: int) -> DataFrame:
    """Adds ``state`` (at, n): a key's state and counter before each of its events.

    ``function`` maps state numbers to (to int, add long). Rows are sorted by range once and
    numbered where they lie, so that slices of a key are groups of at most 64 rows; each
    level has a 64th of the rows of the one below.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
    columns = rows.columns
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    level = settle(ranged.withColumn("number", F.monotonically_increasing_id()).withColumn("function", function))
    # a number is partition and row; packed closely, levels end sooner
    bits = int(level.agg(F.max(F.col("number").bitwiseAND(F.lit((1 << 33) - 1)))).first()[0] or 0).bit_length()
    level = level.withColumn("place", F.shiftleft(F.shiftright("number", 33), bits) + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))).drop("number")
    levels = []
    while True:
        group = [key, "slice_no"]
        level = _scanned(level.withColumn("slice_no", F.shiftright("place", FAN_BITS)), group)
        levels.append(level)
        above = settle(level.groupBy(*group).agg(F.max_by("so_far", "place").alias("function")).withColumnRenamed("slice_no", "place"))
        if above.groupBy(key).count().filter("count > 1").isEmpty():
            break
        level = above
    known = None
    for level in reversed(levels):
        if known is None:
            begun = level.withColumn("begun", start)
        else:
            begun = _same(level, known, [key, "slice_no"])
        state = F.when(F.col("before").isNull(), F.col("begun")).otherwise(apply_to(F.col("before"), F.col("begun")))
        known = begun.withColumn("state", state)
        if level is not levels[0]:
            known = known.select(key, F.col("place").alias("slice_no"), F.col("state").alias("begun"))
    return known.select(*columns, "state")
