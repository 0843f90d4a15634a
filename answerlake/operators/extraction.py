"""Jobs that turn free text into rows: entities, tables in prose, payable amounts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.functions.vocabulary import NEUTRAL, NUMBER_WORDS, Vocabulary

# Wording that marks an amount as owed to the reader, or as a charge.
ENTITLEMENT_WORDS = (
    "entitled", "entitlement", "voucher", "compensation", "compensated", "refund", "refunds", "refunded",
    "reimburse", "reimbursed", "claim", r"allowance\s+of", "credit", "deducted", r"less\s+any",
)
CHARGE_WORDS = (
    "fee", "fees", "charge", "charged", "charges", "surcharge", "payable", "cost", "costs", "costing", "excess",
    "supplementary", "incur", "incurs", "settle", "settled",
)


@dataclass(frozen=True)
class EntityRule:
    """``pattern`` finds a mention; the first non-empty ``groups`` entry is its value.
    ``code_like`` keeps only values that hold a digit or were typed in capitals."""

    kind: str
    pattern: str
    groups: tuple[int, ...] = (0,)
    reject: tuple[str, ...] = ()
    code_like: bool = False
    upper: bool = False


def extract_entities(df: DataFrame, ident: str, text: str, rules: Sequence[EntityRule]) -> DataFrame:
    """One row per accepted mention: (ident, kind, value, position), all rules in one pass."""

    def found(rule: EntityRule) -> Column:
        def value(mention: Column) -> Column:
            parts = [F.nullif(F.regexp_extract(mention, rule.pattern, g), F.lit("")) for g in rule.groups]
            return F.coalesce(*parts) if len(parts) > 1 else parts[0]

        values = F.transform(x.extract_all(F.col(text), rule.pattern), value)
        if rule.code_like:
            values = F.filter(values, lambda s: s.rlike("[0-9]") | (s == F.upper(s)))
        if rule.upper:
            values = F.transform(values, F.upper)
        if rule.reject:
            values = F.filter(values, lambda s: ~F.upper(s).isin(*rule.reject))
        kept = F.filter(values, lambda s: s.isNotNull())
        return F.transform(kept, lambda s, i: F.struct(
            F.lit(rule.kind).alias("kind"), s.alias("value"), i.alias("position")))

    return df.select(ident, F.explode(F.flatten(F.array(*[found(r) for r in rules]))).alias("e")).select(ident, "e.*")


@dataclass(frozen=True)
class RowRule:
    """Rows such as "From the hub: 10 for A, 20 for B." - the row pattern yields
    (row key, items), the item pattern yields (amount, column key)."""

    name: str
    row: str
    item: str


@dataclass(frozen=True)
class TierRule:
    """One sentence with fixed cells: ``cells`` maps a group to (row key, column key);
    ``limit`` is the group that holds the tier's limit as a word or number."""

    name: str
    pattern: str
    cells: tuple[tuple[int, str, str], ...]
    limit: int | None = None


def extract_tables(df: DataFrame, ident: str, text: str, rules: Sequence[RowRule | TierRule]) -> DataFrame:
    """Long table (ident, rule, row_key, column_key, amount) read out of prose."""
    body = F.regexp_replace(F.col(text), r"\s+", " ")

    def cell(rule: str, row: Column, column: Column, amount: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), row.alias("row_key"), column.alias("column_key"),
                        amount.alias("amount"))

    def from_rows(rule: RowRule) -> Column:
        def read(line: Column) -> Column:
            key = F.lower(F.regexp_extract(line, rule.row, 1))
            items = x.extract_all(F.regexp_extract(line, rule.row, 2), rule.item)
            return F.transform(items, lambda i: cell(
                rule.name, key, F.lower(F.regexp_extract(i, rule.item, 2)),
                F.regexp_extract(i, rule.item, 1).cast("double")))

        return F.flatten(F.transform(x.extract_all(body, rule.row), read))

    def number(raw: Column) -> Column:
        table = F.create_map(*[p for k, n in NUMBER_WORDS.items() for p in (F.lit(k), F.lit(float(n)))])
        return F.coalesce(F.element_at(table, F.lower(raw)), raw.try_cast("double"))

    def from_tier(rule: TierRule) -> Column:
        def read(sentence: Column) -> Column:
            cells = [cell(rule.name, F.lit(r), F.lit(c), F.regexp_extract(sentence, rule.pattern, g).cast("double"))
                     for g, r, c in rule.cells]
            if rule.limit is not None:
                cells.append(cell(rule.name, F.lit("limit"), F.lit("limit"),
                                  number(F.regexp_extract(sentence, rule.pattern, rule.limit))))
            return F.array(*cells)

        return F.flatten(F.transform(x.extract_all(body, rule.pattern), read))

    tables = [from_rows(r) if isinstance(r, RowRule) else from_tier(r) for r in rules]
    return (df.select(ident, F.explode(F.flatten(F.array(*tables))).alias("c")).select(ident, "c.*")
            .filter(F.col("amount").isNotNull()))


def amounts_by_context(df: DataFrame, answer: str = "answer", question: str = "question",
                       heading: str = "heading", vocab: Vocabulary = NEUTRAL, forms=x.MONEY_FORMS) -> DataFrame:
    """Adds the one payable (amount, currency) each answer states, or NULLs.

    With several figures in the first money sentence, each figure owns the words up
    to the next one; words every figure shares say nothing; the figure whose words
    the question repeats most wins, and a tie decides nothing.
    """
    pattern = x.money_pattern(forms)
    amounts = x.money(F.col(answer), forms)
    sentence = F.coalesce(F.get(F.filter(x.sentences(F.col(answer)), lambda s: s.rlike(pattern)), F.lit(0)), F.lit(""))
    mark = "\u0001"
    spans = F.slice(F.split(F.regexp_replace(F.col("sentence"), f"(?i)({pattern[4:]})", mark + "$1"), mark),
                    F.lit(2), F.lit(1 << 20))
    scope = F.filter(
        F.transform(spans, lambda s: F.struct(x.money(s, forms).alias("money"),
                                              F.array_distinct(x.tokenize(s, vocab)).alias("said"))),
        lambda s: F.size(s["money"]) == 1)
    shared = F.aggregate(F.col("scopes"), F.get(F.col("scopes"), F.lit(0))["said"],
                         lambda acc, s: F.array_intersect(acc, s["said"]))
    ranked = F.array_sort(F.filter(
        F.transform(F.col("scopes"), lambda s, i: F.struct(
            (-F.size(F.array_intersect(F.col("asked"), F.array_except(s["said"], F.col("shared"))))).alias("rank"),
            i.alias("i"), s["money"][0].alias("money"))),
        lambda r: r["rank"] < 0))
    best, second = F.get(F.col("ranked"), F.lit(0)), F.get(F.col("ranked"), F.lit(1))
    by_context = (F.when(F.size("asked") == 0, None)
                  .when(F.size("scopes") < 2, F.get(F.col("scopes"), F.lit(0))["money"][0])
                  .when(best["rank"] == second["rank"], None).otherwise(best["money"]))
    allowed = ~F.col("sentence").rlike(x.any_word(ENTITLEMENT_WORDS)) & (
        F.col("sentence").rlike(x.any_word(CHARGE_WORDS))
        | F.coalesce(F.col(heading), F.lit("")).rlike(x.any_word(CHARGE_WORDS)))
    chosen = F.when(allowed, F.when(F.size("amounts") == 1, F.col("amounts")[0])
                    .when(F.size("amounts") > 1, by_context))
    return (
        df.withColumns({"amounts": amounts, "sentence": sentence,
                        "asked": F.array_distinct(x.tokenize(F.col(question), vocab))})
        .withColumn("scopes", scope)
        .withColumn("shared", F.when(F.size("scopes") > 0, shared))
        .withColumn("ranked", ranked)
        .withColumn("chosen", chosen)
        .withColumns({"amount": F.col("chosen.amount"), "currency": F.col("chosen.currency")})
        .drop("amounts", "sentence", "asked", "scopes", "shared", "ranked", "chosen")
    )
