"""Toxicity by a weighted finite-state pattern grammar (operator 5).

Two transducers are composed. The lexical one reads words and writes classes: insult (with a
weight), threat, target, negation, reported speech. The clause one reads the classes of a
clause and keeps what it has met in its state; at every insult or threat it takes the arc of
its state, one of the PATTERNS, and adds the word's weight to it. A document's score is a
logistic function of its patterns' totals.

Insults and their weights are learned from labelled rows: words, and word beginnings that
stand for inflected forms, whose documents are nearly all labelled toxic and which follow many
different words (so that a copied passage teaches nothing). The arc weights are then fitted on
labelled rows that the words were not learned from. Both use a sample of labelled rows of at
most about MAX_ROWS, chosen by a hash of doc_id; everything else covers all rows. The learned
lexicon has at most MAX_ENTRIES entries.

Defined cases: a null or empty text has no clause and gets the score of one without a match;
without labels the fixed words and default arcs decide; repeated labels of a document count as
toxic if one does; rows that repeat a doc_id are scored one by one; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.words import pieces as cut
from answerlake.llm.words import released

PIECE = 2 << 20
MAX_ROWS = 60_000
HELD_FORMS = 200_000      # of a task before it passes its counts on
LEAST_DOCUMENTS = 4
LEAST_NEIGHBOURS = 4
LEAST_SHARE = 0.8
STEMS = (4, 5, 6)

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(1, 7)
# fixed values: closed word classes of four languages
CLASSES = {
    THREAT: "kill hurt destroy burn shoot stab strangle töten umbringen vernichten verprügeln tuer détruire frapper brûler matar destruir golpear quemar",
    TARGET: "you your yours yourself he she him her they them these those du dich dir dein deine ihr euch sie tu toi te vous ton ta tes votre vos "
            "tú ti usted ustedes vosotros tus ellos ellas",
    NEGATION: "not no never without nobody nor nicht kein keine keinen nie ohne pas jamais sans aucun nunca sin tampoco jamás",
    REPORT: "said says say wrote writes told claimed claims quoted reported sagte sagt schrieb behauptet dit écrit disait déclaré dijo dice escribió afirmó",
    STOP: ". ! ? ; \n",
}
SEEDS = "idiot moron imbecile scum idiotin dummkopf abschaum imbécile crétin ordure idiota imbécil escoria"
SEED_WEIGHT = 2.0
NEGATION_REACH = 3

PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported", "threat", "threat_target", "threat_negated", "threat_reported")
DEFAULT_ARCS = np.array([-3.0, 2.5, 3.0, 1.0, 1.0, 0.5, 2.5, 0.3, 0.3])      # constant first


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    arcs: np.ndarray = field(default_factory=DEFAULT_ARCS.copy)

    def lexical(self) -> dict:
        """The lexical transducer: (class, weight) of a word, worked out once for each word."""
        fixed = {w: (c, 1.0) for c, ws in CLASSES.items() for w in ([*ws.split(" ")])}
        fixed |= {w: (INSULT, SEED_WEIGHT) for w in SEEDS.split()} | {w: (INSULT, x) for w, x in self.words.items()}
        stems = self.stems

        class Lexicon(dict):
            def __missing__(self, word):
                if len(self) > 100_000:
                    self.clear()
                found = fixed.get(word)
                if not found or found[0] not in (INSULT, STOP):
                    heaviest = max((stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
                    found = (INSULT, heaviest) if heaviest else found
                self[word] = found
                return found

        return Lexicon()


def pattern_totals(text: str | None, lexicon: dict) -> np.ndarray:
    """Runs the clause transducer over a text."""
    totals = np.zeros(len(PATTERNS))
    met = [(i, c) for i, c in enumerate(map(lexicon.__getitem__, TOKEN.findall((text or "").lower()))) if c]
    clause, hits = [], []
    for i, (kind, weight) in [*met, (0, (STOP, 0.0))]:
        if kind == STOP:
            if hits:
                targeted = any(c == TARGET for _, c in clause)
                for at, c, w in hits:
                    reported = any(c2 == REPORT and j < at for j, c2 in clause)
                    negated = any(c2 == NEGATION and 0 < at - j <= NEGATION_REACH for j, c2 in clause)
                    arc = 3 if reported else 2 if negated else 1 if targeted else 0
                    totals[arc + (4 if c == THREAT else 0)] += w
            clause, hits = [], []
        elif kind in (INSULT, THREAT):
            hits.append((i, kind, weight))
        else:
            clause.append((i, kind))
    return totals


def toxic_score(totals: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Logistic function of the patterns' totals, on a scale where more adds less."""
    z = arcs[0] + np.log1p(totals) @ arcs[1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forms(words: list[str]):
    for before, word in zip(["", *words[:-1]], words, strict=True):
        yield word, before
        for n in STEMS:
            if len(word) > n:
                yield f"{word[:n]}*", before


def _toxic_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[int]] = {}
    for batch in (part for whole in batches for part in cut(whole, "text", PIECE)):
        for text in batch.column("text").to_pylist():
            here: dict[str, int] = {}
            for form, before in _forms([w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()]):
                here[form] = here.get(form, 0) | 1 << (sum(before.encode()) % 61)
            for form, mask in here.items():
                entry = total.setdefault(form, [0, 0])
                entry[0] += 1
                entry[1] |= mask
        if len(total) > HELD_FORMS:
            yield _form_rows(total)
            total = {}
    yield _form_rows(total)


def _form_rows(total: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()),
                                       pa.array([v[1] for v in total.values()], pa.int64())], names=["form", "n", "mask"])


def _clean_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = {}
    for batch in (part for whole in batches for part in cut(whole, "text", PIECE)):
        for text in batch.column("text").to_pylist():
            words = {w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()}
            for form in words.union(*({f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS)):
                total[form] = total.get(form, 0) + 1
        if len(total) > HELD_FORMS:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["form", "clean"])
            total = {}
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["form", "clean"])


def _totals(batches: Iterator[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    lexicon = grammar.lexical()
    for batch in (part for whole in batches for part in cut(whole, "text", PIECE)):
        rows = np.array([pattern_totals(t, lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, len(PATTERNS))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(rows), pa.list_(pa.float64()))], names=["toxic", "totals"])


def fit_arcs(x: np.ndarray, y: np.ndarray, decay: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the default arcs."""
    x = np.concatenate([np.ones((len(x), 1)), np.log1p(x)], 1)
    w, pull = DEFAULT_ARCS.copy(), np.full(x.shape[1], decay * 10)
    pull[0] = decay
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - DEFAULT_ARCS)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_grammar(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Grammar:
    """The grammar of labelled documents. `labels` holds the rows to learn from: doc_id, toxic."""
    labels = labels.select(F.col("doc_id").cast("long").alias("_doc"), F.col("toxic").cast("int").alias("toxic")).dropna()
    labels = labels.groupBy("_doc").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    rate = int(min(1.0, max_rows / max(n, 1)) * 1_000_000)
    sample = labels.withColumn("_roll", F.pmod(F.xxhash64("_doc"), F.lit(1_000_000))).filter(F.col("_roll") < rate)
    rows = documents.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(F.broadcast(sample), "_doc")   # at most about max_rows narrow rows
    learn, fit = rows.filter("_roll % 4 <> 0"), rows.filter("_roll % 4 = 0").select("text", "toxic")
    forms = learn.filter("toxic = 1").select("text").distinct().mapInArrow(lambda x: released(_toxic_forms(x)), "form string, n long, mask long")
    forms = forms.groupBy("form").agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask")).filter(
        (F.col("n") >= LEAST_DOCUMENTS) & (F.bit_count("mask") >= LEAST_NEIGHBOURS))
    clean = learn.filter("toxic = 0").select("text").mapInArrow(lambda x: released(_clean_forms(x)), "form string, clean long").groupBy("form").agg(
        F.sum("clean").alias("clean"))
    both = forms.join(clean.hint("merge"), "form", "left").select("form", "n", F.coalesce("clean", F.lit(0)).alias("clean"))
    grammar = Grammar()
    for form, n, others in both.filter(F.col("n") >= LEAST_SHARE * (F.col("n") + F.col("clean"))).orderBy("form").collect():
        weight = float(np.log((n + 0.5) / (others + 0.5)))
        (grammar.stems if form[-1] == "*" else grammar.words)[form.rstrip("*")] = weight
    found = fit.mapInArrow(lambda x: released(_totals(x, grammar)), "toxic int, totals array<double>").collect()     # at most about max_rows / 4
    if {r["toxic"] for r in found} == {0, 1}:
        grammar.arcs = fit_arcs(np.array([r["totals"] for r in found]), np.array([r["toxic"] for r in found], float))
    return grammar


def _scored(batches: Iterator[pa.RecordBatch], grammar: Grammar, name: str) -> Iterator[pa.RecordBatch]:
    lexicon = grammar.lexical()
    for batch in (part for whole in batches for part in cut(whole, "text", PIECE)):
        rows = np.array([pattern_totals(t, lexicon) for t in batch.column("text").to_pylist()]).reshape(-1, len(PATTERNS))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic_score(rows, grammar.arcs), pa.float64())], names=[*batch.schema.names, name])


def scored(documents: DataFrame, grammar: Grammar, name: str = "score") -> DataFrame:
    """Every row of documents with its score; `name` must not be a column yet."""
    if name in documents.columns:
        raise ValueError(f"there is a column {name} already")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in documents.dtypes), f"`{name}` double"])
    return documents.mapInArrow(lambda x: released(_scored(x, grammar, name)), schema)
