"""Language proportions by mixture inference (operator 7).

Each language has a distribution of hashed byte trigrams around letters. The words of a
document are draws from a mixture of the languages, and expectation-maximisation estimates
its proportions from the words' n-gram likelihoods. Languages then leave the set one by one,
least first, each smaller set with its own estimate, and the set with the highest likelihood
less half the logarithm of the word count for each language in it is chosen.

Trigram counts come from a sample of at most about MAX_ROWS labelled rows, chosen by a hash of
doc_id; what the driver holds is LANGUAGES x BUCKETS numbers. All rows are predicted.

Defined cases: null texts and texts without a letter are `und` with score 0, as is every text
if no labelled row exists; equal proportions go to the language first by name; rows that
repeat a doc_id are predicted one by one; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlake.llm.words import pieces as cut

MAX_ROWS = 30_000
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 8
MOST_SETS = 4
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    grams: np.ndarray       # trigram bucket of every byte inside a word
    first: np.ndarray       # first of them for each word
    text: np.ndarray        # the text of each word


def word_grams(texts: list[str | None]) -> Words:
    data = "\n".join((t or "").lower().replace("\n", " ") for t in texts).encode()
    codes = np.frombuffer(b" " + data + b" ", np.uint8)
    inside = _IN_WORD[codes]
    letters = np.where(inside, codes, 32).astype(np.uint32)
    key = (letters[:-2] << 16 | letters[1:-1] << 8 | letters[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    at = np.flatnonzero(inside[1:-1])
    new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lines = np.cumsum(codes[1:-1] == 10)
    return Words(key[at].astype(np.int64), new, lines[at[new]] if len(at) else np.zeros(0, np.int64))


@dataclass
class Languages:
    names: list[str]
    log_share: np.ndarray       # [bucket, language]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, dict[str, float]]]:
        """(language, share of it in the mixture of all, chosen set with proportions) of each text."""
        out: list[tuple[str, float, dict[str, float]]] = [("und", 0.0, {})] * len(texts)
        if not self.names:
            return out
        words = word_grams(texts)
        if not len(words.first):
            return out
        fit = np.add.reduceat(self.log_share[words.grams], words.first, axis=0).astype(np.float64)
        new = np.flatnonzero(np.diff(words.text, prepend=-1))
        which, count = words.text[new], np.diff(np.append(new, len(words.text)))
        most = fit.max(1, keepdims=True)
        likely = np.exp(fit - most)
        ceiling = np.add.reduceat(most[:, 0], new)
        n, k = len(new), len(self.names)
        everything, value = self._mixture(likely, new, count, np.ones((n, k)))
        rank = np.argsort(np.argsort(-everything, axis=1, kind="stable"), axis=1, kind="stable")
        chosen = everything.copy()
        best = value + ceiling - 0.5 * np.log(count + 1.0) * k
        for size in range(min(k - 1, MOST_SETS), 0, -1):
            shares, value = self._mixture(likely, new, count, (rank < size).astype(float))
            score = value + ceiling - 0.5 * np.log(count + 1.0) * size
            better = score >= best
            chosen[better], best[better] = shares[better], score[better]
        top = chosen.argmax(1)
        for i, t in enumerate(which.tolist()):
            if LETTER.search(texts[t] or ""):
                found = {self.names[j]: float(chosen[i, j]) for j in np.flatnonzero(chosen[i] > 1e-6)}
                out[t] = (self.names[top[i]], float(min(1.0, everything[i, top[i]])), found)
        return out

    @staticmethod
    def _mixture(likely: np.ndarray, new: np.ndarray, count: np.ndarray, allowed: np.ndarray):
        """Proportions of the allowed languages of each text, and the log likelihood."""
        shares = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS if allowed.sum() > len(allowed) else 0):
            part = likely * np.repeat(shares, count, axis=0)
            part /= part.sum(1, keepdims=True) + 1e-300
            shares = np.add.reduceat(part, new, axis=0) / count[:, None]
        mixed = (likely * np.repeat(shares, count, axis=0)).sum(1)
        return shares, np.add.reduceat(np.log(mixed + 1e-300), new)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in cut(batch, "text", PIECE):
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = part.column("text").to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                grams = word_grams([t for t, x in zip(texts, langs, strict=True) if x == lang]).grams
                total[lang] = total.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
                                         names=["lang", "bucket", "n"])


def learn_languages(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Languages:
    """Trigram distributions of the languages of labelled rows (doc_id, text, lang)."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    rate = int(min(1.0, max_rows / max(rows.count(), 1)) * 1_000_000)
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate).select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    table = np.full((BUCKETS, len(packed)), SMOOTHING)
    for i, r in enumerate(packed):
        table[r["b"], i] += r["n"]
    return Languages([r["lang"] for r in packed], np.log(table / table.sum(0)).astype(np.float32))


def _predicted(batches: Iterator[pa.RecordBatch], model: Languages) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in cut(batch, "text", PIECE):
            found = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                names=[*part.schema.names, "lang_pred", "score", "proportions"])


def predicted(documents: DataFrame, model: Languages) -> DataFrame:
    """Every row of documents with lang_pred, score and the chosen languages' proportions."""
    clash = {"lang_pred", "score", "proportions"} & set(documents.columns)
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in documents.dtypes), "lang_pred string, score double, proportions map<string,double>"])
    return documents.mapInArrow(lambda x: _predicted(x, model), schema)
