"""Composed answers and their quality: sentences, citations, the three metrics, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.functions.vocabulary import NEUTRAL, Vocabulary
from answerlake.plans import retrieval

# Number words and units of the numeric-band rule.
BAND_NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "twenty-four": 24, "twenty four": 24, "forty-eight": 48, "seventy-two": 72,
}
UNITS = {
    "kg": "kg", "kilo": "kg", "kilos": "kg", "kilogram": "kg", "kilograms": "kg", "hour": "hour", "hours": "hour",
    "hr": "hour", "hrs": "hour", "day": "day", "days": "day", "character": "character", "characters": "character",
}
SYNTHETIC_NOTE = "Note: this answer draws on a document written for a prototype rather than on a published policy."
NOTHING_FOUND = "I could not find that in the documents I have access to."
NO_SENTENCE = "I could not find a specific answer to that in the policy documents."
# Floors of supporting sentences relative to the best one, and sizes.
SAME_CHUNK_FLOOR, OTHER_CHUNK_FLOOR = 0.7, 0.92
SENTENCES, PART_SENTENCES, MULTI_PART_SENTENCES = 3, 2, 5

_UNIT = r"kg|hours?|hrs?|days?"
_RANGE = rf"(?i)between\s+(\d+)\s*({_UNIT}|characters?)?\s+and\s+(\d+)\s*({_UNIT}|characters?)?"
_TO_RANGE = rf"(?iU)\b(\d+)\s+to\s+(\d+)\s*({_UNIT})\b"
_OVER = rf"(?i)(?:more than|over|exceeding|greater than|beyond)\s+(\d+)\s*({_UNIT})"
_NOT_OVER = r"(?iU)\b(?:not|never|without)\s+(?:\w+\s+){0,2}?(?:more than|over|exceeding|greater than)\s+(\d+)"
_QUANTITY = r"(?i)(\d+(?:\.\d+)?)\s*(kg|kilos?|kilograms?|hours?|hrs?|days?)"


# --------------------------------------------------------------- numeric bands

def _unit(raw: Column) -> Column:
    table = F.create_map(*[F.lit(p) for pair in UNITS.items() for p in pair])
    return x.let(F.lower(raw), lambda word: F.when(word == "", None).otherwise(F.coalesce(F.element_at(table, word), word)))


def quantities(question: Column) -> Column:
    """(value, unit) pairs a question mentions."""
    return F.transform(x.extract_all(question, _QUANTITY), lambda m: F.struct(
        F.regexp_extract(m, _QUANTITY, 1).cast("double").alias("value"),
        _unit(F.regexp_extract(m, _QUANTITY, 2)).alias("unit")))


def spell_digits(sentence: Column) -> Column:
    out = sentence
    for word in sorted(BAND_NUMBERS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", str(BAND_NUMBERS[word]))
    return F.when(sentence.rlike(x.any_word(tuple(BAND_NUMBERS))), out).otherwise(sentence)


def band_bonus(sentence: Column, asked: Column) -> Column:
    """+6 / -2 for a stated range that does / does not hold an asked quantity, +3 / -1
    for a threshold it does / does not exceed; other units and negated thresholds do
    not count. The spelt sentence, its negated thresholds and the asked quantities are made
    once a row, not once for each pattern, band or pair."""
    def group(m: Column, pattern: str, n: int) -> Column:
        return F.regexp_extract(m, pattern, n)

    def band(low: Column, high: Column, unit: Column) -> Column:
        return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), unit.alias("unit"),
                        F.lit(6.0).alias("inside"), F.lit(-2.0).alias("outside"))

    def bands(text: Column) -> Column:
        ranges = F.transform(x.extract_all(text, _TO_RANGE), lambda m: band(
            group(m, _TO_RANGE, 1), group(m, _TO_RANGE, 2), _unit(group(m, _TO_RANGE, 3))))
        between = F.transform(x.extract_all(text, _RANGE), lambda m: band(
            group(m, _RANGE, 1), group(m, _RANGE, 3),
            F.coalesce(_unit(group(m, _RANGE, 2)), _unit(group(m, _RANGE, 4)))))
        said = F.transform(x.extract_all(text, _OVER), lambda m: F.struct(
            group(m, _OVER, 1).cast("double").alias("low"), F.lit(float("inf")).alias("high"),
            _unit(group(m, _OVER, 2)).alias("unit"), F.lit(3.0).alias("inside"), F.lit(-1.0).alias("outside")))
        over = x.let(F.transform(x.extract_all(text, _NOT_OVER, 1), lambda n: n.cast("double")),
                     lambda negated: F.filter(said, lambda b: ~F.array_contains(negated, b["low"])))
        return F.concat(ranges, between, over)

    def score(b: Column, asked: Column) -> Column:
        def one(q: Column) -> Column:
            above = F.when(b["inside"] == 3.0, q["value"] > b["low"]).otherwise(q["value"] >= b["low"])
            other_unit = F.coalesce(b["unit"] != q["unit"], F.lit(False))
            return F.when(other_unit, 0.0).when(above & (q["value"] <= b["high"]), b["inside"]).otherwise(b["outside"])

        return F.aggregate(asked, F.lit(0.0), lambda s, q: s + one(q))

    def total(asked: Column) -> Column:
        return x.let(x.let(spell_digits(sentence), bands), lambda found: F.aggregate(
            found, F.lit(0.0), lambda s, b: s + score(b, asked)))

    return x.let(asked, lambda q: F.when(F.size(q) == 0, 0.0).otherwise(total(q)))


# ----------------------------------------------------------- answer composition

def clean(sentence: Column) -> Column:
    return x.strip(F.regexp_replace(sentence, r"\s+", " "))


def is_heading(sentence: Column) -> Column:
    return sentence.rlike(r"(?i)^Section\s+\d+\s*:\s*[^.]*$") | (
        (F.size(F.split(sentence, r"\s+")) <= 8) & ~sentence.endswith("."))


def sentence_scores(parts: DataFrame, hits: DataFrame, vocab: Vocabulary = NEUTRAL) -> DataFrame:
    """Scored candidate sentences. ``parts`` is (query_id, part, question), ``hits``
    carries rank, score, section and text."""
    asked = parts.select(
        "query_id", "part", F.array_distinct(x.tokenize(F.col("question"), vocab)).alias("base"),
        F.array_distinct(x.expand(x.tokenize(F.col("question"), vocab), vocab)).alias("wanted"),
        quantities(F.col("question")).alias("quantities"))
    heading = x.tokenize(F.regexp_replace(F.coalesce("section", F.lit("")), r"(?i)^\s*section\s+\d+\s*:\s*", ""), vocab)
    sources = hits.select("query_id", "rank", "chunk_id", "score", "text",
                          F.array_distinct(heading).alias("heading"),
                          F.array_distinct(x.expand(F.array_distinct(heading), vocab)).alias("heading_forms"))
    rows = sources.join(asked, "query_id").select(
        "query_id", "part", "rank", "chunk_id", "score", "base", "wanted", "quantities",
        (F.size(F.array_intersect("wanted", "heading")) * 1.5
         + F.size(F.array_intersect("base", "heading_forms")) / F.greatest(F.size("base"), F.lit(1)) * 3.0).alias("heading_bonus"),
        F.posexplode(F.split("text", x.SENTENCE_END)).alias("position", "raw"))
    said = rows.withColumn("sentence", clean(F.col("raw"))).filter(
        (F.length("sentence") > 0) & ~is_heading(F.col("sentence")))
    said = said.withColumn("overlap", F.size(F.array_intersect("wanted", F.array_distinct(
        x.tokenize(F.col("sentence"), vocab))))).filter("overlap > 0")
    total = (F.col("overlap") + F.col("overlap") / F.greatest(F.size("wanted"), F.lit(1)) * 2.0 + F.col("heading_bonus")
             + band_bonus(F.col("sentence"), F.col("quantities")) + F.col("score") * 4.0
             + F.greatest(F.lit(0.0), 1.0 - (F.col("rank") - 1) * 0.25))
    return said.select("query_id", "part", "rank", "chunk_id", "position", "sentence",
                       F.round(total, 6).alias("sentence_score"))


def select_sentences(scored: DataFrame, n: int | Column = SENTENCES) -> DataFrame:
    """The best sentence and the ones close enough to it, repeated wording dropped.
    Groups are the sentences of one question's k hits."""
    key = ["query_id", "part"]
    order = [F.desc("sentence_score"), "rank", "position"]
    best = W.partitionBy(*key).orderBy(*order)
    floor = F.when(F.col("chunk_id") == F.first("chunk_id").over(best), SAME_CHUNK_FLOOR).otherwise(OTHER_CHUNK_FLOOR)
    near = scored.withColumns({"place": F.row_number().over(best), "floor": floor * F.first("sentence_score").over(best)})
    near = near.filter((F.col("place") == 1) | (F.col("sentence_score") >= F.col("floor")))
    same = W.partitionBy(*key, F.lower("sentence")).orderBy("place")
    once = near.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    kept = once.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("place")))
    return kept.filter(F.col("place") <= n).drop("floor", "copy")


def compose(questions: DataFrame, hits: DataFrame, vocab: Vocabulary = NEUTRAL, verbose: bool = True,
            edition: str | None = None, provenance: str | None = None) -> DataFrame:
    """(query_id, answer): extracted sentences with their citations. ``hits`` carries
    source, section, text, rank and score, and optionally the columns named by
    ``edition`` (citation suffix) and ``provenance`` (``synthetic`` adds the note)."""
    split = x.split_question(F.col("text"), vocab) if verbose else F.array("text")
    asked = questions.select("query_id", split.alias("parts")).select(
        "query_id", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "question"))
    label = x.section_label(F.col("source"), F.col("section"), F.col(edition) if edition else None)
    made_up = (F.col(provenance) == "synthetic") if provenance else F.lit(False)
    cited = hits.select("query_id", "chunk_id", "rank", "text", label.alias("label"), made_up.alias("made_up"))
    scored = sentence_scores(asked, hits, vocab)
    chosen = select_sentences(scored.join(asked.select("query_id", "part", "n_parts"), ["query_id", "part"]),
                              F.when(F.col("n_parts") > 1, PART_SENTENCES).otherwise(SENTENCES))
    repeat = W.partitionBy("query_id", F.lower("sentence")).orderBy("part", "place")
    merged = chosen.withColumn("copy", F.row_number().over(repeat)).filter("copy = 1").withColumn(
        "step", F.row_number().over(W.partitionBy("query_id").orderBy("part", "place")))
    most = F.lit(MULTI_PART_SENTENCES) if verbose else F.lit(1)
    body = merged.filter(F.col("step") <= most).join(cited.drop("text", "rank"), ["query_id", "chunk_id"]).groupBy(
        "query_id").agg(F.array_sort(F.collect_list(F.struct("step", "sentence", "label", "made_up"))).alias("s"))
    labels = F.filter(F.array_distinct(F.transform("s", lambda r: r["label"])), lambda name: F.length(name) > 0)
    answer = F.concat(
        F.array_join(F.transform("s", lambda r: r["sentence"]), " "),
        F.when(F.size(labels) > 0, F.concat(F.lit("\n\nSource: "), F.array_join(labels, "; "))).otherwise(""),
        F.when(F.exists("s", lambda r: r["made_up"]), F.lit("\n\n" + SYNTHETIC_NOTE)).otherwise(""))
    first = F.get(F.filter(F.transform(F.split("text", x.SENTENCE_END), clean),
                           lambda s: (F.length(s) > 0) & ~is_heading(s)), F.lit(0))
    fallback = cited.filter("rank = 1").select("query_id", F.coalesce(
        F.concat(first, F.lit("\n\nSource: "), "label"), F.lit(NO_SENTENCE)).alias("fallback"))
    return (questions.select("query_id").join(body.select("query_id", answer.alias("answer")), "query_id", "left")
            .join(fallback, "query_id", "left")
            .select("query_id", F.coalesce("answer", "fallback", F.lit(NOTHING_FOUND)).alias("answer")))


# ------------------------------------------------------------------ the metrics

def context_relevance(questions: DataFrame, hits: DataFrame) -> DataFrame:
    value = F.coalesce("dense_score", "score")
    mean = hits.groupBy("query_id").agg(F.avg(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("m"))
    return questions.select("query_id").join(mean, "query_id", "left").select(
        "query_id", F.round(F.coalesce("m", F.lit(0.0)), 3).alias("context_relevance"))


def without_sources(answer: Column, marker: str = "source:") -> Column:
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda s: ~F.lower(x.strip(s)).startswith(marker))
    return F.array_join(lines, "\n")


def hit_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): source, section and text of a question's hits, in rank order."""
    block = F.struct("rank", F.concat_ws(" ", "source", "section", "text").alias("t"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(block)), lambda b: b["t"]), " ").alias("context"))


def groundedness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, groundedness): share of an answer's checkable sentences the context supports."""
    ctx = contexts.select(
        "query_id", x.content_words(F.coalesce("context", F.lit(""))).alias("known"),
        x.numeric_atoms(F.coalesce("context", F.lit(""))).alias("figures"),
        F.transform(F.filter(F.split(F.coalesce("context", F.lit("")), x.SENTENCE_END), lambda s: F.length(x.strip(s)) > 0),
                    lambda s: F.struct(x.content_words(s).alias("said"), x.has_negation(s).alias("negated"))).alias("lines"))
    base = answers.select("query_id", without_sources(F.col("answer")).alias("claims")).join(ctx, "query_id", "left")
    rows = base.select("query_id", "known", "figures", "lines",
                       F.explode(F.split("claims", x.SENTENCE_END)).alias("sentence"))
    rows = rows.filter(F.col("sentence").rlike("[a-zA-Z0-9']{3,}")).withColumns({
        "numbers": x.numeric_atoms(F.col("sentence")), "said": x.content_words(F.col("sentence"))})
    rows = rows.withColumn("shared", F.size(F.array_intersect("said", "known")))
    rows = rows.filter((F.size("numbers") > 0) | (F.col("shared") > 0))
    aligned = F.array_max(F.transform("lines", lambda c, i: F.struct(
        F.size(F.array_intersect(F.col("said"), c["said"])).alias("n"), (-i).alias("first"), c["negated"].alias("negated"))))
    overlap = F.when(F.size("said") > 0, F.col("shared") / F.size("said")).otherwise(0.0)
    invented = F.size(F.array_except("numbers", "figures")) > 0
    off_topic = (overlap < 0.35) & ~F.arrays_overlap("numbers", "figures")
    denies = F.when(x.has_negation(F.col("sentence")), F.coalesce(
        (aligned["n"] > 0) & ~aligned["negated"], F.lit(False))).otherwise(False)
    usable = (F.size("known") > 0) | (F.size("figures") > 0)
    good = F.when(usable & ~invented & ~off_topic & ~denies, 1.0).otherwise(0.0)
    per = rows.groupBy("query_id").agg(F.round(F.avg(good), 3).alias("g"))
    return answers.select("query_id").join(per, "query_id", "left").select(
        "query_id", F.coalesce("g", F.lit(0.0)).alias("groundedness"))


def missing_keys(answer: Column, keys: Column) -> Column:
    """Gold keys neither spelled in the answer nor covered by its figures."""
    lowered, stated = F.lower(answer), x.numeric_atoms(answer)

    def absent(key: Column, low: Column, figures: Column) -> Column:
        needed = x.numeric_atoms(key)
        by_figure = (F.size(needed) > 0) & (F.size(F.array_except(needed, figures)) == 0)
        return ~(F.contains(low, F.lower(key)) | by_figure)

    return x.let(F.struct(lowered.alias("low"), stated.alias("figures")), lambda a: F.filter(
        F.filter(F.transform(keys, lambda k: x.strip(k)), lambda k: F.length(k) > 0), lambda k: absent(k, a["low"], a["figures"])))


def answer_relevance_gold(answer: Column, keys: Column) -> Column:
    n = F.size(F.filter(keys, lambda k: F.length(x.strip(k)) > 0))
    return F.when(F.length(x.strip(answer)) == 0, 0.0).otherwise(
        F.round((n - F.size(missing_keys(answer, keys))) / n, 3))


def answer_relevance(answer: Column, question: Column) -> Column:
    """Question coverage times novelty: repeating the question back scores low."""
    def rate(asked: Column, said: Column) -> Column:
        shared = F.size(F.array_intersect(asked, said))
        return F.when((F.size(asked) == 0) | (F.size(said) == 0), 0.0).otherwise(
            F.round(F.least(shared / F.size(asked), F.lit(1.0)) * ((F.size(said) - shared) / F.size(said)), 3))

    return x.let(x.content_words(question), lambda asked: x.let(
        x.content_words(F.coalesce(answer, F.lit(""))), lambda said: rate(asked, said)))


def evaluate(questions: DataFrame, answers: DataFrame, hits: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The three metrics of every answer; gold keys (query_id, keys) are used where given."""
    base = questions.select("query_id", "text").join(answers.select("query_id", "answer"), "query_id")
    plain = answer_relevance(F.col("answer"), F.col("text"))
    if keys is not None:
        base = base.join(keys, "query_id", "left")
        own = F.coalesce(F.size(F.filter("keys", lambda k: F.length(x.strip(k)) > 0)), F.lit(0)) > 0
        plain = F.when(own, answer_relevance_gold(F.col("answer"), F.col("keys"))).otherwise(plain)
    return (base.select("query_id", plain.alias("answer_relevance"))
            .join(context_relevance(questions, hits), "query_id")
            .join(groundedness(answers, hit_context(hits)), "query_id")
            .select("query_id", "context_relevance", "groundedness", "answer_relevance"))


def withheld(answer: Column, prompt: Column) -> Column:
    """Why an answer must not be shown: it states figures its prompt does not, or NULL."""
    invented = F.array_sort(F.array_except(x.numeric_atoms(without_sources(answer, "source")), x.numeric_atoms(prompt)))
    return F.when(F.length(x.strip(F.coalesce(answer, F.lit("")))) == 0, F.lit("empty answer")).otherwise(
        x.let(invented, lambda n: F.when(F.size(n) > 0, F.concat(
            F.lit("states figures not in the context ("),
            F.array_join(F.transform(F.slice(n, 1, 3), lambda v: F.regexp_replace(v.cast("decimal(30,4)").cast("string"), r"\.?0+$", "")), ", "),
            F.lit(")")))))


def measure(questions: DataFrame, answers: DataFrame, hits: DataFrame, gold: DataFrame,
            keys: DataFrame | None = None) -> DataFrame:
    """One row: metric means over all questions and over multi-document ones, recall."""
    scores = evaluate(questions, answers, hits, keys)
    wide = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("gold"))
    joined = scores.join(wide, "query_id", "left")
    recall = retrieval.recall_at_k(hits, gold)

    def mean(name: str) -> Column:
        return F.round(F.avg(name), 3).alias(name)

    return joined.agg(
        F.count(F.lit(1)).alias("questions"), mean("context_relevance"), mean("groundedness"), mean("answer_relevance"),
        F.round(F.avg(F.when(F.col("gold") > 1, F.col("answer_relevance"))), 3).alias("answer_relevance_multi"),
    ).withColumns({"any_at_k": recall.select(F.round("any_hit", 3).alias("v")).scalar(),
                   "all_at_k": recall.select(F.round("all_hit", 3).alias("v")).scalar()})


# -------------------------------------------------------------- runs and gates

def medians(rows: DataFrame, key: str, value: str, buckets: int = 1024) -> DataFrame:
    """(key, median): the exact median of every key, without a buffer of a key's values.

    Values are counted per bucket between the key's extremes; the running counts tell the bucket
    that holds the middle, and only its values are put in order.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    counted = values.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    ends = counted.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")).withColumnRenamed("key", "key_")
    share = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    placed = counted.join(ends, F.col("key").eqNullSafe(F.col("key_"))).withColumn("bucket", F.floor(share * buckets)).drop("key_", "lo", "hi")
    by_bucket = W.partitionBy("key").orderBy("bucket")
    totals = placed.groupBy("key", "bucket", "total").agg(F.sum("n").alias("here"))
    totals = totals.withColumn("before", F.sum("here").over(by_bucket) - F.col("here"))
    # places of the middle values, counted from 0
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = totals.filter((F.col("before") <= high) & (F.col("before") + F.col("here") > low)).select(
        F.col("key").alias("key_"), F.col("bucket").alias("bucket_"), "before")
    inside = placed.join(middle, F.col("key").eqNullSafe(F.col("key_")) & (F.col("bucket") == F.col("bucket_")))
    by_value = W.partitionBy("key", "bucket").orderBy("value")
    ranked = inside.withColumn("first", F.col("before") + F.sum("n").over(by_value) - F.col("n"))
    held = lambda place: F.max(F.when((F.col("first") <= place) & (F.col("first") + F.col("n") > place), F.col("value")))
    return ranked.groupBy("key").agg(((held(low) + held(high)) / 2).alias("median")).withColumnRenamed("key", key)


def model_summary(rows: DataFrame) -> DataFrame:
    """Per model: metric means, withheld, complete and failed answers, latency."""
    def count(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0)).cast("bigint")

    middle = medians(rows, "model", "seconds")
    found = rows.groupBy("model").agg(
        *[F.round(F.avg(c), 3).alias(c) for c in ("context_relevance", "groundedness", "answer_relevance")],
        count(F.col("withheld").isNotNull()).alias("withheld_answers"),
        count((F.col("missing") == 0) & F.col("error").isNull()).alias("complete"),
        count(F.col("error").isNotNull()).alias("errors"),
        F.round(F.max("seconds"), 2).alias("max_seconds"))
    found = found.join(middle.withColumnRenamed("model", "model__"), F.col("model").eqNullSafe(F.col("model__")), "left")
    return found.withColumn("median_seconds", F.round("median", 2)).drop("model__", "median")


def recommend(summary: DataFrame, gate: float, questions: int, fallback: str = "offline") -> DataFrame:
    """The live model to use: at or above the gate, best grounded, then fewest withheld
    answers, then most relevant; otherwise the fallback with the reason."""
    live = summary.filter((F.col("model") != fallback) & (F.col("errors") < questions))
    passing = live.filter(F.col("groundedness") >= gate)
    best = passing.agg(F.max_by("model", F.struct("groundedness", -F.col("withheld_answers"), "answer_relevance", "model")).alias("best"))
    reached = live.agg(F.count(F.lit(1)).alias("n")).scalar()
    return best.select(
        F.coalesce("best", F.lit(fallback)).alias("model"),
        F.when(F.col("best").isNotNull(), None).when(reached > 0, f"no live model reached groundedness {gate}")
        .otherwise("no live model was reachable").alias("note"))


def identical_rate(rows: DataFrame, response: str = "response") -> DataFrame:
    """Share of questions on which every model gave the same response."""
    per = rows.groupBy("query_id").agg(F.countDistinct(response).alias("n"), F.count(F.lit(1)).alias("models"))
    several = per.filter("models > 1")
    return several.agg(F.count(F.lit(1)).alias("questions"),
                       F.round(F.coalesce(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("identical_rate"))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(metrics), "metric", "value")


def quality_gate(metrics: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """One row per threshold with its verdict and the verdict of all together."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "metric string, minimum double")
    rows = wanted.join(metrics.groupBy("metric").agg(F.max("value").alias("value")), "metric", "left").withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))
    return rows.withColumn("gate_passed", rows.agg(F.bool_and("passed").alias("p")).scalar())


def case_summary(results: DataFrame) -> DataFrame:
    """Pass counts per case category and whether the category can fail the gate."""
    failing = F.col("gate") & ~F.col("passed")
    return results.groupBy("category").agg(
        F.sum(F.col("passed").cast("int")).cast("bigint").alias("passed"), F.count(F.lit(1)).alias("total"),
        F.max("gate").alias("gating"), F.sum(failing.cast("int")).cast("bigint").alias("gate_failures"))


def check_cases(results: DataFrame, cases: DataFrame, declined_prefix: str) -> DataFrame:
    """(case_id, category, gate, passed, detail). ``cases`` holds the expectations
    (keywords, refuse, handover, lookup, refuse_or_ask); unset ones are not checked."""
    rows = cases.join(results, "case_id", "left")
    answer = F.coalesce("answer", F.lit(""))
    absent = F.filter(F.coalesce("keywords", x.word_set(())), lambda k: ~F.contains(F.lower(answer), F.lower(k)))
    asks = F.contains(F.substring_index(answer, "Source:", 1), F.lit("?"))
    problems = F.array_compact(F.concat(
        F.transform(absent, lambda k: F.concat(F.lit("missing "), k)),
        F.array(
            F.when(F.coalesce("refuse", F.lit(False)) & (F.size(F.coalesce("sources", x.word_set(()))) > 0), "answered instead of declining"),
            F.when(F.col("handover").isNotNull() & (F.coalesce("opened", F.lit(False)) != F.col("handover")), "handover differs"),
            F.when(F.col("lookup").isNotNull() & ~F.array_contains(F.coalesce("lookups", x.word_set(())), F.col("lookup")), "lookup missing"),
            F.when(F.coalesce("refuse_or_ask", F.lit(False)) & ~(answer.startswith(declined_prefix) | asks), "neither asked nor declined"))))
    return rows.select("case_id", "category", "gate", (F.size(problems) == 0).alias("passed"),
                       F.when(F.size(problems) == 0, "ok").otherwise(F.array_join(problems, "; ")).alias("detail"))


def weakest_metric(df: DataFrame, ident: str, metrics: Sequence[str]) -> DataFrame:
    order = {m: i for i, m in enumerate(metrics)}
    table = F.create_map(*[F.lit(p) for pair in order.items() for p in pair])
    long = unpivot_metrics(df, [ident], metrics).filter(F.col("value").isNotNull())
    return long.groupBy(ident).agg(F.min_by(F.struct("metric", "value"), F.struct("value", table[F.col("metric")])).alias("w")).select(
        ident, F.col("w.metric").alias("weakest"), F.col("w.value").alias("value"))


def metric_deltas(new: DataFrame, old: DataFrame, metrics: Sequence[str], ident: str = "model") -> DataFrame:
    """Change of every metric against a superseded baseline."""
    after = unpivot_metrics(new, [ident], metrics).withColumnRenamed("value", "new")
    before = unpivot_metrics(old, [ident], metrics).withColumnRenamed("value", "old")
    return after.join(before, [ident, "metric"], "left").withColumn("delta", F.round(F.col("new") - F.col("old"), 3))


def core_text(answer: Column, prefix: str, offers: Sequence[str]) -> Column:
    """An answer without its empathy opening and its offer of a person."""
    body = F.when(answer.startswith(prefix), answer.substr(len(prefix) + 1, 1 << 30)).otherwise(answer)
    kept = F.filter(F.split(body, "\n\n"), lambda p: ~x.strip(p).isin(*offers))
    return x.strip(F.array_join(kept, "\n\n"))


def fairness_pairs(answers: DataFrame, plain: str, prefix: str, offers: Sequence[str]) -> DataFrame:
    """Every variant against the ``plain`` variant of its pair: same content, same sources."""
    rows = answers.select("pair_id", "variant", core_text(F.col("answer"), prefix, offers).alias("core"),
                          F.array_sort("sources").alias("cited"))
    base = rows.filter(F.col("variant") == plain).select("pair_id", F.col("core").alias("base_core"), F.col("cited").alias("base_cited"))
    return rows.filter(F.col("variant") != plain).join(base, "pair_id").select(
        "pair_id", "variant", F.col("core").eqNullSafe(F.col("base_core")).alias("same_answer"),
        F.col("cited").eqNullSafe(F.col("base_cited")).alias("same_sources"))
