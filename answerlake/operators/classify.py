"""Message classification: split, features, training, scoring, reports and probes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions import text as x
from answerlake.session import settle, small_side
from answerlake.sources.fingerprint import corpus_fingerprint

# Decision threshold, ceilings of tone-free messages, probe limit.
THRESHOLD, SHORT_CEILING, QUESTION_CEILING, PROBE_LIMIT = 0.5, 0.3, 0.45, 0.15
PLAIN_OPENERS = ("how", "what", "which", "when", "where", "who", "can", "could", "may", "do", "does", "is", "are",
                 "will", "would", "should")
COMPLAINT_WORDS = (
    "still", "never", "nobody", r"no\s+one", "useless", "ridiculous", "terrible", "awful", "horrible", "worst",
    "unacceptable", "angry", "furious", r"annoy\w*", r"frustrat\w*", r"disappoint\w*", "upset", r"fed\s+up", "again",
    "waiting", "waited", "wait", "ages", "forever", "seriously", "joke", "scam", "rubbish", "nonsense", "stupid",
    "hopeless", r"disgust\w*", r"complain\w*", "lost", "missing", "damaged", "broken", "stolen", "cancell?ed", "rude",
    r"ignor\w*", r"refus\w*", r"not\s+(?:arrived|received|working|helpful|happy)", "hasn'?t", "haven'?t", "didn'?t",
    "won'?t", "can'?t",
)
HASH_BITS = 16


def stratified_split(df: DataFrame, ident: str, label: str, test_share: float = 0.25, seed: str = "42") -> DataFrame:
    """Adds ``part`` (train / test) with exact sizes per label in an order fixed by the seed.

    The cut is found from a histogram of hash prefixes, so only the one bucket per
    label that holds the boundary is ranked; no label's rows ever meet in one task.
    """
    code = F.md5(F.concat_ws("|", F.lit(seed), F.col(ident).cast("string")))
    rows = df.withColumns({"_code": code}).withColumn("_bucket", F.substring("_code", 1, 4))
    counts = rows.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(label).orderBy("_bucket")
    cuts = counts.withColumns({
        "_before": F.sum("_n").over(upto) - F.col("_n"), "_total": F.sum("_n").over(W.partitionBy(label)),
    }).withColumn("_keep", F.col("_total") - F.ceil(F.col("_total") * test_share))
    placed = rows.join(small_side(cuts), [label, "_bucket"])
    edge = (F.col("_before") < F.col("_keep")) & (F.col("_before") + F.col("_n") > F.col("_keep"))
    clear = placed.filter(~edge).withColumn("part", F.when(F.col("_before") < F.col("_keep"), "train").otherwise("test"))
    rank = F.row_number().over(W.partitionBy(label, "_bucket").orderBy("_code", ident))
    ranked = placed.filter(edge).withColumn("part", F.when(rank <= F.col("_keep") - F.col("_before"), "train").otherwise("test"))
    return clear.unionByName(ranked).select(*df.columns, "part")


def message_terms(col: Column) -> Column:
    """Lower-case words of two or more letters or digits, and pairs of neighbours."""
    def pairs(said: Column) -> Column:
        neighbours = F.transform(F.sequence(F.lit(1), F.size(said) - 1), lambda i: F.concat_ws(" ", F.get(said, i - 1), F.get(said, i)))
        return F.concat(said, F.when(F.size(said) > 1, neighbours).otherwise(x.word_set(())))

    return x.let(x.extract_all(F.lower(F.coalesce(col, F.lit(""))), r"[\p{L}\p{N}_]{2,}"), pairs)


def term_dictionary(counted: DataFrame, texts: int | Column) -> DataFrame:
    """(term, id, df, idf) of a table of (text, term): dense ids in the order of the terms.

    Terms are sorted by range where they lie; an id is the number of terms in the partitions
    before, of which there is one row each, and the place in its own.
    """
    seen = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = settle(seen.repartitionByRange("term").sortWithinPartitions("term").withColumn("place", F.monotonically_increasing_id()))
    part, own = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    ids = placed.withColumns({"part": part, "own": own}).join(F.broadcast(before), "part")
    idf = F.log((1 + (F.lit(texts) if isinstance(texts, int) else texts)) / (1 + F.col("df"))) + 1
    return ids.select("term", (F.col("before") + F.col("own")).cast("int").alias("id"), "df", idf.alias("idf"))


def term_cells(counted: DataFrame, dictionary: DataFrame, ident: str) -> DataFrame:
    """(ident, cells): a text's terms by id as (id, term, weight), (1 + ln tf) * idf at unit length."""
    raw = (1 + F.log("tf")) * F.col("idf")
    known = dictionary.select("term", F.col("id").alias("term_id__"), "idf")
    cells = counted.join(known, "term").groupBy(ident).agg(
        F.sort_array(F.collect_list(F.struct(F.col("term_id__").alias("id"), "term", raw.alias("raw")))).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda n, c: n + c["raw"] * c["raw"]))
    return cells.withColumn("norm", norm).select(ident, F.transform("cells", lambda c: F.struct(
        c["id"].alias("id"), c["term"].alias("term"), (c["raw"] / F.col("norm")).alias("weight"))).alias("cells"))


def tf_idf(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), unit length per text."""
    counted = settle(df.select(ident, F.inline(x.term_counts(message_terms(F.col(text))))))
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    seen = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumns(
        {"id": F.lit(0), "idf": F.log((1 + n) / (1 + F.col("df"))) + 1})
    return term_cells(counted, seen, ident).select(ident, F.explode("cells").alias("cell")).select(ident, "cell.term", "cell.weight")


@dataclass
class ToneModel:
    """A trained classifier: a row per bucket of the hashed terms with its idf and coefficient
    (at most 2 ** HASH_BITS rows), the scaled style coefficients and the intercept."""

    terms: DataFrame                      # bucket, idf, coefficient
    style: list[tuple[str, float, float, float]]   # name, mean, deviation, coefficient
    intercept: float
    positive: str
    negative: str
    fingerprint: str = ""


def _buckets(col: Column) -> Column:
    """The bucket of each of a text's terms."""
    return F.transform(message_terms(col), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << HASH_BITS)).cast("int"))


def _cells(buckets: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, tf) of a batch of bucket lists, by row and bucket."""
    sizes = pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    said = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    code, tf = np.unique((np.repeat(np.arange(len(sizes)), sizes) << HASH_BITS) + said, return_counts=True)
    return code >> HASH_BITS, code & ((1 << HASH_BITS) - 1), tf


def _weights(buckets: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): (1 + ln tf) * idf at unit length; buckets without an idf are left out."""
    row, bucket, tf = _cells(buckets)
    known = idf[bucket] > 0
    row, bucket, raw = row[known], bucket[known], (1 + np.log(tf[known])) * idf[bucket[known]]
    norm = np.sqrt(np.bincount(row, raw * raw, minlength=len(buckets)))
    return row, bucket, raw / norm[row]


def _texts_per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << HASH_BITS, dtype=np.int64)
    for batch in batches:
        seen += np.bincount(_cells(batch.column("buckets"))[1], minlength=1 << HASH_BITS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(seen[at], pa.int64())})


def train(df: DataFrame, ident: str, text: str, label: str, positive: str, negative: str, c: float = 1.0,
          iterations: int = 2000) -> ToneModel:
    """Class-balanced L2 logistic regression on hashed tf-idf and standardised style.

    Texts are read once, for their buckets and style. What reaches the driver has the fixed
    width of the hash space, whatever the table holds.
    """
    style = x.style_features(F.col(text))
    rows = settle(df.select(F.col(label).alias("label"), _buckets(F.col(text)).alias("buckets"), *[col.alias(name) for name, col in style.items()]))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == positive).cast("int")).alias("pos"),
                    *[f(name).alias(f"{p}_{name}") for name in style for p, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    n, pos = sums["n"], sums["pos"] or 0
    counted = rows.select("buckets").mapInArrow(_texts_per_bucket, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = counted["bucket"].to_numpy()
    idf = np.zeros(1 << HASH_BITS)
    idf[seen] = np.log((1 + n) / (1 + counted["n"].to_numpy())) + 1
    scaled = [((F.col(name) - F.lit(sums[f"m_{name}"])) / F.lit(sums[f"d_{name}"] or 1.0)) for name in style]
    width = len(scaled)
    size = (1 << HASH_BITS) + width
    vector = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("w", T.DoubleType()), T.StructField("features", VectorUDT())])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, weight = _weights(batch.column("buckets"), idf)
            tone = batch.column("tone").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            at = np.repeat(ends, width)                     # style follows a row's buckets
            index = np.insert(bucket, at, np.tile(np.arange(1 << HASH_BITS, size), batch.num_rows))
            value = np.insert(weight, at, tone.ravel())
            offsets = pa.array(np.concatenate([[0], ends + width * np.arange(1, batch.num_rows + 1)]), pa.int32())
            features = pa.StructArray.from_arrays(
                [pa.array(np.zeros(batch.num_rows), pa.int8()), pa.array(np.full(batch.num_rows, size), pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(index, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value, pa.float64()))],
                ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("w"), features], ["y", "w", "features"])

    weight = F.when(F.col("label") == positive, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(n - pos, 1)))
    ready = rows.select((F.col("label") == positive).cast("double").alias("y"), weight.alias("w"), "buckets", F.array(*scaled).alias("tone")).mapInArrow(
        vectors, vector)
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0,
                               standardization=False, maxIter=iterations, tol=1e-6).fit(ready)
    weights = model.coefficients.toArray()  # fixed width: the hash space and the style features
    cells = [(str(int(b)), float(idf[b]), float(weights[b])) for b in seen]
    table = df.sparkSession.createDataFrame(cells, "bucket string, idf double, coefficient double")
    tone = [(name, sums[f"m_{name}"], sums[f"d_{name}"] or 1.0, float(weights[(1 << HASH_BITS) + i])) for i, name in enumerate(style)]
    return ToneModel(settle(table), tone, float(model.intercept), positive, negative)


# Capitals that are not shouting.
QUIET_CODES = ("USD", "KES")


def ceiling(col: Column) -> Column:
    """The most a message without visible emotion may score, or NULL: very short replies
    and single plain questions."""
    text = F.coalesce(col, F.lit(""))
    words = x.extract_all(text, "[A-Za-z0-9']+")
    shouts = F.exists(words, lambda w: w.rlike("^[A-Z]{3,}$"))
    short = (F.size(words) < 3) & ~F.contains(text, F.lit("!")) & ~shouts
    said = x.strip(text)
    letters = x.extract_all(said, "[A-Za-z']+")
    plain = (
        said.endswith("?") & (F.regexp_count(said, F.lit(r"\?")) == 1) & ~F.contains(said, F.lit("!"))
        & ~said.substr(F.lit(1), F.length(said) - 1).rlike(r"[.;]\s+\S")
        & ~F.exists(letters, lambda w: w.rlike("^['A-Z]{3,}$") & w.rlike("[A-Z]") & ~w.isin(*QUIET_CODES))
        & said.rlike(r"(?iU)^(?:" + "|".join(PLAIN_OPENERS) + r")\b") & ~said.rlike(x.any_word(COMPLAINT_WORDS)))
    return F.when(short, SHORT_CEILING).when(plain, QUESTION_CEILING)


def _scored(model: ToneModel, df: DataFrame, ident: str, text: str, **more: Column) -> DataFrame:
    """(ident, more, p): the model's raw probability, where the text lies."""
    idf, coefficient = np.zeros((2, 1 << HASH_BITS))
    held = model.terms.toPandas()           # no more rows than the hash space
    at = held["bucket"].astype(int).to_numpy()
    idf[at], coefficient[at] = held["idf"].to_numpy(), held["coefficient"].to_numpy()
    tone = x.style_features(F.col(text))
    style = sum(((tone[name] - F.lit(mean)) / F.lit(dev) * F.lit(coef) for name, mean, dev, coef in model.style), F.lit(model.intercept))
    rows = df.select(ident, *[col.alias(name) for name, col in more.items()], style.alias("style"), _buckets(F.col(text)).alias("buckets"))
    kept = [f for f in rows.schema.fields if f.name != "buckets"]
    names = [f.name for f in kept]

    def lexical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, weight = _weights(batch.column("buckets"), idf)
            part = np.bincount(row, weight * coefficient[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in names], pa.array(part, pa.float64())], [*names, "lexical"])

    out = rows.mapInArrow(lexical, T.StructType([*kept, T.StructField("lexical", T.DoubleType())]))
    return out.select(ident, *more, (1 / (1 + F.exp(-(F.col("style") + F.col("lexical"))))).alias("p"))


def probability(model: ToneModel, df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, p): the model's raw probability."""
    return _scored(model, df, ident, text)


def classify(model: ToneModel, df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, score, label, confidence), with the ceilings applied, 3 decimals."""
    rows = _scored(model, df, ident, text, top=ceiling(F.col(text)))
    score = F.least(F.col("p"), F.coalesce("top", F.lit(1.0)))
    return rows.withColumn("raw", score).select(
        ident, F.round("raw", 3).alias("score"), F.when(F.col("raw") >= THRESHOLD, model.positive).otherwise(model.negative).alias("label"),
        F.round(F.greatest(F.col("raw"), 1 - F.col("raw")), 3).alias("confidence"))


def save_model(model: ToneModel, path: str) -> None:
    """Terms as parquet, the few fixed numbers as one JSON row."""
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark = model.terms.sparkSession
    row = (json.dumps(model.style), model.intercept, model.positive, model.negative, model.fingerprint)
    spark.createDataFrame([row], "style string, intercept double, positive string, negative string, fingerprint string").write.mode(
        "overwrite").json(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> ToneModel | None:
    """The stored model, or None when there is none yet."""
    try:
        row = spark.read.schema("style string, intercept double, positive string, negative string, fingerprint string").json(
            f"{path}/model").first()
        terms = spark.read.parquet(f"{path}/terms")
    except AnalysisException:
        return None
    if row is None:
        return None
    return ToneModel(terms, [tuple(s) for s in json.loads(row["style"])], row["intercept"], row["positive"], row["negative"], row["fingerprint"])


def train_if_changed(df: DataFrame, path: str, ident: str, text: str, label: str, positive: str, negative: str,
                     **settings) -> tuple[ToneModel, bool]:
    """(model, trained): the stored model while the labelled texts and settings it was
    trained on are the same, otherwise a new one that replaces it."""
    marked = df.select(F.col(ident).alias("doc_id"), F.concat_ws("|", F.col(label), F.col(text)).alias("text"))
    mark = corpus_fingerprint(marked, {"bits": HASH_BITS, "positive": positive, **settings}).first()["fingerprint"]
    stored = load_model(df.sparkSession, path)
    if stored is not None and stored.fingerprint == mark:
        return stored, False
    model = train(df, ident, text, label, positive, negative, **settings)
    model.fingerprint = mark
    save_model(model, path)
    return model, True


# ---------------------------------------------------------------------- reports

def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Per class: precision, recall, F1, support and the errors in both directions.
    One count per (label, predicted) pair feeds every figure."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "class string")
    cells = confusion(df, label, predicted)
    per = names.join(cells, (F.col("class") == F.col("label")) | (F.col("class") == F.col("predicted")), "left").groupBy("class").agg(
        *[F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for name, test in (
            ("hits", (F.col("label") == F.col("class")) & (F.col("predicted") == F.col("class"))),
            ("support", F.col("label") == F.col("class")), ("claimed", F.col("predicted") == F.col("class")))])

    def share(of: str) -> Column:
        return F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0)

    both = F.col("support") + F.col("claimed")
    return per.select(
        "class", F.round(share("claimed"), 4).alias("precision"), F.round(share("support"), 4).alias("recall"),
        F.round(F.when(both > 0, 2 * F.col("hits") / both).otherwise(0.0), 4).alias("f1_score"), "support",
        (F.col("support") - F.col("hits")).alias("missed"), (F.col("claimed") - F.col("hits")).alias("wrongly_claimed"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(label) == F.col(predicted)).cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("size"))


def accuracy_by(df: DataFrame, label: str, predicted: str, part: str, default: str = "en") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(part), F.lit("")), F.lit(default)).alias(part)).agg(
        F.round(F.avg((F.col(label) == F.col(predicted)).cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def evaluate_classifier(test: DataFrame, challenge: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy on the held-out part, on the challenge set, and their gap."""
    other = accuracy(challenge, label, predicted)
    return accuracy(test, label, predicted).withColumnsRenamed({"accuracy": "held_out", "size": "test_size"}).withColumns({
        "challenge": other.select("accuracy").scalar(), "challenge_size": other.select("size").scalar(),
    }).withColumn("generalisation_gap", F.round(F.col("held_out") - F.col("challenge"), 4))


def top_mistakes(df: DataFrame, label: str, predicted: str, p: str, ident: str, n: int = 8) -> DataFrame:
    """The n wrong rows the model was surest about."""
    wrong = df.filter(F.col(label) != F.col(predicted)).withColumn("sure", F.round(F.abs(F.col(p) - 0.5), 6))
    return wrong.orderBy(F.desc("sure"), ident).limit(n)


def surface_features(df: DataFrame, text: str, label: str, first: str, second: str) -> DataFrame:
    """Share of each class with a surface feature; a feature only one class has separates
    the classes perfectly and is flagged."""
    said = F.col(text)
    tests = {
        "ends with ?": x.strip(said).endswith("?"), "contains ?": F.contains(said, F.lit("?")),
        "contains !": F.contains(said, F.lit("!")), "contains a comma": F.contains(said, F.lit(",")),
        "starts with I": said.startswith("I "),
        "has a capitals word": F.exists(F.split(said, r"\s+"), lambda w: (F.length(w) > 2) & (w == F.upper(w)) & (w != F.lower(w))),
    }
    wide = df.groupBy(F.col(label).cast("string").alias("class")).agg(*[F.avg(t.cast("int")).alias(n) for n, t in tests.items()])
    long = wide.unpivot("class", list(tests), "feature", "share")
    out = long.groupBy("feature").agg(
        F.round(F.coalesce(F.max(F.when(F.col("class") == first, F.col("share"))), F.lit(0.0)), 4).alias("first_share"),
        F.round(F.coalesce(F.max(F.when(F.col("class") == second, F.col("share"))), F.lit(0.0)), 4).alias("second_share"))
    return out.withColumn("separating", (F.col("first_share") == 0) != (F.col("second_share") == 0))


# ----------------------------------------------------------------------- probes

def perturbation_probe(model: ToneModel, df: DataFrame, ident: str, text: str, change: Callable[[Column], Column]) -> DataFrame:
    """One row: how much a change that carries no tone moves the score."""
    both = df.select(F.col(ident).cast("string").alias("probe"), F.col(text).alias("text"))
    scored = classify(model, both.select(F.concat(F.lit("a"), "probe").alias("probe"), "text").unionByName(
        both.select(F.concat(F.lit("b"), "probe").alias("probe"), change(F.col("text")).alias("text"))), "probe", "text")
    pair = scored.groupBy(F.expr("substring(probe, 2)").alias("pair")).agg(
        *[F.max(F.when(F.substring("probe", 1, 1) == side, F.col(c))).alias(f"{c}_{side}") for side in "ab" for c in ("score", "label")])
    delta = F.avg(F.col("score_b") - F.col("score_a"))
    return pair.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(delta, 3).alias("mean_delta"),
        F.sum((F.col("label_a") != F.col("label_b")).cast("int")).cast("bigint").alias("flipped"),
        ((F.abs(delta) <= PROBE_LIMIT) & (F.sum((F.col("label_a") != F.col("label_b")).cast("int")) == 0)).alias("passed"))


def undisputed(df: DataFrame, ident: str, text: str, label: str, votes: int = 2) -> DataFrame:
    """Cases nobody would dispute: texts, compared without case and spacing, that were labelled
    at least ``votes`` times and always alike. One row (ident, text, expected) each."""
    said = x.norm_key(F.col(text))
    groups = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).groupBy(said.alias("said")).agg(
        F.min_by(F.col(text), F.col(ident)).alias(text), F.min(ident).alias(ident), F.count(F.lit(1)).alias("n"),
        F.min(label).alias("expected"), F.max(label).alias("other"))
    return groups.filter((F.col("n") >= votes) & (F.col("expected") == F.col("other"))).select(ident, text, "expected")


def expected_labels(model: ToneModel, cases: DataFrame, ident: str, text: str, expected: str) -> DataFrame:
    """Cases nobody would dispute: expected and given label side by side."""
    return classify(model, cases, ident, text).join(cases.select(ident, F.col(expected).alias("expected")), ident).withColumn(
        "right", F.col("label") == F.col("expected"))
