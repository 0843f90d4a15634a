"""Classifier queries on documents and their labels."""

from pyspark.sql import functions as F

from answerlake.catalog.registry import query
from answerlake.functions import text as x
from answerlake.operators import classify
from answerlake.session import settle

LABELLED = """labelled AS (SELECT doc_id, text, lang, n_chars, CASE quality WHEN 1 THEN 'calm' ELSE 'upset' END AS label,
  CASE WHEN n_chars % 3 = 0 THEN 'upset' ELSE 'calm' END AS predicted, (n_chars % 100) / 100.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"""


def labelled(t):
    return t.texts.join(t.labels, "doc_id").select(
        "doc_id", "text", "lang", "n_chars", F.when(F.col("quality") == 1, "calm").otherwise("upset").alias("label"),
        F.when(F.col("n_chars") % 3 == 0, "upset").otherwise("calm").alias("predicted"), (F.col("n_chars") % 100 / F.lit(100.0)).alias("p"))


@query("stratified_split", "C1", f"""WITH {LABELLED} SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id)
  <= count(*) OVER (PARTITION BY label) - ceil(count(*) OVER (PARTITION BY label) * 0.25) THEN 'train' ELSE 'test' END AS part FROM labelled""")
def _(t):
    return classify.stratified_split(labelled(t).select("doc_id", "label"), "doc_id", "label")


@query("tf_idf_weights", "C2", """WITH w AS (SELECT conv_id * 100000 + turn AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS s FROM conversations),
g AS (SELECT id, unnest(list_concat(s, list_transform(range(1, length(s)), lambda i: s[i] || ' ' || s[i + 1]))) AS term FROM w),
c AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS raw FROM c JOIN d USING (term))
SELECT id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)), 5) AS weight FROM r""")
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return classify.tf_idf(rows, "id", "text").withColumn("weight", F.round("weight", 5))


@query("classification_report", "A8", f"""WITH {LABELLED}, s AS (SELECT class, count(*) FILTER (WHERE label = class AND predicted = class) AS hits,
  count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE predicted = class) AS claimed FROM labelled, (SELECT unnest(['calm', 'upset', 'angry']) AS class) GROUP BY 1)
SELECT class, round(CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END, 4) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0.0 END, 4) AS recall,
  round(CASE WHEN support + claimed > 0 THEN 2 * hits / (support + claimed) ELSE 0.0 END, 4) AS f1_score, support, support - hits AS missed, claimed - hits AS wrongly_claimed FROM s""")
def _(t):
    return classify.classification_report(labelled(t), "label", "predicted", ("calm", "upset", "angry"))


@query("confusion_matrix", "A8", f"WITH {LABELLED} SELECT label, predicted, count(*) AS n FROM labelled GROUP BY 1, 2")
def _(t):
    return classify.confusion(labelled(t), "label", "predicted")


@query("accuracy_by_language", "A9", f"""WITH {LABELLED} SELECT lang, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS n FROM labelled GROUP BY 1""")
def _(t):
    return classify.accuracy_by(labelled(t), "label", "predicted", "lang")


@query("surface_features", "A10", f"""WITH {LABELLED}, f AS (SELECT label, unnest(['ends with ?', 'contains ?', 'contains !', 'contains a comma', 'starts with I', 'has a capitals word']) AS feature,
  unnest([ends_with(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '?'), contains(text, '?'), contains(text, '!'), contains(text, ','), starts_with(text, 'I '),
    length(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 2 AND w = upper(w) AND w <> lower(w))) > 0]) AS has FROM labelled),
s AS (SELECT feature, round(avg(CASE WHEN label = 'calm' THEN CASE WHEN has THEN 1.0 ELSE 0.0 END END), 4) AS first_share,
  round(avg(CASE WHEN label = 'upset' THEN CASE WHEN has THEN 1.0 ELSE 0.0 END END), 4) AS second_share FROM f GROUP BY 1)
SELECT *, (first_share = 0) <> (second_share = 0) AS separating FROM s""")
def _(t):
    return classify.surface_features(labelled(t), "text", "label", "calm", "upset")


@query("confident_mistakes", "W8", f"""WITH {LABELLED} SELECT doc_id, label, predicted, p, round(abs(p - 0.5), 6) AS sure FROM labelled WHERE label <> predicted
ORDER BY sure DESC, doc_id LIMIT 8""")
def _(t):
    rows = labelled(t).select("doc_id", "label", "predicted", "p")
    return classify.top_mistakes(rows, "label", "predicted", "p", "doc_id")


@query("classifier_gap", "C5", f"""WITH {LABELLED}, a AS (SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 4) AS held_out, count(*) AS test_size FROM labelled WHERE lang = 'en'),
b AS (SELECT round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 4) AS challenge, count(*) AS challenge_size FROM labelled WHERE lang <> 'en')
SELECT *, round(held_out - challenge, 4) AS generalisation_gap FROM a, b""")
def _(t):
    rows = labelled(t)
    return classify.evaluate_classifier(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"), "label", "predicted")


CAPITALS = "^['A-Z]*[A-Z]['A-Z]*$".replace("'", "''")


@query("score_ceilings", "C4", """WITH l AS (SELECT conv_id, turn, unnest(lines) AS said, unnest(range(1, length(lines) + 1)) - 1 AS place FROM (SELECT conv_id, turn, string_split(text, '.') AS lines FROM conversations)),
s AS (SELECT conv_id, turn, place, CASE (turn + place) % 3 WHEN 0 THEN said WHEN 1 THEN 'What ' || replace(trim(said, ' ' || chr(10)), chr(10), ' ') || '?' ELSE 'Is ' || said || ' still?' END AS x FROM l),
w AS (SELECT *, regexp_extract_all(x, '[A-Za-z0-9'']+') AS ws, trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) AS y FROM s)
SELECT conv_id, turn, place, CAST(CASE WHEN length(ws) < 3 AND NOT contains(x, '!') AND length(list_filter(ws, lambda v: regexp_full_match(v, '[A-Z]{3,}'))) = 0 THEN 0.3
  WHEN ends_with(y, '?') AND length(y) - length(replace(y, '?', '')) = 1 AND NOT contains(y, '!') AND NOT regexp_matches(left(y, length(y) - 1), '[.;]\\s+\\S')
   AND length(list_filter(regexp_extract_all(y, '[A-Za-z'']+'), lambda v: v NOT IN ('USD', 'KES') AND length(v) >= 3 AND regexp_matches(v, '""" + CAPITALS + """'))) = 0
   AND regexp_matches(y, '(?i)^(""" + "|".join(classify.PLAIN_OPENERS) + """)($|[^\\p{L}\\p{N}_])')
   AND NOT regexp_matches(y, '(?i)(^|[^\\p{L}\\p{N}_])(""" + "|".join(classify.COMPLAINT_WORDS).replace("'", "''").replace("\\w*", "[\\p{L}\\p{N}_]*") + """)($|[^\\p{L}\\p{N}_])')
  THEN 0.45 END AS DOUBLE) AS ceiling FROM w""")
def _(t):
    lines = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("place", "said"))
    kind = (F.col("turn") + F.col("place")) % 3
    said = F.when(kind == 0, F.col("said")).when(kind == 1, F.concat(
        F.lit("What "), F.replace(x.strip(F.col("said"), " \n"), F.lit("\n"), F.lit(" ")), F.lit("?"))).otherwise(
        F.concat(F.lit("Is "), F.col("said"), F.lit(" still?")))
    return lines.select("conv_id", "turn", F.col("place").cast("bigint").alias("place"), classify.ceiling(said).cast("double").alias("ceiling"))


def trained(t):
    parts = settle(classify.stratified_split(labelled(t).select("doc_id", "text", "label"), "doc_id", "label"))
    return classify.train(parts.filter("part = 'train'"), "doc_id", "text", "label", "upset", "calm", iterations=50), parts


@query("trained_scores", "C2 C3 C4")
def _(t):
    model, _ = trained(t)
    return classify.classify(model, t.conversations.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text"), "id", "text")


@query("held_out_report", "C3 C5 A8")
def _(t):
    model, parts = trained(t)
    test = parts.filter("part = 'test'")
    given = classify.classify(model, test, "doc_id", "text").withColumnRenamed("label", "predicted")
    return classify.classification_report(test.join(given, "doc_id"), "label", "predicted", ("calm", "upset"))


@query("punctuation_probe", "C7")
def _(t):
    model, parts = trained(t)
    return classify.perturbation_probe(model, parts, "doc_id", "text", lambda c: F.concat(x.strip(c), F.lit("?")))


UNDISPUTED = f"""WITH {LABELLED}, k AS (SELECT *, regexp_replace(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), '\\s+', ' ', 'g') AS said FROM labelled)
SELECT min(doc_id) AS doc_id, arg_min(text, doc_id) AS text, min(label) AS expected FROM k GROUP BY said HAVING count(*) >= 2 AND min(label) = max(label)"""


@query("undisputed_cases", "C8", UNDISPUTED)
def _(t):
    return classify.undisputed(labelled(t), "doc_id", "text", "label")


@query("expected_labels", "C8")
def _(t):
    model, parts = trained(t)
    cases = classify.undisputed(parts, "doc_id", "text", "label")
    return classify.expected_labels(model, cases, "doc_id", "text", "expected").select("doc_id", "label", "expected", "right")


@query("term_dictionary", "C2", """WITH w AS (SELECT conv_id * 100000 + turn AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS s FROM conversations),
g AS (SELECT DISTINCT id, unnest(list_concat(s, list_transform(range(1, length(s)), lambda i: s[i] || ' ' || s[i + 1]))) AS term FROM w),
d AS (SELECT term, count(*) AS df FROM g GROUP BY 1)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS id, df, round(ln((1.0 + (SELECT count(*) FROM w)) / (1 + df)) + 1, 6) AS idf FROM d""")
def _(t):
    rows = t.conversations.select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    counted = rows.select("id", F.inline(x.term_counts(classify.message_terms(F.col("text")))))
    n = t.conversations.agg(F.count(F.lit(1)).alias("n")).scalar()
    return classify.term_dictionary(counted, n).withColumn("idf", F.round("idf", 6))


@query("gated_training", "C6 S14")
def _(t):
    from answerlake.catalog.feeds import scratch
    path = scratch(t, "tone")
    rows = settle(labelled(t).select("doc_id", "text", "label"))
    first, trained_once = classify.train_if_changed(rows, path, "doc_id", "text", "label", "upset", "calm", iterations=10)
    again, trained_twice = classify.train_if_changed(rows, path, "doc_id", "text", "label", "upset", "calm", iterations=10)
    given = classify.classify(first, rows, "doc_id", "text").select("doc_id", F.col("score").alias("trained_score"))
    return given.join(classify.classify(again, rows, "doc_id", "text"), "doc_id").select(
        "doc_id", "trained_score", "score", F.lit(trained_once).alias("first_trained"), F.lit(trained_twice).alias("second_trained"))
