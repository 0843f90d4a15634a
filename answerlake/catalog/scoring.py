"""Answer composition, quality metrics, runs and gates."""

from pyspark.sql import functions as F

from answerlake.catalog import bindings as b
from answerlake.catalog import search as s
from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.catalog.sqlparts import CORPUS
from answerlake.catalog.texts import sql_asks, sql_parts
from answerlake.functions import text as x
from answerlake.operators import lanes
from answerlake.plans import quality, retrieval
from answerlake.session import settle, spread

SEARCH = f"{s.SEARCH}, {s.mmr_sql()}, hx AS (SELECT h.*, c.source, c.section, c.text, c.search_text FROM hits h JOIN chunks c USING (chunk_id))"

# The benchmark passages asked as two-part messages.
MESSAGE = "(SELECT item_id AS query_id, text || ' What of the ' || right(text, 40) || ' and how the ' || left(text, 30) || '?' AS text FROM benchmark)"


def messages(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(
        "text", F.lit(" What of the "), F.right("text", F.lit(40)), F.lit(" and how the "),
        F.left("text", F.lit(30)), F.lit("?")).alias("text"))


def hits(t, full=True):
    base = s.index(t)
    found = settle(retrieval.search(s.questions(t), base, s.CONFIG))
    return retrieval.with_chunks(found, base) if full else found


ONE_PART = "qp AS (SELECT item_id AS query_id, 0 AS part, text AS question, 1 AS n_parts FROM benchmark)"
PARTS = f"""said AS (SELECT query_id, text, {q.sentences(q.strip('text'))} AS said FROM {MESSAGE}),
sp AS (SELECT *, flatten(list_transform(list_filter(said, lambda z: {sql_asks('z')}), lambda z: {sql_parts('z')})) AS ps,
  array_to_string(list_filter(said, lambda z: NOT {sql_asks('z')}), ' ') AS situation FROM said),
fp AS (SELECT query_id, CASE WHEN length(ps) < 2 THEN [text] ELSE list_transform(ps, lambda p:
  CASE WHEN length({q.topical(q.tokens('p'))}) >= 2 THEN p ELSE {q.strip("(situation || ' ' || p)")} END) END AS parts FROM sp),
qp AS (SELECT query_id, i - 1 AS part, parts[i] AS question, length(parts) AS n_parts FROM (SELECT *, unnest(range(1, length(parts) + 1)) AS i FROM fp))"""

SENTENCES = f"""qt AS (SELECT query_id, part, n_parts, list_distinct(toks) AS base, list_distinct({q.expand('toks')}) AS wanted
  FROM (SELECT *, {q.tokens('question')} AS toks FROM qp)),
hh AS (SELECT *, list_distinct({q.expand('hd')}) AS hf FROM (SELECT *, list_distinct({q.tokens("regexp_replace(section, '(?i)^\\s*section\\s+[0-9]+\\s*:\\s*', '')")}) AS hd FROM hx)),
st AS (SELECT query_id, part, n_parts, rank, chunk_id, score, wanted, length(list_intersect(wanted, hd)) * 1.5
   + length(list_intersect(base, hf)) / greatest(length(base), 1) * 3.0 AS bonus,
   string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS raw FROM hh JOIN qt USING (query_id)),
su AS (SELECT *, trim(regexp_replace(raw[i], '\\s+', ' ', 'g')) AS sentence, i - 1 AS position FROM (SELECT *, unnest(range(1, length(raw) + 1)) AS i FROM st)),
sv AS (SELECT *, length(list_intersect(wanted, {q.tokens('sentence')})) AS overlap FROM su WHERE length(sentence) > 0
   AND NOT (regexp_matches(sentence, '(?i)^Section\\s+[0-9]+\\s*:\\s*[^.]*$') OR (length(string_split(sentence, ' ')) <= 8 AND NOT ends_with(sentence, '.')))),
scs AS (SELECT query_id, part, n_parts, rank, chunk_id, position, sentence, round(overlap + overlap / greatest(length(wanted), 1) * 2.0 + bonus
   + 0.0 + score * 4.0 + greatest(0.0, 1.0 - (rank - 1) * 0.25), 6) AS sentence_score FROM sv WHERE overlap > 0)"""

SELECTED = """s1 AS (SELECT *, row_number() OVER w AS place, first_value(chunk_id) OVER w AS top_chunk, first_value(sentence_score) OVER w AS top_score
  FROM scs WINDOW w AS (PARTITION BY query_id, part ORDER BY sentence_score DESC, rank, position)),
s2 AS (SELECT * FROM s1 WHERE place = 1 OR sentence_score >= CASE WHEN chunk_id = top_chunk THEN 0.7 ELSE 0.92 END * top_score),
s3 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY query_id, part, lower(sentence) ORDER BY place) = 1),
s4 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id, part ORDER BY place) AS place) FROM s3)"""


@query("sentence_scores", "Q1", f"""WITH {SEARCH}, {ONE_PART}, {SENTENCES}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, CAST(position AS INTEGER) AS position, sentence, sentence_score FROM scs""")
def _(t):
    one = s.questions(t).select("query_id", F.lit(0).alias("part"), F.col("text").alias("question"))
    return quality.sentence_scores(one, hits(t), CORPUS).drop("part")


@query("selected_sentences", "Q2", f"""WITH {SEARCH}, {ONE_PART}, {SENTENCES}, {SELECTED}
SELECT query_id, CAST(place AS INTEGER) AS place, chunk_id, sentence, sentence_score FROM s4 WHERE place <= 3""")
def _(t):
    one = s.questions(t).select("query_id", F.lit(0).alias("part"), F.col("text").alias("question"))
    return quality.select_sentences(quality.sentence_scores(one, hits(t), CORPUS)).select(
        "query_id", "place", "chunk_id", "sentence", "sentence_score")


def answers_sql(limit_parts="CASE WHEN n_parts > 1 THEN 2 ELSE 3 END", most=5):
    title = "upper(left(source, 1)) || lower(substr(source, 2))"
    return f"""lab AS (SELECT query_id, rank, chunk_id, text, CASE WHEN length(trim(section)) > 0 AND NOT starts_with(lower(trim(section)), lower({title}))
     THEN {title} || ' - ' || trim(section) WHEN length(trim(section)) > 0 THEN trim(section) ELSE {title} END AS label, source = 'src3' AS made_up FROM hx),
s5 AS (SELECT * FROM s4 WHERE place <= {limit_parts} QUALIFY row_number() OVER (PARTITION BY query_id, lower(sentence) ORDER BY part, place) = 1),
s6 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS step FROM s5),
s7 AS (SELECT query_id, list(sentence ORDER BY step) AS ss, list(label ORDER BY step) AS ls, bool_or(made_up) AS made_up
  FROM s6 JOIN lab USING (query_id, chunk_id) WHERE step <= {most} GROUP BY query_id),
fb AS (SELECT query_id, label, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda z: trim(regexp_replace(z, '\\s+', ' ', 'g'))), lambda z: length(z) > 0 AND NOT (regexp_matches(z, '(?i)^Section\\s+[0-9]+\\s*:\\s*[^.]*$')
    OR (length(string_split(z, ' ')) <= 8 AND NOT ends_with(z, '.')))) AS cand FROM lab WHERE rank = 1),
ans AS (SELECT query_id, coalesce(array_to_string(ss, ' ') || chr(10) || chr(10) || 'Source: ' || array_to_string({q.keep_order('ls')}, '; ')
    || CASE WHEN made_up THEN chr(10) || chr(10) || '{quality.SYNTHETIC_NOTE}' ELSE '' END,
   cand[1] || chr(10) || chr(10) || 'Source: ' || label, CASE WHEN fb.query_id IS NOT NULL THEN '{quality.NO_SENTENCE}' END, '{quality.NOTHING_FOUND}') AS answer
  FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN s7 USING (query_id) LEFT JOIN fb USING (query_id))"""


def answered(t, found, verbose=True):
    return quality.compose(messages(t) if verbose else s.questions(t),
                           found.withColumn("status", F.when(F.col("source") == "src3", "synthetic")), CORPUS, verbose,
                           provenance="status")


@query("composed_answers", "Q3 T9", f"WITH {SEARCH}, {PARTS}, {SENTENCES}, {SELECTED}, {answers_sql()} SELECT query_id, answer FROM ans")
def _(t):
    return answered(t, hits(t))


@query("terse_answers", "Q3", f"WITH {SEARCH}, {ONE_PART}, {SENTENCES}, {SELECTED}, {answers_sql('3', 1)} SELECT query_id, answer FROM ans")
def _(t):
    return answered(t, hits(t), verbose=False)


@query("context_relevance", "Q4", f"""WITH {SEARCH}
SELECT query_id, round(avg(least(greatest(dense_score, 0), 1)), 3) AS context_relevance FROM hits GROUP BY 1""")
def _(t):
    return quality.context_relevance(s.questions(t), hits(t, False))


# Transcript exchanges with figures and denials added, so that every test can fail.
EXCHANGES = """exchanges AS (SELECT u.conv_id * 100000 + u.turn AS query_id, u.text AS text,
  a.text || ' It costs ' || CAST(length(a.text) % 5 AS VARCHAR) || ' coins. ' || CASE length(a.text) % 3 WHEN 0 THEN 'This price is not final.'
    WHEN 1 THEN 'Nine thousand days.' ELSE 'See the price list.' END || chr(10) || 'Source: File 77' AS answer,
  u.text || ' ' || CASE WHEN length(u.text) % 2 = 0 THEN a.text ELSE '' END || ' It costs 2 coins or 9,000. This price is final.' AS context
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def exchanges(t):
    user = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    both = t.conversations.filter("role = 'assistant'").join(user, ["conv_id", "turn"])
    size = F.length("text")
    tail = F.when(size % 3 == 0, "This price is not final.").when(size % 3 == 1, "Nine thousand days.").otherwise("See the price list.")
    return both.select(
        (F.col("conv_id") * 100000 + F.col("turn") - 1).alias("query_id"), F.col("said").alias("text"),
        F.concat("text", F.lit(" It costs "), (size % 5).cast("string"), F.lit(" coins. "), tail, F.lit("\nSource: File 77")).alias("answer"),
        F.concat("said", F.lit(" "), F.when(F.length("said") % 2 == 0, F.col("text")).otherwise(""),
                 F.lit(" It costs 2 coins or 9,000. This price is final.")).alias("context"))


def grounded_sql(source):
    split = "string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""gc AS (SELECT query_id, array_to_string(list_filter(string_split(answer, chr(10)), lambda s: NOT starts_with(lower(trim(s)), 'source:')), chr(10)) AS claims,
   {q.content('context')} AS known, {q.atoms('context')} AS figures,
   list_transform(list_filter({split.format('context')}, lambda s: length({q.strip('s')}) > 0), lambda s: {{'said': {q.content('s')}, 'negated': {q.negated('s')}}}) AS lines
   FROM {source}),
gs AS (SELECT *, unnest({split.format('claims')}) AS sentence FROM gc),
gt AS (SELECT *, {q.atoms('sentence')} AS numbers, {q.content('sentence')} AS said, {q.negated('sentence')} AS neg FROM gs
   WHERE regexp_matches(sentence, '[a-zA-Z0-9'']{{3,}}')),
gu AS (SELECT *, length(list_intersect(said, known)) AS shared, list_reverse_sort(list_transform(lines, lambda c, i: {{'n': length(list_intersect(said, c.said)), 'f': -i, 'g': c.negated}}))[1] AS al
   FROM gt),
gv AS (SELECT query_id, CASE WHEN length(list_filter(numbers, lambda n: NOT list_contains(figures, n))) > 0 THEN 0.0
   WHEN (CASE WHEN length(said) > 0 THEN shared / length(said) ELSE 0 END) < 0.35 AND length(list_intersect(numbers, figures)) = 0 THEN 0.0
   WHEN neg AND al.n > 0 AND NOT al.g THEN 0.0 ELSE 1.0 END AS good FROM gu WHERE length(numbers) > 0 OR shared > 0),
grounded AS (SELECT query_id, coalesce(g, 0) AS groundedness FROM (SELECT query_id FROM {source}) LEFT JOIN (
   SELECT query_id, round(avg(good), 3) AS g FROM gv GROUP BY 1) USING (query_id))"""


@query("groundedness", "Q5 T12 T13 T14 U4", f"WITH {EXCHANGES}, {grounded_sql('exchanges')} SELECT query_id, CAST(groundedness AS DOUBLE) AS groundedness FROM grounded")
def _(t):
    pairs = settle(exchanges(t))
    return quality.groundedness(pairs, pairs)


KEYS = "[left(answer, 12), 'coins', '9000', CAST(length(answer) % 5 AS VARCHAR) || '.0', 'zzz', ' ']"
SQL_MISSING = (f"list_filter(list_filter(list_transform({KEYS}, lambda k: trim(k)), lambda k: length(k) > 0), lambda k: NOT (contains(lower(answer), lower(k)) "
               f"OR (length({q.atoms('k')}) > 0 AND length(list_filter({q.atoms('k')}, lambda n: NOT list_contains(figs, n))) = 0)))")


def keyed(t):
    keys = F.array(F.left("answer", F.lit(12)), F.lit("coins"), F.lit("9000"),
                   F.concat((F.length("answer") % 5).cast("string"), F.lit(".0")), F.lit("zzz"), F.lit(" "))
    return exchanges(t).withColumn("keys", keys)


@query("gold_answer_relevance", "Q6", f"""WITH {EXCHANGES}, a AS (SELECT *, {q.atoms('answer')} AS figs FROM exchanges)
SELECT query_id, round((5 - length({SQL_MISSING})) / 5.0, 3)::DOUBLE AS relevance FROM a""")
def _(t):
    return keyed(t).select("query_id", quality.answer_relevance_gold(F.col("answer"), F.col("keys")).alias("relevance"))


@query("missing_keys", "Q10", f"""WITH {EXCHANGES}, a AS (SELECT *, {q.atoms('answer')} AS figs FROM exchanges)
SELECT query_id, array_to_string({SQL_MISSING}, '|') AS missing FROM a""")
def _(t):
    return keyed(t).select("query_id", F.array_join(quality.missing_keys(F.col("answer"), F.col("keys")), "|").alias("missing"))


def relevance_sql(answer, question):
    return (f"CASE WHEN length({q.content(question)}) = 0 OR length({q.content(answer)}) = 0 THEN 0.0 ELSE round(least(length(list_intersect({q.content(question)}, {q.content(answer)}))"
            f" / length({q.content(question)}), 1.0) * ((length({q.content(answer)}) - length(list_intersect({q.content(question)}, {q.content(answer)}))) / length({q.content(answer)})), 3) END")


@query("answer_relevance", "Q7", f"WITH {EXCHANGES} SELECT query_id, CAST({relevance_sql('answer', 'text')} AS DOUBLE) AS relevance FROM exchanges")
def _(t):
    return exchanges(t).select("query_id", quality.answer_relevance(F.col("answer"), F.col("text")).alias("relevance"))


@query("withheld_answers", "Q9", f"""WITH {EXCHANGES}, a AS (SELECT query_id, answer, {q.atoms('context')} AS figs, {q.atoms(
    "array_to_string(list_filter(string_split(answer, chr(10)), lambda s: NOT starts_with(lower(trim(s)), 'source')), chr(10))")} AS said FROM exchanges),
n AS (SELECT query_id, list_sort(list_filter(said, lambda n: NOT list_contains(figs, n))) AS bad FROM a)
SELECT query_id, CASE WHEN length(bad) > 0 THEN 'states figures not in the context (' || array_to_string(list_transform(bad[1:3],
  lambda d: regexp_replace(CAST(CAST(d AS DECIMAL(30,4)) AS VARCHAR), '\\.?0+$', '')), ', ') || ')' END AS reason FROM n""")
def _(t):
    return exchanges(t).select("query_id", quality.withheld(F.col("answer"), F.col("context")).alias("reason"))


EVALUATED = f"""{SEARCH}, {PARTS}, {SENTENCES}, {SELECTED}, {answers_sql()},
evx AS (SELECT query_id, answer, context FROM ans JOIN (SELECT query_id, string_agg(source || ' ' || section || ' ' || text, ' ' ORDER BY rank) AS context
  FROM hx GROUP BY 1) USING (query_id)), {grounded_sql('evx')},
ev AS (SELECT query_id, round(avg(least(greatest(dense_score, 0), 1)), 3) AS context_relevance, any_value(groundedness)::DOUBLE AS groundedness,
  any_value(rel)::DOUBLE AS answer_relevance FROM hits JOIN grounded USING (query_id) JOIN (
  SELECT query_id, {relevance_sql('answer', 'm.text')} AS rel FROM ans JOIN {MESSAGE} m USING (query_id)) USING (query_id) GROUP BY 1)"""


@query("evaluated_answers", "Q8", f"WITH {EVALUATED} SELECT query_id, context_relevance, groundedness, answer_relevance FROM ev")
def _(t):
    found = settle(hits(t))
    return quality.evaluate(messages(t), settle(answered(t, found)), found)


# A question's gold documents hold all its words in a row.
GOLD = """gold AS (SELECT DISTINCT item_id AS query_id, doc_id FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark) b JOIN documents d
  ON contains(' ' || array_to_string(regexp_extract_all(d.text, '\\S+'), ' ') || ' ', ' ' || array_to_string(w, ' ') || ' ') WHERE length(w) > 0)"""


def gold(t):
    from answerlake.operators.audit import containing_documents
    return containing_documents(t.benchmark, "item_id", t.texts, "doc_id", 6).select(
        F.col("item_id").alias("query_id"), "doc_id")


RECALL = """rc AS (SELECT g.query_id, count(*) AS gold, count(h.doc_id) AS found FROM (SELECT DISTINCT query_id, doc_id FROM gold) g
  LEFT JOIN (SELECT DISTINCT query_id, doc_id FROM hits) h ON h.query_id = g.query_id AND h.doc_id = g.doc_id GROUP BY 1)"""


@query("recall_at_k", "A12 U3", f"""WITH {SEARCH}, {GOLD}, {RECALL}
SELECT count(*) AS questions, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 4) AS any_hit,
  round(avg(CASE WHEN found = gold THEN 1.0 ELSE 0.0 END), 4) AS all_hit,
  round(avg(CASE WHEN gold > 1 THEN CASE WHEN found = gold THEN 1.0 ELSE 0.0 END END), 4) AS multi_all_hit,
  (SELECT round(avg(dense_score), 4) FROM hits WHERE rank = 1) AS mean_top_dense FROM rc""")
def _(t):
    return retrieval.recall_at_k(hits(t, False), gold(t))


@query("answer_measurement", "Q11", f"""WITH {EVALUATED}, {GOLD}, {RECALL}
SELECT count(*) AS questions, round(avg(context_relevance), 3) AS context_relevance, round(avg(groundedness), 3) AS groundedness,
  round(avg(answer_relevance), 3) AS answer_relevance, round(avg(CASE WHEN g.n > 1 THEN answer_relevance END), 3) AS answer_relevance_multi,
  (SELECT round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 3) FROM rc) AS any_at_k,
  (SELECT round(avg(CASE WHEN found = gold THEN 1.0 ELSE 0.0 END), 3) FROM rc) AS all_at_k
FROM ev LEFT JOIN (SELECT query_id, count(DISTINCT doc_id) AS n FROM gold GROUP BY 1) g USING (query_id)""")
def _(t):
    found = settle(hits(t))
    return quality.measure(messages(t), settle(answered(t, found)), found, settle(gold(t)))


VOCAB_SQL = f"vocab AS (SELECT DISTINCT unnest({q.tokens('text')}) AS term FROM documents)"
FORM = lambda w: q.expand(f"[{w}]")


@query("grounding_guard", "R16", f"""WITH {SEARCH}, {VOCAB_SQL},
tw AS (SELECT query_id, unnest(list_distinct({q.topical(q.tokens('text'))})) AS word FROM {MESSAGE}),
tf AS (SELECT query_id, word, unnest(list_distinct({FORM('word')})) AS term FROM tw),
shown AS (SELECT DISTINCT query_id, unnest({q.tokens('search_text')}) AS term FROM hx),
pw AS (SELECT query_id, word, count(v.term) > 0 AS evidence, count(r.term) > 0 AS shown FROM tf LEFT JOIN vocab v USING (term)
  LEFT JOIN shown r USING (query_id, term) GROUP BY 1, 2),
pq AS (SELECT query_id, count(*) AS topical, count(*) FILTER (WHERE evidence) AS evidence, count(*) FILTER (WHERE evidence AND shown) AS supported,
  count(*) FILTER (WHERE word NOT IN {q.names(CORPUS.vague_words)}) AS subject,
  count(*) FILTER (WHERE evidence AND word NOT IN {q.names(CORPUS.vague_words)}) AS subject_evidence FROM pw GROUP BY 1)
SELECT query_id, topical, evidence, supported, NOT (subject > 0 AND subject_evidence = 0) AND evidence > 0 AND evidence / topical >= 0.5
  AND NOT (evidence / topical <= 0.5 AND topical > 1 AND best < 0.33) AND supported / greatest(evidence, 1) >= 0.5 AS grounded
FROM pq JOIN (SELECT query_id, max(dense_score) AS best FROM hits GROUP BY 1) USING (query_id)""")
def _(t):
    from answerlake.plans import corpus
    return retrieval.grounding_guard(messages(t), hits(t), corpus.vocabulary(t.texts, CORPUS), CORPUS)


SWEPT = f"""{s.SEARCH}, {s.mmr_sql()}, runs AS (
  SELECT k, 1.0::DOUBLE AS lam, query_id, rank, chunk_id, doc_id, dense_score FROM pool, (SELECT unnest([3, 4]) AS k) WHERE rank <= k
  UNION ALL SELECT k, 0.8, query_id, step, chunk_id, doc_id, dense_score FROM picked, (SELECT unnest([3, 4]) AS k) WHERE step <= k)"""


def swept(t):
    base = s.index(t)
    pool = settle(retrieval.candidate_pool(s.questions(t), base, s.CONFIG))
    return retrieval.sweep(pool, base, [3, 4], [1.0, 0.8])


@query("parameter_sweep", "R17 R13", f"WITH {SWEPT} SELECT CAST(k AS INTEGER) AS k, lam, query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM runs")
def _(t):
    return swept(t).select("k", "lam", "query_id", "rank", "chunk_id")


@query("compared_runs", "J15 R18", f"""WITH {SWEPT}, {GOLD},
was AS (SELECT query_id, count(DISTINCT doc_id) AS was FROM runs JOIN gold USING (query_id, doc_id) WHERE k = 3 AND lam = 1.0 GROUP BY 1),
now AS (SELECT query_id, count(DISTINCT doc_id) AS now FROM runs JOIN gold USING (query_id, doc_id) WHERE k = 4 AND lam = 0.8 GROUP BY 1)
SELECT query_id, coalesce(was, 0) AS was, coalesce(now, 0) AS now,
  CASE WHEN coalesce(now, 0) > coalesce(was, 0) THEN 'gained' WHEN coalesce(now, 0) < coalesce(was, 0) THEN 'lost' ELSE 'same' END AS change
FROM was FULL JOIN now USING (query_id)""")
def _(t):
    runs = settle(swept(t))
    return retrieval.compare_runs(runs.filter("k = 3 AND lam = 1.0"), runs.filter("k = 4 AND lam = 0.8"), gold(t))


# ----------------------------------------------------------------- model runs

RUNS = """runs AS (SELECT conv_id AS query_id, CASE turn % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'offline' END AS model,
  (length(text) % 17) / 16.0::DOUBLE AS context_relevance, (length(text) % 21) / 20.0::DOUBLE AS groundedness, (length(text) % 13) / 12.0::DOUBLE AS answer_relevance,
  CASE WHEN length(text) % 7 = 0 THEN 'figures' END AS withheld, length(text) % 4 AS missing, CASE WHEN length(text) % 19 = 0 THEN 'timeout' END AS error,
  (length(text) % 50) / 10.0::DOUBLE AS seconds FROM conversations)"""


def runs(t):
    n = F.length("text")
    return t.conversations.select(
        F.col("conv_id").alias("query_id"),
        F.when(F.col("turn") % 3 == 0, "small").when(F.col("turn") % 3 == 1, "large").otherwise("offline").alias("model"),
        (n % 17 / F.lit(16.0)).alias("context_relevance"), (n % 21 / F.lit(20.0)).alias("groundedness"),
        (n % 13 / F.lit(12.0)).alias("answer_relevance"), F.when(n % 7 == 0, "figures").alias("withheld"),
        (n % 4).alias("missing"), F.when(n % 19 == 0, "timeout").alias("error"), (n % 50 / F.lit(10.0)).alias("seconds"))


SUMMARY = f"""WITH {RUNS}, summary AS (SELECT model, round(avg(context_relevance), 3) AS context_relevance, round(avg(groundedness), 3) AS groundedness,
  round(avg(answer_relevance), 3) AS answer_relevance, count(withheld) AS withheld_answers, count(*) FILTER (WHERE missing = 0 AND error IS NULL) AS complete,
  count(error) AS errors, round(median(seconds), 2) AS median_seconds, round(max(seconds), 2) AS max_seconds FROM runs GROUP BY 1)"""


@query("model_summary", "A11", SUMMARY + " SELECT * FROM summary")
def _(t):
    return quality.model_summary(runs(t))


@query("model_recommendation", "W10", SUMMARY + """ SELECT coalesce(m, 'offline') AS model, CASE WHEN m IS NULL THEN 'no live model reached groundedness 0.4' END AS note
FROM (SELECT max(model) AS m FROM (SELECT model FROM summary WHERE model <> 'offline' AND groundedness >= 0.4
  AND errors < (SELECT count(DISTINCT query_id) FROM runs) ORDER BY groundedness DESC, withheld_answers, answer_relevance DESC, model DESC LIMIT 1))""")
def _(t):
    questions = runs(t).select("query_id").distinct().count()
    return quality.recommend(quality.model_summary(runs(t)), 0.4, questions)


@query("identical_responses", "A13", """SELECT count(*) AS questions, round(coalesce(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 0), 4) AS identical_rate FROM (
  SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, count(*) AS models FROM lineitem GROUP BY 1) WHERE models > 1""")
def _(t):
    return quality.identical_rate(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("response")))


METRICS = ("context_relevance", "groundedness", "answer_relevance")


@query("weakest_metric", "W9", f"""WITH {b.SCORES} SELECT id, m[1].metric AS weakest, m[1].value AS value FROM (SELECT id, list_sort([
  {{'value': context_relevance, 'o': 0, 'metric': 'context_relevance'}}, {{'value': groundedness, 'o': 1, 'metric': 'groundedness'}},
  {{'value': answer_relevance, 'o': 2, 'metric': 'answer_relevance'}}]) AS m FROM scores)""")
def _(t):
    return quality.weakest_metric(b.scores(t), "id", METRICS)


@query("metric_deltas", "Q13", f"""WITH {RUNS}, n AS (SELECT model, round(avg(context_relevance), 3) AS context_relevance, round(avg(groundedness), 3) AS groundedness,
  round(avg(answer_relevance), 3) AS answer_relevance FROM runs GROUP BY 1),
o AS (SELECT model, round(avg(context_relevance), 3) AS context_relevance, round(avg(groundedness), 3) AS groundedness,
  round(avg(answer_relevance), 3) AS answer_relevance FROM runs WHERE seconds < 2 GROUP BY 1),
nl AS (UNPIVOT n ON context_relevance, groundedness, answer_relevance INTO NAME metric VALUE new),
ol AS (UNPIVOT o ON context_relevance, groundedness, answer_relevance INTO NAME metric VALUE old)
SELECT model, metric, new, old, round(new - old, 3) AS delta FROM nl LEFT JOIN ol USING (model, metric)""")
def _(t):
    rows = runs(t)
    new = quality.model_summary(rows).select("model", *METRICS)
    old = quality.model_summary(rows.filter("seconds < 2")).select("model", *METRICS)
    return quality.metric_deltas(new, old, METRICS)


@query("release_gate", "A18", f"""WITH {b.SCORES}, m AS (SELECT avg(groundedness) AS groundedness, avg(answer_relevance) AS answer_relevance FROM scores),
v AS (SELECT 'groundedness' AS metric, 0.4 AS minimum, round(groundedness, 4) AS value FROM m UNION ALL SELECT 'answer_relevance', 0.6, round(answer_relevance, 4) FROM m
  UNION ALL SELECT 'any_at_k', 0.95, NULL)
SELECT metric, minimum::DOUBLE AS minimum, value, coalesce(value >= minimum, false) AS passed, bool_and(coalesce(value >= minimum, false)) OVER () AS gate_passed FROM v""")
def _(t):
    means = b.scores(t).agg(F.round(F.avg("groundedness"), 4).alias("groundedness"), F.round(F.avg("answer_relevance"), 4).alias("answer_relevance"))
    long = quality.unpivot_metrics(means.withColumn("run", F.lit("now")), ["run"], ["groundedness", "answer_relevance"])
    return quality.quality_gate(long, {"groundedness": 0.4, "answer_relevance": 0.6, "any_at_k": 0.95})


CASES_SQL = f"""WITH last AS (SELECT conv_id, arg_max(text, turn) AS answer, max(turn) AS turns FROM conversations WHERE role = 'assistant' GROUP BY 1),
c AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multi_turn' ELSE 'vague' END AS category, conv_id % 2 = 0 AS gate,
  list_filter(['tion', 'an'], lambda k: NOT contains(lower(answer), k)) AS absent FROM last),
d AS (SELECT conv_id AS case_id, category, gate, concat_ws('; ', array_to_string(list_transform(absent, lambda k: 'missing ' || k), '; '),
  CASE WHEN conv_id % 5 = 0 AND turns > 3 THEN 'answered instead of declining' END,
  CASE WHEN conv_id % 4 < 2 AND (turns > 5) <> (conv_id % 4 = 0) THEN 'handover differs' END,
  CASE WHEN conv_id % 7 = 0 THEN 'lookup missing' END,
  CASE WHEN conv_id % 3 = 2 AND NOT (starts_with(answer, 'Er') OR contains(answer, '?')) THEN 'neither asked nor declined' END) AS problems FROM c),
checked AS (SELECT case_id, category, gate, trim(problems, '; ') = '' AS passed, CASE WHEN trim(problems, '; ') = '' THEN 'ok' ELSE trim(problems, '; ') END AS detail FROM d)"""


def checked_cases(t):
    last = t.conversations.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("case_id")).agg(
        F.max_by("text", "turn").alias("answer"), F.max("turn").alias("turns"))
    ident = F.col("case_id")
    cases = last.select(
        "case_id", F.when(ident % 3 == 0, "single").when(ident % 3 == 1, "multi_turn").otherwise("vague").alias("category"),
        (ident % 2 == 0).alias("gate"), x.word_set(("tion", "an")).alias("keywords"),
        F.when(ident % 5 == 0, True).alias("refuse"), F.when(ident % 4 < 2, ident % 4 == 0).alias("handover"),
        F.when(ident % 7 == 0, "AB12").alias("lookup"), (ident % 3 == 2).alias("refuse_or_ask"))
    results = last.select("case_id", "answer", F.when(F.col("turns") > 3, x.word_set(("doc",))).alias("sources"),
                          (F.col("turns") > 5).alias("opened"), x.word_set(("XY99",)).alias("lookups"))
    return quality.check_cases(results, cases, "Er")


@query("checked_cases", "Q12", CASES_SQL + " SELECT * FROM checked")
def _(t):
    return checked_cases(t)


@query("case_summary", "A21", CASES_SQL + """ SELECT category, count(*) FILTER (WHERE passed) AS passed, count(*) AS total, bool_or(gate) AS gating,
  count(*) FILTER (WHERE gate AND NOT passed) AS gate_failures FROM checked GROUP BY 1""")
def _(t):
    return quality.case_summary(checked_cases(t))


SORRY, OFFER = "We are sorry for the trouble.\n\n", "Would you like to talk to a person?"


def variants(t):
    plain = t.texts.select(F.col("doc_id").alias("pair_id"), F.lit("calm").alias("variant"), x.strip(F.col("text")).alias("answer"),
                               F.array("source", "lang").alias("sources"))
    body = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("No. "), x.strip(F.col("text")))).otherwise(x.strip(F.col("text")))
    upset = t.texts.select(
        F.col("doc_id").alias("pair_id"), F.lit("upset").alias("variant"), F.concat(F.lit(SORRY), body, F.lit("\n\n" + OFFER)).alias("answer"),
        F.when(F.col("doc_id") % 15 == 0, F.array("source")).otherwise(F.array("lang", "source")).alias("sources"))
    return plain.unionByName(upset)


@query("fairness_pairs", "J16 Q14", """SELECT doc_id AS pair_id, 'upset' AS variant, doc_id % 10 <> 0 AS same_answer, doc_id % 15 <> 0 AS same_sources FROM documents""")
def _(t):
    return quality.fairness_pairs(variants(t), "calm", SORRY, [OFFER])


@query("core_texts", "Q14", f"SELECT doc_id, {q.strip('text')} AS core FROM documents")
def _(t):
    return variants(t).filter("variant = 'upset' AND pair_id % 10 <> 0").unionByName(
        variants(t).filter("variant = 'calm' AND pair_id % 10 = 0")).select(
        F.col("pair_id").alias("doc_id"), quality.core_text(F.col("answer"), SORRY, [OFFER]).alias("core"))


# ------------------------------------------------------------------ band joins

@query("band_bonus", "J11", """SELECT p_partkey, CAST(
    (CASE WHEN y BETWEEN 2 AND c THEN 6 ELSE -2 END) + (CASE WHEN x BETWEEN 5 AND 5 + a THEN 6 ELSE -2 END)
  + (CASE WHEN d = 7 THEN 0 WHEN z > d THEN 3 ELSE -1 END) AS DOUBLE) AS bonus FROM (
  SELECT p_partkey, p_size AS a, p_size % 12 + 1 AS c, p_partkey % 24 AS d, p_partkey % 40 AS x, p_partkey % 15 AS y, p_partkey % 30 AS z FROM part)""")
def _(t):
    key = F.col("p_partkey")

    def n(c):
        return c.cast("string")

    sentence = F.concat(F.lit("Between five kg and "), n(F.col("p_size") + 5), F.lit("kg, or two to "), n(F.col("p_size") % 12 + 1),
                        F.lit(" days, over "), n(key % 24), F.lit(" hours and not more than 7 days."))
    question = F.concat(n(key % 40), F.lit(" kilos and "), n(key % 15), F.lit(" days and "), n(key % 30), F.lit(" hrs"))
    parts = spread(t.part.select("p_partkey", "p_size"))
    return parts.select("p_partkey", quality.band_bonus(sentence, quality.quantities(question)).alias("bonus"))


@query("band_join", "J11", """SELECT p_type, p_size, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS line_sum
FROM (SELECT DISTINCT p_type, p_size FROM part) JOIN lineitem ON l_quantity BETWEEN p_size AND p_size + 1.5 GROUP BY 1, 2""")
def _(t):
    bands = t.part.select("p_type", "p_size").distinct().withColumns({
        "low": F.col("p_size").cast("double"), "high": F.col("p_size") + F.lit(1.5)})
    values = t.lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    return lanes.band_join(values, bands, "l_quantity", "low", "high", 4.0).groupBy("p_type", "p_size").agg(
        F.sum("n").alias("lines"), F.sum("s").alias("line_sum"))
