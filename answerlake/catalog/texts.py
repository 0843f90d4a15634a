"""Text-function queries over whole documents, questions and transcripts."""

from pyspark.sql import functions as F

from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.catalog.sqlparts import CORPUS
from answerlake.functions import text as x
from answerlake.functions import vocabulary as v
from answerlake.operators import extraction as ex
from answerlake.plans import corpus


def bar(col):
    return F.array_join(col, "|")


@query("document_tokens", "T1 T2 T3", f"SELECT doc_id, {q.joined(q.tokens('text'))} AS tokens FROM documents")
def _(t):
    return t.texts.select("doc_id", bar(x.tokenize(F.col("text"), CORPUS)).alias("tokens"))


@query("phrase_rewrites", "T2", f"SELECT doc_id, {q.rewrite('text')} AS text FROM documents")
def _(t):
    return t.texts.select("doc_id", x.rewrite_phrases(F.col("text"), CORPUS).alias("text"))


@query("plural_folds", "T3", f"""SELECT w, {q.fold('w')} AS folded, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents) GROUP BY 1, 2""")
def _(t):
    said = t.texts.select(F.explode(x.extract_all(F.lower("text"), "[a-z0-9]+")).alias("w"))
    return said.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("folded", x.fold_plural(F.col("w")))


@query("question_expansion", "T4", f"""SELECT item_id, {q.joined(q.expand('toks'))} AS tokens FROM (
  SELECT item_id, {q.tokens('text')} AS toks FROM benchmark)""")
def _(t):
    return t.benchmark.select("item_id", bar(x.expand(x.tokenize(F.col("text"), CORPUS), CORPUS)).alias("tokens"))


@query("topical_tokens", "T5", f"""SELECT conv_id, turn, {q.joined(q.topical(q.tokens('text')))} AS tokens FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", bar(x.topical(x.tokenize(F.col("text"), CORPUS), CORPUS)).alias("tokens"))


@query("sentence_split", "T6", f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, s[i] AS sentence FROM (
  SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT doc_id, {q.sentences('text')} AS s FROM documents))""")
def _(t):
    return t.texts.select("doc_id", F.posexplode(x.sentences(F.col("text"))).alias("position", "sentence")).withColumn(
        "position", F.col("position").cast("bigint"))


@query("clause_split", "T6", f"""SELECT conv_id, turn, {q.joined(q.clauses('text'))} AS clauses FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", bar(x.clauses(F.col("text"))).alias("clauses"))


@query("request_focus", "T7")
def _(t):
    shouted = F.filter(F.transform(x.clauses(x.strip(F.col("text"))), lambda c, i: F.when(c.rlike("[!]"), i)),
                       lambda i: i.isNotNull())
    return t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", x.focus(F.col("text"), CORPUS, shouted).alias("request"))


# Questions made of two transcript passages joined the way people join requests.
ASKED = "(SELECT conv_id, turn, 'It is late. What ' || lower(left(text, 40)) || ' and how ' || lower(right(text, 30)) || '?' AS text FROM conversations)"


def asked(t):
    return t.conversations.select("conv_id", "turn", F.concat(
        F.lit("It is late. What "), F.lower(F.left("text", F.lit(40))), F.lit(" and how "),
        F.lower(F.right("text", F.lit(30))), F.lit("?")).alias("text"))


TRIM_PART = "trim(p, ' ,.?!')"
PART_OPENER = "(?i)^\\s*(" + "|".join(v.PART_OPENERS) + ")($|[^\\p{L}\\p{N}_])"
INTERROGATIVE = q.word_edge("|".join(v.INTERROGATIVES))


@query("compound_questions", "T8", f"""WITH s AS (SELECT conv_id, turn, {q.strip('text')} AS text FROM {ASKED}),
c AS (SELECT *, {q.clauses('text')} AS parts FROM s),
l AS (SELECT *, list_max(list_filter(list_transform(range(1, length(parts) + 1),
    lambda i: CASE WHEN regexp_matches(parts[i], '{INTERROGATIVE}') THEN i END), lambda i: i IS NOT NULL)) AS pos FROM c),
f AS (SELECT *, array_to_string(parts[1:pos - 1], ' ') AS context, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(parts[pos], '(?i)\\s+(and|also|plus|as\\s+well\\s+as)\\s+', chr(1), 'g'), '\\s*;\\s*', chr(1), 'g'), chr(1)),
    lambda p: {TRIM_PART}), lambda p: length(p) > 0) AS raw FROM l),
g AS (SELECT *, list_filter(raw, lambda p: regexp_matches(p, '{PART_OPENER}') AND length({q.tokens('p')}) >= 2) AS own FROM f)
SELECT conv_id, turn, array_to_string(CASE WHEN pos IS NOT NULL AND length(raw) >= 2 AND length(own) >= 2 THEN list_concat([text],
  list_filter(list_transform(own[1:3], lambda p: {q.strip("(context || ' ' || p)")}), lambda p: lower(p) <> lower(text))) ELSE [text] END, '|') AS parts
FROM g""")
def _(t):
    return asked(t).select("conv_id", "turn", bar(x.subqueries(F.col("text"), CORPUS)).alias("parts"))


QUESTION_OPENER = "(?i)^(" + "|".join(v.QUESTION_OPENERS) + ")($|[^\\p{L}\\p{N}_])"
JOIN_AT = "(?i)\\s*,?\\s+(and|also|plus)\\s+(" + "|".join(v.QUESTION_OPENERS) + ")([^\\p{L}\\p{N}_]|$)"


def sql_parts(s):
    return (f"list_filter(list_transform(string_split(regexp_replace({s}, '{JOIN_AT}', chr(1) || '\\2\\3', 'g'), chr(1)), "
            f"lambda p: trim(p, ' ,')), lambda p: length(p) > 0)")


def sql_asks(s):
    return f"(ends_with({s}, '?') OR length({sql_parts(s)}) > 1 OR regexp_matches({s}, '{QUESTION_OPENER}'))"


@query("question_parts", "T9", f"""WITH s AS (SELECT conv_id, turn, text, {q.sentences(q.strip('text'))} AS said FROM {ASKED}),
p AS (SELECT *, flatten(list_transform(list_filter(said, lambda z: {sql_asks('z')}), lambda z: {sql_parts('z')})) AS parts,
  array_to_string(list_filter(said, lambda z: NOT {sql_asks('z')}), ' ') AS situation FROM s)
SELECT conv_id, turn, array_to_string(CASE WHEN length(parts) < 2 THEN [text] ELSE list_transform(parts, lambda p:
  CASE WHEN length({q.topical(q.tokens('p'))}) >= 2 THEN p ELSE {q.strip("(situation || ' ' || p)")} END) END, '|') AS parts FROM p""")
def _(t):
    return asked(t).select("conv_id", "turn", bar(x.split_question(F.col("text"), CORPUS)).alias("parts"))


@query("word_windows", "T10", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS items FROM documents),
n AS (SELECT *, CASE WHEN length(items) = 0 THEN 0 WHEN length(items) <= 100 THEN 1
  ELSE CAST(ceil((length(items) - 100) / 80.0) AS BIGINT) + 1 END AS windows FROM w)
SELECT doc_id, i AS window_no, array_to_string(items[i * 80 + 1 : i * 80 + 100], ' ') AS text
FROM (SELECT *, unnest(range(0, windows)) AS i FROM n)""")
def _(t):
    return t.texts.select("doc_id", F.posexplode(x.word_windows(F.col("text"), 100, 20)).alias("window_no", "text")).withColumn(
        "window_no", F.col("window_no").cast("bigint"))


@query("content_words", "T12", f"SELECT doc_id, {q.sorted_join(q.content('text'))} AS words FROM documents")
def _(t):
    return t.texts.select("doc_id", bar(F.array_sort(x.content_words(F.col("text")))).alias("words"))


# Spelled-out numbers are put next to the documents' own figures.
NUMBERED = """(SELECT doc_id, text || ' costs ' || ['nine thousand', 'twenty one', 'two hundred and five', 'zero', 'one million', 'none'][doc_id % 6 + 1]
  || ' or ' || CAST(doc_id AS VARCHAR) || ',5' || CAST(doc_id % 7 AS VARCHAR) || '0.' AS text FROM documents)"""


def numbered(t):
    spelled = F.element_at(x.word_set(["nine thousand", "twenty one", "two hundred and five", "zero", "one million", "none"]),
                           (F.col("doc_id") % 6 + 1).cast("int"))
    return t.texts.select("doc_id", F.concat(
        F.col("text"), F.lit(" costs "), spelled, F.lit(" or "), F.col("doc_id").cast("string"), F.lit(",5"),
        (F.col("doc_id") % 7).cast("string"), F.lit("0.")).alias("text"))


@query("numeric_atoms", "T13", f"""SELECT doc_id, CAST(length(a) AS BIGINT) AS n, CAST(list_sum(list_transform(list_filter(a, lambda d: d < 1000000000), lambda d: floor(d))) AS DOUBLE) AS total, list_max(a) AS largest
FROM (SELECT doc_id, {q.atoms('text')} AS a FROM {NUMBERED})""")
def _(t):
    atoms = numbered(t).select("doc_id", x.numeric_atoms(F.col("text")).alias("a"))
    return atoms.select("doc_id", F.size("a").cast("bigint").alias("n"),
                        F.aggregate(F.filter("a", lambda n: n < 1000000000), F.lit(0.0), lambda s, n: s + F.floor(n)).alias("total"),
                        F.array_max("a").alias("largest"))


@query("negation_cues", "T14", f"""SELECT doc_id, {q.negated('text')} AS negated FROM (
  SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' It is NOT so.' WHEN 1 THEN ' Don''t.' ELSE ' Knot.' END AS text FROM documents)""")
def _(t):
    tail = F.when(F.col("doc_id") % 4 == 0, " It is NOT so.").when(F.col("doc_id") % 4 == 1, " Don't.").otherwise(" Knot.")
    return t.texts.select("doc_id", x.has_negation(F.concat(F.col("text"), tail)).alias("negated"))


@query("edit_distance", "T15", """SELECT a.p_partkey, CAST(levenshtein(upper(regexp_replace(trim(a.p_name), '\\s+', ' ', 'g')),
  upper(regexp_replace(trim(b.p_name), '\\s+', ' ', 'g'))) AS INTEGER) AS changed FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def _(t):
    other = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return t.part.join(other, "p_partkey").select(
        "p_partkey", x.characters_changed(F.col("p_name"), F.col("next_name")).alias("changed"))


PHONES = """(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '07' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  WHEN 1 THEN '+254 7' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '1' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  ELSE CAST(c_custkey AS VARCHAR) END AS phone FROM customer)"""


def phones(t):
    eight = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    turn = F.col("c_custkey") % 4
    return t.customer.select("c_custkey", F.when(turn == 0, F.concat(F.lit("07"), eight)).when(
        turn == 1, F.concat(F.lit("+254 7"), eight)).when(turn == 2, F.concat(F.lit("1"), eight)).otherwise(
        F.col("c_custkey").cast("string")).alias("phone"))


@query("phone_normal_form", "T17", f"""SELECT c_custkey, CASE WHEN starts_with(d, '0') AND length(d) = 10 THEN '254' || substr(d, 2)
  WHEN length(d) = 9 AND left(d, 1) IN ('1', '7') THEN '254' || d ELSE d END AS phone
FROM (SELECT c_custkey, regexp_replace(phone, '[^0-9]', '', 'g') AS d FROM {PHONES})""")
def _(t):
    return phones(t).select("c_custkey", x.normalise_phone(F.col("phone")).alias("phone"))


# The nation table as a place tree: nation -> region, names from the generator's rule.
REGIONS = ("africa", "america", "asia", "europe", "middle east")
PLACES = CORPUS.with_(
    places={**{r: () for r in REGIONS}, **{f"nation_{i}": (REGIONS[i % 5],) for i in range(25)}},
    aliases={"n3": "nation_3", "old world": "europe"}, place_codes=("n3",), not_places=(r"asia\s+minor",),
    cities=tuple(f"nation_{i}" for i in range(25)))
NAMED = """(SELECT doc_id, text || ' from NATION_' || CAST(doc_id % 25 AS VARCHAR) || ' to nation_' || CAST(doc_id * 7 % 25 AS VARCHAR)
  || [' in Asia', ' in Asia Minor', ' via N3', ' via n3', ' the Old World'][doc_id % 5 + 1] AS text FROM documents)"""


def named(t):
    tail = F.element_at(x.word_set([" in Asia", " in Asia Minor", " via N3", " via n3", " the Old World"]),
                        (F.col("doc_id") % 5 + 1).cast("int"))
    return t.texts.select("doc_id", F.concat(
        F.col("text"), F.lit(" from NATION_"), (F.col("doc_id") % 25).cast("string"), F.lit(" to nation_"),
        (F.col("doc_id") * 7 % 25).cast("string"), tail).alias("text"))


@query("place_mentions", "T18", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(clean, '(^|[^\\p{{L}}\\p{{N}}_])(africa|america|asia|europe|middle east|old world|nation_[0-9]+)', 2),
     lambda p: CASE p WHEN 'old world' THEN 'europe' ELSE p END),
  CASE WHEN regexp_matches(raw, '(^|[^\\p{{L}}\\p{{N}}_])N3($|[^\\p{{L}}\\p{{N}}_])') THEN ['nation_3'] ELSE []::VARCHAR[] END))), '|') AS places
FROM (SELECT doc_id, text AS raw, regexp_replace(lower(text), 'asia\\s+minor', ' ', 'g') AS clean FROM {NAMED})""")
def _(t):
    return named(t).select("doc_id", bar(x.places_in(F.col("text"), PLACES)).alias("places"))


KINDS = dict(ordered=[("late", "(?i)tionha"), ("special", "(?i)zz|ww")],
             exclusive=[("hand", "(?i)inger"), ("checked", "(?i)ereat|eraton")], weak=[("checked", "(?i)ouen")])


@query("topic_kinds", "T19", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)tionha') THEN 'late'
  WHEN regexp_matches(text, '(?i)zz|ww') THEN 'special'
  WHEN regexp_matches(text, '(?i)inger') AND regexp_matches(text, '(?i)ereat|eraton') THEN NULL
  WHEN regexp_matches(text, '(?i)inger') THEN 'hand' WHEN regexp_matches(text, '(?i)ereat|eraton') THEN 'checked'
  WHEN regexp_matches(text, '(?i)ouen') THEN 'checked' END AS kind FROM documents""")
def _(t):
    return t.texts.select("doc_id", x.classify_rules(F.col("text"), **KINDS).alias("kind"))


PRICED = """(SELECT o_orderkey, 'First Ksh ' || CAST(o_custkey AS VARCHAR) || ',5 then USD ' || CAST(o_orderkey % 90 AS VARCHAR)
  || ' and ' || CAST(o_orderkey % 90 AS VARCHAR) || ' US dollars, $' || CAST(o_orderkey % 7 AS VARCHAR) || ' or 12 items' AS text FROM orders)"""


def priced(t):
    low = (F.col("o_orderkey") % 90).cast("string")
    return t.orders.select("o_orderkey", F.concat(
        F.lit("First Ksh "), F.col("o_custkey").cast("string"), F.lit(",5 then USD "), low, F.lit(" and "), low,
        F.lit(" US dollars, $"), (F.col("o_orderkey") % 7).cast("string"), F.lit(" or 12 items")).alias("text"))


@query("money_amounts", "T21", f"""WITH m AS (SELECT o_orderkey, list_transform(
    regexp_extract_all(text, '(?i)(ksh|kes)\\s?[0-9,]+|(usd|us\\$|\\$)\\s?[0-9,]+|[0-9,]+\\s+us\\s+dollars'),
    lambda s: {{'amount': CAST(replace(regexp_extract(s, '[0-9,]+'), ',', '') AS DOUBLE),
      'currency': CASE WHEN regexp_matches(s, '(?i)^(ksh|kes)') THEN 'KES' ELSE 'USD' END}}) AS ms FROM {PRICED}),
d AS (SELECT o_orderkey, {q.keep_order('ms')} AS ds FROM m)
SELECT o_orderkey, CAST(i - 1 AS BIGINT) AS position, ds[i].amount AS amount, ds[i].currency AS currency
FROM (SELECT *, unnest(range(1, length(ds) + 1)) AS i FROM d)""")
def _(t):
    found = priced(t).select("o_orderkey", F.posexplode(x.money(F.col("text"))).alias("position", "m"))
    return found.select("o_orderkey", F.col("position").cast("bigint").alias("position"), "m.amount", "m.currency")


@query("amounts_by_context", "T22")
def _(t):
    low = (F.col("o_orderkey") % 90 + 10).cast("string")
    answers = t.orders.select(
        "o_orderkey",
        F.concat(F.lit("Changing costs "), low, F.lit(" US dollars on an urgent order and 75 US dollars on a low order. "),
                 F.lit("It takes a day.")).alias("answer"),
        F.concat(F.lit("What is the price of my "), F.lower(F.substring_index("o_orderpriority", "-", -1)),
                 F.lit(" order?")).alias("question"),
        F.when(F.col("o_orderstatus") == "F", "Fees").otherwise("Changes").alias("heading"))
    return ex.amounts_by_context(answers).select("o_orderkey", "question", "amount", "currency")


PROSE = """(SELECT s_suppkey, 'Orders from NATION_' || CAST(s_nationkey AS VARCHAR) || ' are charged '
  || CAST(s_suppkey % 40 AS VARCHAR) || '.5 for ASIA, ' || CAST(s_suppkey % 30 AS VARCHAR) || ' for  EUROPE. Other text. '
  || 'Up to three changes costs ' || CAST(s_suppkey AS VARCHAR) || ' here and 75 abroad.' AS text FROM supplier)"""
TABLE_RULES = [
    ex.RowRule("lanes", r"(?i)Orders from (NATION_\d+) are charged (.*?)\. ", r"(?i)(\d+(?:\.\d+)?) for (ASIA|EUROPE)"),
    ex.TierRule("changes", r"(?i)up to (\w+) changes costs (\d+) here and (\d+) abroad",
                ((2, "change", "here"), (3, "change", "abroad")), 1),
]


@query("tables_from_text", "T25", f"""SELECT s_suppkey, 'lanes' AS rule, 'nation_' || CAST(s_nationkey AS VARCHAR) AS row_key, c AS column_key,
  a AS amount FROM (SELECT s_suppkey, s_nationkey, unnest(['asia', 'europe']) AS c,
     unnest([s_suppkey % 40 + 0.5::DOUBLE, CAST(s_suppkey % 30 AS DOUBLE)]) AS a FROM supplier)
UNION ALL SELECT s_suppkey, 'changes', unnest(['change', 'change', 'limit']), unnest(['here', 'abroad', 'limit']),
  unnest([CAST(s_suppkey AS DOUBLE), 75.0, 3.0]) FROM supplier""")
def _(t):
    number = F.col("s_suppkey")
    prose = t.supplier.select("s_suppkey", F.concat(
        F.lit("Orders from NATION_"), F.col("s_nationkey").cast("string"), F.lit(" are charged "),
        (number % 40).cast("string"), F.lit(".5 for ASIA, "), (number % 30).cast("string"),
        F.lit(" for  EUROPE. Other text. Up to three changes costs "), number.cast("string"),
        F.lit(" here and 75 abroad.")).alias("text"))
    return ex.extract_tables(prose, "s_suppkey", "text", TABLE_RULES)


ENTITIES = [
    ex.EntityRule("email", r"[A-Za-z0-9._+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", (0,)),
    ex.EntityRule("phone", r"\+1 \((\d{3})\) 555-(\d{4})", (2,)),
    ex.EntityRule("address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", (0,)),
    ex.EntityRule("code", r"[A-Z][A-Za-z0-9]{4,6}[a-z]*", (0,), ("DEATH",), code_like=True, upper=True),
]


def sql_entities(kind, values):
    return f"""SELECT doc_id, '{kind}' AS kind, vs[i] AS value, CAST(i - 1 AS BIGINT) AS position FROM (
  SELECT doc_id, vs, unnest(range(1, length(vs) + 1)) AS i FROM (SELECT doc_id, {values} AS vs FROM documents))"""


@query("entity_rows", "T27", " UNION ALL ".join([
    sql_entities("email", "regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')"),
    sql_entities("phone", "regexp_extract_all(text, '\\+1 \\([0-9]{3}\\) 555-([0-9]{4})', 1)"),
    sql_entities("address", "regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')"),
    sql_entities("code", "list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Z][A-Za-z0-9]{4,6}[a-z]*'), "
                 "lambda s: regexp_matches(s, '[0-9]') OR s = upper(s)), lambda s: upper(s)), lambda s: s NOT IN ('DEATH'))"),
]))
def _(t):
    return ex.extract_entities(t.texts, "doc_id", "text", ENTITIES).withColumn(
        "position", F.col("position").cast("bigint"))


FRENCH = ("de", "la", "le", "des", "en", "que", "les", "un", "et", "du")


@query("language_share", "T28", f"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda w: lower(w)) AS said FROM documents),
h AS (SELECT *, list_filter(said, lambda w: w IN {q.names(FRENCH)}) AS hits FROM w)
SELECT doc_id, lang, length(said) >= 3 AND length(list_distinct(hits)) >= 3 AND length(hits) / length(said) >= 0.3 AS french FROM h""")
def _(t):
    return t.texts.select("doc_id", "lang", x.is_language(F.col("text"), FRENCH).alias("french"))


TERMS = [("de la", "of the"), ("que le", "that the"), ("pour", "for"), ("avec", "with"), ("dans", "in"), ("et", "and"),
         ("le", "the"), ("la", "the"), ("de", "of")]


@query("glossary_translation", "T29")
def _(t):
    return t.conversations.select("conv_id", "turn", x.glossary(F.col("text"), TERMS, FRENCH, ("of", "in")).alias("english"))


INTENTS = [("handover", "(?i)tionti"), ("small_talk", "(?i)^the "), ("schedule", "(?i)hour|heur|ouer"), ("payment", "(?i)pai"),
           ("lookup", "(?i)ciones|keit")]


@query("intent_routes", "T33", """SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)tionti') THEN 'handover'
  WHEN regexp_matches(text, '(?i)^the ') THEN 'small_talk' WHEN regexp_matches(text, '(?i)hour|heur|ouer') THEN 'schedule'
  WHEN regexp_matches(text, '(?i)pai') THEN 'payment' WHEN regexp_matches(text, '(?i)ciones|keit') THEN 'lookup'
  ELSE 'question' END AS intent FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", x.route_intent(F.col("text"), INTENTS).alias("intent"))


def sql_capped(n, most):
    return f"least({n}, {most}) / {float(most)}"


LONG = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
STYLE_SQL = {
    "caps_ratio": "CASE WHEN length(regexp_extract_all(text, '\\p{L}')) > 0 THEN length(regexp_extract_all(text, '\\p{Lu}'))"
                  " / length(regexp_extract_all(text, '\\p{L}')) ELSE 0.0 END",
    "caps_words": sql_capped("length(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{3,}')))", 10),
    "exclamations": sql_capped("length(text) - length(replace(text, '!', ''))", 5),
    "questions": sql_capped("length(text) - length(replace(text, '?', ''))", 5),
    "mixed_punct": "CASE WHEN contains(text, '?!') OR contains(text, '!?') THEN 1.0 ELSE 0.0 END",
    "repeated_punct": "CASE WHEN contains(text, '!!') OR contains(text, '??') THEN 1.0 ELSE 0.0 END",
    "elongated": f"CASE WHEN regexp_matches(text, '{LONG}') THEN 1.0 ELSE 0.0 END",
    "intensifiers": sql_capped(" + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in v.INTENSIFIERS), 5),
    "length": sql_capped("length(text)", 200),
}


@query("style_features", "T34", "SELECT doc_id, " + ", ".join(f"CAST(round({e}, 6) AS DOUBLE) AS {n}" for n, e in STYLE_SQL.items())
       + " FROM documents")
def _(t):
    return t.texts.select("doc_id", *[F.round(c, 6).alias(n) for n, c in x.style_features(F.col("text")).items()])


@query("context_round_trip", "T35", f"""SELECT doc_id, '[' || source || ' | ' || lang || ']' || chr(10) || text || chr(10) || '---' || chr(10)
  || '[' || lang || ' | ' || source || ']' || chr(10) || lang AS context, 2::BIGINT AS blocks, source AS first_source, lang AS first_section,
  {q.strip('text')} AS first_text FROM documents WHERE {q.strip('text')} <> ''""")
def _(t):
    blocks = F.array(
        F.struct("source", F.col("lang").alias("section"), "text"),
        F.struct(F.col("lang").alias("source"), F.col("source").alias("section"), F.col("lang").alias("text")))
    context = t.texts.filter(x.strip(F.col("text")) != "").select("doc_id", x.serialise_context(blocks).alias("context"))
    parsed = context.withColumn("parsed", x.parse_context(F.col("context")))
    first = F.col("parsed")[0]
    return parsed.select("doc_id", "context", F.size("parsed").cast("bigint").alias("blocks"),
                         first["source"].alias("first_source"), first["section"].alias("first_section"),
                         first["text"].alias("first_text"))


TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


@query("citation_labels", "T36", f"""SELECT p_partkey, CASE WHEN starts_with(lower(p_type), lower({TITLE})) THEN p_type
  ELSE {TITLE} || ' - ' || p_type END || ' (' || p_brand || ')' AS label FROM part""")
def _(t):
    source = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"))
    return t.part.select("p_partkey", x.section_label(source, F.col("p_type"), F.col("p_brand")).alias("label"))


@query("norm_keys", "T37", f"""SELECT regexp_replace(lower({q.strip('text')}), '\\s+', ' ', 'g') AS norm_key, count(*) AS n FROM documents GROUP BY 1""")
def _(t):
    return t.texts.groupBy(x.norm_key(F.col("text")).alias("norm_key")).agg(F.count(F.lit(1)).alias("n"))


@query("vector_cosine", "T39", """SELECT a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 5) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b
  ON b.vec_id = a.vec_id + 1""")
def _(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(other, "vec_id").select(
        "vec_id", F.round(x.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("hashed_embedding", "T40 R4", """WITH w AS (SELECT doc_id, sha256(unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+'))) AS code FROM documents),
r AS (SELECT doc_id, ('0x' || substr(code, 1, 8))::BIGINT % 64 AS bucket,
  CAST(sum(CASE WHEN ('0x' || substr(code, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS raw FROM w GROUP BY 1, 2)
SELECT doc_id, bucket, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r WHERE raw <> 0""")
def _(t):
    return corpus.hashed_embedding(t.texts, "doc_id", "text", 64).withColumn("weight", F.round("weight", 6))


@query("text_clamps", "L6", f"SELECT doc_id, left({q.strip('text')}, 160) AS clamped FROM documents")
def _(t):
    return t.texts.select("doc_id", x.clamp(F.col("text"), 160).alias("clamped"))


@query("ordered_distinct", "U5", f"SELECT doc_id, {q.joined(q.keep_order('w'))} AS words FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)")
def _(t):
    return t.texts.select("doc_id", bar(x.distinct_keep_order(x.words(F.col("text")))).alias("words"))


