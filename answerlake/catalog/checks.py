"""Data audits and generated text."""

from pyspark.sql import functions as F

from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.functions import text as x
from answerlake.operators import audit

# Each document is a registry entry for the next document's opening words.
FLAT = "regexp_replace(lower({}), '\\s+', ' ', 'g')"


@query("registry_audit", "D1", f"""WITH reg AS (SELECT doc_id AS key, CASE WHEN doc_id % 20 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id,
  CASE WHEN doc_id % 7 = 0 THEN 'Zzz ' || left(text, 20) ELSE replace(left(text, 20), 'e', 'E') END AS phrase, CASE WHEN doc_id % 3 = 0 THEN 'published' ELSE 'draft' END AS provenance,
  CASE WHEN doc_id % 2 = 0 THEN 'http://x' END AS source_url FROM documents),
j AS (SELECT r.*, d.text AS body, d.doc_id AS known FROM reg r LEFT JOIN documents d ON d.doc_id = r.doc_id)
SELECT key, doc_id, problem FROM (SELECT key, doc_id, CASE WHEN known IS NULL THEN 'document missing' WHEN NOT contains({FLAT.format('body')}, {FLAT.format('phrase')}) THEN 'figure not in document'
  WHEN provenance = 'published' AND source_url IS NULL THEN 'published without source' END AS problem FROM j) WHERE problem IS NOT NULL""")
def _(t):
    ident = F.col("doc_id")
    opening = F.left("text", F.lit(20))
    registry = t.texts.select(
        ident.alias("key"), F.when(ident % 20 == 0, ident + 1000000000).otherwise(ident).alias("doc_id"),
        F.when(ident % 7 == 0, F.concat(F.lit("Zzz "), opening)).otherwise(F.replace(opening, F.lit("e"), F.lit("E"))).alias("phrase"),
        F.when(ident % 3 == 0, "published").otherwise("draft").alias("provenance"), F.when(ident % 2 == 0, "http://x").alias("source_url"))
    return audit.audit_registry(registry, t.texts)


@query("manifest_gaps", "U2", """SELECT doc_id, 'not in manifest' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT page_id + 900, 'no such document' FROM pages WHERE page_id + 900 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'no such document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    # Documents without a label, and declared ids (labels and shifted pages) without a document.
    declared = t.labels.select("doc_id")
    pages = t.pages.select((F.col("page_id") + 900).alias("doc_id"))
    return audit.manifest_gaps(t.texts, declared, "doc_id").unionByName(
        audit.manifest_gaps(t.texts, pages, "doc_id").filter("reason = 'no such document'"))


@query("manifest_audit", "D2", """SELECT doc_id, 'not in manifest' AS reason FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT doc_id, 'missing version' FROM documents WHERE doc_id % 30 <> 0 AND doc_id % 4 = 0
UNION ALL SELECT doc_id, 'missing notes' FROM documents WHERE doc_id % 30 <> 0 AND doc_id % 9 = 0
UNION ALL SELECT doc_id, 'synthetic not disclosed' FROM documents WHERE doc_id % 30 <> 0 AND source = 'src3' AND (doc_id % 9 = 0 OR doc_id % 2 = 0)""")
def _(t):
    ident = F.col("doc_id")
    manifest = t.texts.filter(ident % 30 != 0).select(
        "doc_id", F.when(F.col("source") == "src3", "synthetic").otherwise("published").alias("provenance"), F.when(ident % 4 != 0, "1.0").otherwise(" ").alias("version"),
        F.when(ident % 9 == 0, None).when(ident % 2 == 0, "as found").otherwise("a Prototype text").alias("notes"))
    return audit.audit_manifest(manifest, t.texts, "doc_id", ["version", "notes"])


@query("eval_set_audit", "D3", """WITH items AS (SELECT d.doc_id AS item_id, list_distinct([d.doc_id, d.doc_id // 2]) AS topics, [left(d.text, 8), CASE WHEN d.doc_id % 5 = 0 THEN 'qqqq' ELSE replace(right(d.text, 6), 'e', 'E') END] AS keywords FROM documents d),
k AS (SELECT item_id, unnest(keywords) AS keyword FROM items), b AS (SELECT item_id, lower(text) AS body FROM (SELECT item_id, unnest(topics) AS doc_id FROM items) JOIN documents USING (doc_id)),
p AS (SELECT k.item_id, keyword, max(contains(body, lower(keyword))) AS present FROM k LEFT JOIN b ON b.item_id = k.item_id GROUP BY 1, 2)
SELECT i.item_id, CAST(length(topics) AS INTEGER) AS hops, (SELECT coalesce(string_agg(keyword, '|' ORDER BY keyword), '') FROM p WHERE p.item_id = i.item_id AND NOT coalesce(present, false)) AS absent FROM items i""")
def _(t):
    ident = F.col("doc_id")
    items = t.texts.select(
        ident.alias("item_id"), F.array_distinct(F.array(ident, F.floor(ident / 2))).alias("topics"),
        F.array(F.left("text", F.lit(8)), F.when(ident % 5 == 0, "qqqq").otherwise(F.replace(F.right("text", F.lit(6)), F.lit("e"), F.lit("E")))).alias("keywords"))
    return audit.audit_eval_set(items, t.texts).withColumn("absent", F.array_join("absent", "|"))


@query("dataset_profile", "A14", f"""WITH n AS (SELECT length(regexp_extract_all(text, '\\S+')) AS n, lower({q.strip('text')}) AS k FROM documents)
SELECT count(*) AS rows, round(avg(n), 4) AS mean_words, CAST(min(n) AS INTEGER) AS min_words, CAST(max(n) AS INTEGER) AS max_words, count(*) - count(DISTINCT k) AS duplicates FROM n""")
def _(t):
    return audit.describe_dataset(t.texts)


@query("train_overlap", "D6", f"""WITH k AS (SELECT doc_id, lang, regexp_replace(lower({q.strip('text')}), '\\s+', ' ', 'g') AS k FROM documents),
a AS (SELECT k, count(*) AS n FROM k WHERE doc_id % 2 = 0 GROUP BY 1), z AS (SELECT k, count(*) AS n FROM k WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT k AS norm_key, a.n AS left_rows, z.n AS right_rows FROM a JOIN z USING (k)""")
def _(t):
    return audit.overlap(t.texts.filter("doc_id % 2 = 0"), t.texts.filter("doc_id % 2 = 1"))


# Whole passages, and the first half of each that has two words or more: a document may hold either.
@query("containing_documents", "D1 D3", """WITH w AS (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark),
p AS (SELECT item_id, 'whole' AS part, w FROM w UNION ALL SELECT item_id, 'half', w[1:length(w) // 2] FROM w)
SELECT DISTINCT item_id, part, doc_id FROM p JOIN documents d
  ON contains(' ' || array_to_string(regexp_extract_all(d.text, '\\S+'), ' ') || ' ', ' ' || array_to_string(w, ' ') || ' ') WHERE length(w) > 0""")
def _(t):
    words = audit.sql_words(F.col("text"))
    half = F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int"))
    passages = t.benchmark.select(F.explode(F.array(
        F.struct(F.struct("item_id", F.lit("whole").alias("part")).alias("passage_id"), F.col("text")),
        F.struct(F.struct("item_id", F.lit("half").alias("part")).alias("passage_id"), F.array_join(half, " ").alias("text")))).alias("p")).select("p.*")
    return audit.containing_documents(passages, "passage_id", t.texts, "doc_id", 8).select("passage_id.item_id", "passage_id.part", "doc_id")


# Lines of the documents as passages: short ones, and many that several documents share.
@query("repeated_lines", "D1 D3", """WITH l AS (SELECT DISTINCT array_to_string(w, ' ') AS line FROM (SELECT regexp_extract_all(unnest(string_split(text, chr(10))), '\\S+') AS w FROM documents)
    WHERE length(w) BETWEEN 1 AND 12)
SELECT DISTINCT line, doc_id FROM l JOIN documents d ON contains(' ' || array_to_string(regexp_extract_all(d.text, '\\S+'), ' ') || ' ', ' ' || line || ' ')""")
def _(t):
    words = audit.sql_words(F.col("line"))
    lines = t.texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.size(words).between(1, 12)).select(
        F.array_join(words, " ").alias("line")).distinct()
    return audit.containing_documents(lines.select("line", F.col("line").alias("text")), "line", t.texts, "doc_id", 8)


GRAMMAR = """pool AS (SELECT 'Where  is my ' || p_name || ' in ' || n_name || '?' AS text, 'calm' AS label FROM (SELECT DISTINCT p_name FROM part), nation
  UNION SELECT p_name || ' lost in ' || r_name || ' by ' || n_name || '!', 'upset' FROM (SELECT DISTINCT p_name FROM part), region, nation),
spelt AS (SELECT label, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM pool),
flat AS (SELECT label, arg_min(text, md5('7' || text) || text) AS text FROM spelt GROUP BY label, lower(text))"""


def templates(t):
    # One template per label, read off the region table so that nothing is made up on the driver.
    return t.region.select(F.explode(F.array(
        F.struct(F.lit("calm").alias("label"), F.lit("Where  is my {part} in {nation}?").alias("template")),
        F.struct(F.lit("upset").alias("label"), F.lit("{part} lost in {region} by {nation}!").alias("template")))).alias("r")).select("r.*").distinct()


@query("expanded_grammar", "D4", f"""WITH {GRAMMAR} SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5('7' || text), text) AS place FROM flat
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7' || text), text) <= 500""")
def _(t):
    pools = {"part": t.part.select("p_name").distinct(), "nation": t.nation.select("n_name"), "region": t.region.select("r_name")}
    return audit.expand_grammar(templates(t), pools, 500, "7").withColumn("place", F.col("place").cast("bigint"))


@query("grammar_size", "D5", """SELECT 'calm' AS label, 'Where  is my {part} in {nation}?' AS template, (SELECT count(DISTINCT p_name) FROM part) * (SELECT count(*) FROM nation) AS size
UNION ALL SELECT 'upset', '{part} lost in {region} by {nation}!', (SELECT count(DISTINCT p_name) FROM part) * (SELECT count(*) FROM nation) * (SELECT count(*) FROM region)""")
def _(t):
    sizes = {"part": t.part.select("p_name").distinct().count(), "nation": t.nation.count(), "region": t.region.count()}
    return audit.pool_size(templates(t), sizes)
