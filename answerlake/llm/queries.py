"""One query for each operator of this subpackage, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.llm.conversation_trie import rebuilt_trie
from answerlake.llm.decontaminate import contamination
from answerlake.llm.fingerprints import LEAST_SHARE, LIMITS, MOST_SHARE, SUBSETS, fingerprints
from answerlake.llm.html import extract
from answerlake.llm.idfiles import document_digests, read_ids, write_ids
from answerlake.llm.jaccard import jaccard_components
from answerlake.llm.languages import learn_languages, predicted
from answerlake.llm.packing import best_two_fit
from answerlake.llm.pseudo_likelihood import pseudo_likelihood
from answerlake.llm.repair import damaged, repaired
from answerlake.llm.shared import shared_path
from answerlake.llm.simhash import simhash_components
from answerlake.llm.substrings import without_repeats
from answerlake.llm.toxicity import learn_grammar, scored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), ("page_id", "url"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 90 * greatest(a.n, b.n) <= 100 * least(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS node, a AS other FROM ends UNION SELECT node, b FROM reach JOIN ends ON other = a),
named AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(coalesce(component, doc_id) AS BIGINT) AS component_id
FROM sets LEFT JOIN named ON node = doc_id
"""

def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), ("doc_id",), digest=True)


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS seq FROM words, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, unnest(range(0, 20)) AS t(j)),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
marked AS (SELECT f.doc_id, f.word, f.pos, g.pos IS NOT NULL AS removed FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos),
counted AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(c.kept, '')) AS kept_sha256
FROM words w LEFT JOIN counted c ON c.doc_id = w.doc_id
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS seq, least(10, len(w)) AS n
  FROM items, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS seq FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT p.doc_id, p.i, p.n, x.item FROM places p JOIN windows x ON x.n = p.n AND x.seq = p.seq),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id LEFT JOIN named m ON m.doc_id = w.doc_id
"""

TOXIC_FROM = 0.7


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = learn_grammar(documents, labels.filter(fold("doc_id", 3) != 1))
    found = scored(documents.select("doc_id", "text"), grammar)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op6_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return document_digests(read_ids(spark, path, keep_ids=False).drop("ids"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn_languages(documents.filter(fold("doc_id", 4) != 2))
    found = predicted(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "proportions")


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, keep_ids=False).drop("ids")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
    lead(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text) AS later, first_value(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, text) AS head
  FROM documents),
edited AS (
  SELECT doc_id, text, n_chars, coalesce(later, head) AS next_text,
    left(text, CAST(n_chars - n_chars // 4 AS BIGINT)) || left(coalesce(later, head), CAST(n_chars // 4 AS BIGINT)) AS edited FROM rows),
texts AS (SELECT text AS x FROM edited UNION SELECT edited FROM edited),
words AS (
  SELECT x, list_distinct(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM texts),
counts AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM edited JOIN words ON x = text) GROUP BY term),
lexicon AS (
  SELECT term FROM counts, (SELECT count(*) AS n FROM documents)
  WHERE df >= greatest(2.0, {LEAST_SHARE}::DOUBLE * n) AND df <= {MOST_SHARE}::DOUBLE * n),
kept AS (
  SELECT x, list(md5(t) || t ORDER BY t) AS k FROM (SELECT x, unnest(w) AS t FROM words) WHERE t IN (SELECT term FROM lexicon) GROUP BY x),
prints AS (
  SELECT w.x, list_transform(range(1, {SUBSETS} + 1), lambda i: CASE WHEN k IS NULL THEN substr(md5(array_to_string(list_sort(w.w), ' ')), 1, 8)
      WHEN len(list_filter(k, lambda m: substr(m, i, 2) < substr('{LIMITS}', 2 * i - 1, 2))) = 0 THEN ''
      ELSE substr(md5(array_to_string(list_filter(k, lambda m: substr(m, i, 2) < substr('{LIMITS}', 2 * i - 1, 2)), ' ')), 1, 8) END) AS h
  FROM words w LEFT JOIN kept USING (x)),
joined AS (
  SELECT e.doc_id, e.n_chars, e.edited, a.h AS a, b.h AS b, c.h AS c
  FROM edited e JOIN prints a ON a.x = e.text JOIN prints b ON b.x = e.edited JOIN prints c ON c.x = e.next_text)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  array_to_string(list_transform(a, lambda v: CASE WHEN v = '' THEN '--------' ELSE v END), '') AS fingerprint,
  array_to_string(list_transform(b, lambda v: CASE WHEN v = '' THEN '--------' ELSE v END), '') AS edited_fingerprint,
  coalesce(len(list_filter(range(1, {SUBSETS} + 1), lambda i: a[i] <> '' AND a[i] = b[i]))::DOUBLE
    / nullif(len(list_filter(range(1, {SUBSETS} + 1), lambda i: a[i] <> '' OR b[i] <> '')), 0), 0.0) AS near_edited,
  coalesce(len(list_filter(range(1, {SUBSETS} + 1), lambda i: a[i] <> '' AND a[i] = c[i]))::DOUBLE
    / nullif(len(list_filter(range(1, {SUBSETS} + 1), lambda i: a[i] <> '' OR c[i] <> '')), 0), 0.0) AS near_next
FROM joined
"""



def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda z: ord(z)::BIGINT), lambda a, b: {byte}))"


OP11_SQL = rf"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inked, left(role, 1) AS w FROM rows),
coded AS (
  SELECT conv_id, turn, role, text, w, i, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN inked = '' THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(inked, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(w) OVER (PARTITION BY conv_id ORDER BY i) || w AS pair FROM placed),
ways AS (
  SELECT conv_id, n + 1 AS i, [{{c: 0, a: '', r: ''}}, {{c: 4, a: 'II', r: chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{c: 2, a: 'I', r: chr(10) || 'assistant:'}}, {{c: 0, a: '', r: ''}}] AS v
  FROM (SELECT DISTINCT conv_id, n FROM coded)
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda s: list_sort([o[s],
    {{c: o[CASE s WHEN 3 THEN 4 ELSE 3 END].c + 2, a: 'I' || o[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
      r: chr(10) || CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || o[CASE s WHEN 3 THEN 4 ELSE 3 END].r}},
    {{c: o[CASE s WHEN 3 THEN 3 ELSE 4 END].c + 4, a: 'II' || o[CASE s WHEN 3 THEN 3 ELSE 4 END].a,
      r: chr(10) || CASE s WHEN 3 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || o[CASE s WHEN 3 THEN 3 ELSE 4 END].r}}])[1]) AS v
  FROM (
    SELECT x.conv_id, x.i, list_transform([1, 2, 3, 4], lambda s: list_sort(
      [{{c: v[s].c + 3, a: 'D' || v[s].a, r: v[s].r}}]
      || CASE WHEN fault IN ('b', 'd') THEN [] ELSE
        CASE WHEN s = 1 AND w = 's' THEN [{{c: v[2].c + CASE fault WHEN 't' THEN 1 ELSE 0 END, a: 'K' || v[2].a, r: chr(10) || role || ':' || text || v[2].r}}] ELSE [] END
        || [CASE WHEN w = CASE s WHEN 3 THEN 'a' ELSE 'u' END
          THEN {{c: v[CASE s WHEN 3 THEN 4 ELSE 3 END].c + CASE fault WHEN 't' THEN 1 ELSE 0 END, a: 'K' || v[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
            r: chr(10) || role || ':' || text || v[CASE s WHEN 3 THEN 4 ELSE 3 END].r}}
          ELSE {{c: v[CASE s WHEN 3 THEN 4 ELSE 3 END].c + CASE fault WHEN 't' THEN 3 ELSE 2 END, a: 'R' || v[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
            r: chr(10) || CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || text || v[CASE s WHEN 3 THEN 4 ELSE 3 END].r}} END] END)[1]) AS o
    FROM ways y JOIN coded x ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i - 1)),
best AS (SELECT conv_id, v[1] AS b FROM ways WHERE i = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
  coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = rf"""
WITH units AS (
  SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, b) AS place FROM units),
convs AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM units)),
turns AS (
  SELECT c.conv_id, p.place, p.k, p.b FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.place <= c.h
  UNION ALL SELECT c.conv_id, p.place, p.k, p.b FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h),
paths AS (
  SELECT c.conv_id, coalesce(list(k || '-' || b ORDER BY place) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(b ORDER BY place) FILTER (k IS NOT NULL), []) AS bs
  FROM convs c LEFT JOIN turns t ON t.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (
  SELECT conv_id, d, array_to_string(ks[1:d], '/') AS node, CASE WHEN d = 0 THEN NULL ELSE array_to_string(ks[1:d - 1], '/') END AS parent,
    CASE WHEN d = 0 THEN 0 ELSE bs[d] END AS b, len(ks) = d AS ends, ks[1:d] AS path FROM paths, unnest(range(0, len(ks) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, parent, any_value(path) AS path, min(conv_id) AS low, count(*) AS n, (count(*) - 1) * any_value(b) AS saved,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ids FROM members GROUP BY node, d, parent),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent, d),
sums AS (
  SELECT array_to_string(path[1:e], '/') AS node, e AS d, sum(saved) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM nodes LEFT JOIN kids k USING (node, d), unnest(range(0, nodes.d + 1)) AS t(e) GROUP BY 1, 2)
SELECT v.low AS conv_id, CAST(v.d AS BIGINT) AS depth, p.low AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM nodes v JOIN sums s ON s.node = v.node AND s.d = v.d LEFT JOIN kids k ON k.node = v.node AND k.d = v.d
LEFT JOIN nodes p ON p.node = v.parent AND p.d = v.d - 1
"""


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_id_files": op6_token_id_files,
    "op7_language_id": op7_language_id,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_best_two_fit_packing": op9_best_two_fit_packing,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

ORACLES = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op10_document_fingerprints": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_conversation_trie": OP12_SQL,
}
