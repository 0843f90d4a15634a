"""Corpus and retrieval queries: benchmark questions against the documents."""

from pyspark.sql import functions as F

from answerlake.catalog import sqlparts as q
from answerlake.catalog.registry import query
from answerlake.catalog.sqlparts import CORPUS
from answerlake.functions import text as x
from answerlake.plans import corpus, retrieval
from answerlake.session import settle

HEADING = r"[^\n]{1,40}"       # in the test corpus a short line stands for a heading
HEAD_SQL = "(?m)^([^\\n]{1,40})$"
DIMS = 64

# ------------------------------------------------------------------- corpus

IS_HEAD = "regexp_matches(p, '^[^\\n]{1,40}(\\n|$)')"
FIRST_LINE = f"{q.strip('split_part(p, chr(10), 1)')}"
REST = f"CASE WHEN contains(p, chr(10)) THEN {q.strip('substr(p, instr(p, chr(10)) + 1)')} ELSE '' END"


def chunks_sql(size=500, overlap=50):
    step = size - overlap
    return f"""parts AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS name, whole, list_filter(list_transform(string_split(
     regexp_replace(whole, '{HEAD_SQL}', chr(1) || '\\1', 'g'), chr(1)), lambda p: {q.strip('p')}), lambda p: length(p) > 0) AS ps
  FROM (SELECT doc_id, source, {q.strip('text')} AS whole FROM documents) WHERE length(whole) > 0),
marked AS (SELECT *, length(list_filter(ps, lambda p: {IS_HEAD})) > 0 AS headed,
   length(list_filter(ps[1:1], lambda p: {IS_HEAD})) > 0 AS starts_headed FROM parts),
titled AS (SELECT *, CASE WHEN NOT headed OR starts_headed THEN name ELSE list_transform(ps[1:1], lambda p: {FIRST_LINE})[1] END AS doc_title FROM marked),
secs AS (SELECT doc_id, source, doc_title, CASE WHEN NOT headed THEN [{{'section': name, 'body': whole}}] ELSE list_filter(list_concat(
   CASE WHEN starts_headed THEN [] ELSE list_transform(ps[1:1], lambda p: {{'section': doc_title, 'body': {REST}}}) END,
   list_transform(list_filter(ps, lambda p: {IS_HEAD}), lambda p: {{'section': {FIRST_LINE}, 'body': {REST}}})),
   lambda z: length(z.body) > 0) END AS ss FROM titled),
sec AS (SELECT doc_id, source, doc_title, sec_no, ss[sec_no].section AS section, regexp_extract_all(ss[sec_no].body, '\\S+') AS items
  FROM (SELECT *, unnest(range(1, length(ss) + 1)) AS sec_no FROM secs)),
win AS (SELECT *, unnest(range(0, CASE WHEN length(items) = 0 THEN 0 WHEN length(items) <= {size} THEN 1
   ELSE CAST(ceil((length(items) - {size}) / {float(step)}) AS BIGINT) + 1 END)) AS win_no FROM sec),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, win_no) - 1 AS chunk_no,
   array_to_string(items[win_no * {step} + 1 : win_no * {step} + {size}], ' ') AS text FROM win),
chunks AS (SELECT CAST(doc_id AS VARCHAR) || '::' || CAST(chunk_no AS VARCHAR) AS chunk_id, doc_id, chunk_no, source, doc_title, section, text,
   doc_title || ' ' || section || ' ' || text AS search_text FROM numbered)"""


def chunks(t):
    return corpus.chunk(t.documents, HEADING)


def index(t):
    # Stored once, as an index is: chunking and encoding are not repeated per join.
    return settle(corpus.embed(chunks(t), "search_text", dims=DIMS))


def questions(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query("corpus_scan", "S1", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def _(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


@query("section_split", "T11", f"""WITH {chunks_sql()}
SELECT doc_id, doc_title, section, CAST(sec_no - 1 AS BIGINT) AS section_no, CAST(length(items) AS BIGINT) AS words FROM sec""")
def _(t):
    cut = t.documents.select("doc_id", F.posexplode(corpus.sections(
        F.col("text"), F.col("doc_id").cast("string"), HEADING)).alias("section_no", "s"))
    return cut.select("doc_id", "s.doc_title", "s.section", F.col("section_no").cast("bigint").alias("section_no"),
                      F.size(x.words(F.col("s.body"))).cast("bigint").alias("words"))


@query("chunks", "R1 T10 T11", f"""WITH {chunks_sql(100, 20)}
SELECT chunk_id, doc_id, chunk_no, source, doc_title, section, text, search_text FROM chunks""")
def _(t):
    return corpus.chunk(t.documents, HEADING, 100, 20).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


@query("knowledge_base", "A7 W11", f"""WITH {chunks_sql(100, 20)}, m AS (SELECT *, CASE WHEN lag(section) OVER w = section THEN 0 ELSE 1 END AS c
  FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no)),
i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS island FROM m)
SELECT doc_id, CAST(island AS BIGINT) AS island, any_value(section) AS section, count(*) AS chunks,
  string_agg(text, ' ' ORDER BY chunk_no) AS text FROM i GROUP BY doc_id, island""")
def _(t):
    return corpus.knowledge_base(corpus.chunk(t.documents, HEADING, 100, 20))


@query("index_stats", "A6", f"""WITH {chunks_sql()}
SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM chunks GROUP BY source
UNION ALL SELECT 'all', count(DISTINCT doc_id), count(*) FROM chunks""")
def _(t):
    return corpus.index_stats(chunks(t)).drop("dimensions")


POSTINGS = f"""toks AS (SELECT chunk_id, {q.tokens('search_text')} AS toks FROM chunks),
postings AS (SELECT chunk_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM (
  SELECT chunk_id, length(toks) AS doc_len, unnest(toks) AS term FROM toks) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(length(toks)) AS avg_len FROM toks),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1)"""


@query("postings", "R2", f"""WITH {chunks_sql()}, {POSTINGS}
SELECT chunk_id, term, tf, CAST(doc_len AS BIGINT) AS doc_len FROM postings""")
def _(t):
    return corpus.build_postings(corpus.term_table(chunks(t), CORPUS))


@query("corpus_stats", "A16", f"""WITH {chunks_sql()}, {POSTINGS}
SELECT n AS chunks, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM df) AS terms FROM stats""")
def _(t):
    base = chunks(t)
    terms = corpus.vocabulary(base, CORPUS, "search_text").agg(F.count(F.lit(1)).alias("terms")).scalar()
    return corpus.corpus_stats(corpus.term_table(base, CORPUS)).select(
        "chunks", F.round("avg_len", 6).alias("avg_len"), terms.alias("terms"))


@query("document_frequency", "A16", f"WITH {chunks_sql()}, {POSTINGS} SELECT term, df FROM df")
def _(t):
    return corpus.document_frequency(corpus.build_postings(corpus.term_table(chunks(t), CORPUS)))


@query("corpus_vocabulary", "A15", f"SELECT DISTINCT unnest({q.tokens('text')}) AS term FROM documents")
def _(t):
    return corpus.vocabulary(t.documents, CORPUS)


@query("index_staleness", "R6", f"""WITH {chunks_sql()}, g AS (SELECT doc_id % 3 = 0 AS old FROM chunks)
SELECT CAST(sum(CASE WHEN old THEN 1 ELSE 0 END) AS BIGINT) AS stale_vectors, count(*) AS vectors, bool_or(old) AS stale FROM g""")
def _(t):
    older = F.when(F.col("doc_id") % 3 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return corpus.index_is_stale(index(t).withColumn("embedding", older), DIMS)


# ------------------------------------------------------------------ retrieval

ASKED = f"""asked AS (SELECT item_id AS query_id, {q.expand('toks')} AS qtoks FROM (SELECT item_id, {q.tokens('text')} AS toks FROM benchmark)),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(qtoks) AS term FROM asked) GROUP BY 1, 2)"""
LEXICAL = """lex AS (SELECT query_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5
  / (tf + 1.5 * (0.25 + 0.75 * doc_len / avg_len))) AS lexical
  FROM postings JOIN qterms USING (term) JOIN df USING (term), stats GROUP BY 1, 2)"""


def lexical(t):
    terms = settle(corpus.term_table(chunks(t), CORPUS))
    return retrieval.bm25(questions(t), terms, corpus.corpus_stats(terms), CORPUS)


@query("bm25_scores", "R3 J9", f"""WITH {chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL}
SELECT query_id, chunk_id, round(lexical, 5) AS lexical FROM lex""")
def _(t):
    return lexical(t).select("query_id", "chunk_id", F.round("lexical", 5).alias("lexical"))


@query("bm25_top_k", "R3 W4 J9", f"""WITH {chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL}
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, round(lexical, 4) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 4) DESC, chunk_id) AS rank FROM lex) WHERE rank <= 10""")
def _(t):
    scored = lexical(t).select("query_id", "chunk_id", F.round("lexical", 4).alias("score"))
    return retrieval.top_k(scored, 10, "score", ["chunk_id"])


@query("minmax_scores", "W5", f"""WITH {chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL},
ends AS (SELECT query_id, CASE WHEN count(*) < (SELECT n FROM stats) THEN least(min(lexical), 0) ELSE min(lexical) END AS lo,
  greatest(max(lexical), 0) AS hi FROM lex GROUP BY 1)
SELECT query_id, chunk_id, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE (lexical - lo) / (hi - lo) END, 5) AS normalised FROM lex JOIN ends USING (query_id)""")
def _(t):
    total = chunks(t).agg(F.count(F.lit(1)).alias("n")).scalar()
    return retrieval.minmax_over(lexical(t), "lexical", total).select(
        "query_id", "chunk_id", F.round("normalised", 5).alias("normalised"))


@query("label_centroid_neighbours", "J10 R5", """WITH d AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(v) AS m FROM d GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT CAST(c.label AS BIGINT) AS query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), cv), 6) AS dense FROM embeddings CROSS JOIN c)
SELECT query_id, vec_id, dense, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) <= 10""")
def _(t):
    # One query vector per label: the mean of its vectors.
    mean = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(
        F.avg(F.col("v").cast("double")).alias("m"))
    centroids = mean.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    return retrieval.dense_top_k(centroids, t.embeddings.select("vec_id", "embedding"), 10)


HITS_SQL = """vec AS (SELECT kind, id, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY kind, id)) AS w FROM (
  SELECT kind, id, ('0x' || substr(code, 1, 8))::BIGINT % 64 AS bucket,
    sum(CASE WHEN ('0x' || substr(code, 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS raw FROM (
    SELECT 'c' AS kind, chunk_id AS id, sha256(unnest(regexp_extract_all(lower(search_text), '[a-zA-Z0-9'']+'))) AS code FROM chunks
    UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), sha256(unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9'']+'))) FROM benchmark)
  GROUP BY 1, 2, 3) WHERE raw <> 0),
cos AS (SELECT CAST(a.id AS BIGINT) AS query_id, c.id AS chunk_id, sum(a.w * c.w) AS dense FROM vec a JOIN vec c ON a.bucket = c.bucket
  WHERE a.kind = 'q' AND c.kind = 'c' GROUP BY 1, 2),
pairs AS (SELECT query_id, c.chunk_id, c.doc_id, c.chunk_no, qtoks, coalesce(lexical, 0) AS lexical, coalesce(dense, 0) AS dense
  FROM asked CROSS JOIN chunks c LEFT JOIN lex USING (query_id, chunk_id) LEFT JOIN cos USING (query_id, chunk_id)),
ends AS (SELECT query_id, min(lexical) AS ll, max(lexical) AS lh, min(dense) AS dl, max(dense) AS dh FROM pairs GROUP BY 1),
heads AS (SELECT chunk_id, {heads} AS ht FROM (SELECT chunk_id, {head_tokens} AS toks FROM chunks)),
boosted AS (SELECT p.*, (0.6 * CASE WHEN lh - ll < 1e-9 THEN 0 ELSE (lexical - ll) / (lh - ll) END
     + 0.4 * CASE WHEN dh - dl < 1e-9 THEN 0 ELSE (dense - dl) / (dh - dl) END)
   * CASE WHEN length(qtoks) = 0 OR length(ht) = 0 THEN 1 ELSE
     1 + 0.9 * power(length(list_intersect(qtoks, ht)) / length(list_distinct(qtoks)), 2) END AS raw
  FROM pairs p JOIN ends USING (query_id) JOIN heads USING (chunk_id)),
scored AS (SELECT query_id, chunk_id, doc_id, chunk_no, round(raw, 4) AS score, round(lexical, 4) AS lexical_score, round(dense, 4) AS dense_score FROM boosted),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_no) AS rank FROM scored) WHERE rank <= 15)""".replace(
    "{heads}", q.expand("toks")).replace("{head_tokens}", q.tokens("(section || ' ' || doc_title)"))
SEARCH = f"{chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL}, {HITS_SQL}"


def mmr_sql(k=4, lam=0.8):
    """Greedy selection unrolled: one step per rank."""
    out = [f"""sims AS (SELECT a.query_id, a.rank AS ra, b.rank AS rb, CASE WHEN a.rank = b.rank THEN 1.0 ELSE coalesce(sum(u.w * v.w), 0) END AS sim,
    any_value(a.doc_id = b.doc_id) AS same FROM pool a JOIN pool b USING (query_id)
  LEFT JOIN vec u ON u.kind = 'c' AND u.id = a.chunk_id LEFT JOIN vec v ON v.kind = 'c' AND v.id = b.chunk_id AND v.bucket = u.bucket
  GROUP BY 1, 2, 3),
rel AS (SELECT query_id, rank, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS rel FROM pool),
pick1 AS (SELECT query_id, [1] AS chosen FROM pool WHERE rank = 1)"""]
    for i in range(2, k + 1):
        out.append(f"""pick{i} AS (SELECT query_id, list_append(chosen, rank) AS chosen FROM (
  SELECT p.query_id, p.chosen, r.rank, row_number() OVER (PARTITION BY p.query_id ORDER BY
     round({lam} * any_value(r.rel) - (1 - {lam}) * greatest(max(s.sim), CASE WHEN sum(CASE WHEN s.same THEN 1 ELSE 0 END) > 0
       THEN least(1.0, 0.6 + 0.3 * (sum(CASE WHEN s.same THEN 1 ELSE 0 END) - 1)) ELSE 0 END), 10) DESC, r.rank) AS best
  FROM pick{i - 1} p JOIN rel r ON r.query_id = p.query_id AND NOT list_contains(p.chosen, r.rank)
  JOIN sims s ON s.query_id = p.query_id AND s.ra = r.rank AND list_contains(p.chosen, s.rb)
  GROUP BY p.query_id, p.chosen, r.rank) WHERE best = 1)""")
    out.append(f"""picked AS (SELECT p.query_id, i AS step, o.chunk_id, o.doc_id, o.score, o.lexical_score, o.dense_score FROM (
    SELECT query_id, chosen, unnest(range(1, {k} + 1)) AS i FROM pick{k}) p JOIN pool o ON o.query_id = p.query_id AND o.rank = p.chosen[p.i]),
hits AS (SELECT query_id, chunk_id, doc_id, score, lexical_score, dense_score,
   CAST(row_number() OVER (PARTITION BY query_id ORDER BY step) AS INTEGER) AS rank FROM (
   SELECT *, max(CASE WHEN step = 1 THEN lexical_score END) OVER (PARTITION BY query_id) AS first_lex FROM picked)
  WHERE first_lex <= 0 OR lexical_score > 0)""")
    return ", ".join(out)


CONFIG = retrieval.SearchConfig(vocab=CORPUS, dims=DIMS)
HIT_COLUMNS = ("query_id", "rank", "chunk_id", "doc_id", "score", "lexical_score", "dense_score")


@query("candidate_pool", "R7 R8 R11 W4", f"""WITH {SEARCH}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, doc_id, score, lexical_score, dense_score FROM pool""")
def _(t):
    return retrieval.candidate_pool(questions(t), index(t), CONFIG).select(*HIT_COLUMNS)


@query("hybrid_search", "R13 R14 R15", f"""WITH {SEARCH}, {mmr_sql()}
SELECT query_id, rank, chunk_id, doc_id, score, lexical_score, dense_score FROM hits""")
def _(t):
    return retrieval.search(questions(t), index(t), CONFIG).select(*HIT_COLUMNS)


# ------------------------------------------------- penalties and compound questions

def penalty_vocabulary():
    from answerlake.catalog.texts import PLACES
    return PLACES


ROUTE_WORDS = "(?i)domestic|routes"
KIND_RULES = [("hand", "(?i)tionti"), ("checked", "(?i)anan|inging")]


def kind_of(col):
    """The first kind a text names; the same rule reads questions and headings."""
    return F.when(col.rlike(KIND_RULES[0][1]), "hand").when(col.rlike(KIND_RULES[1][1]), "checked")


def sql_kind(x_):
    return f"CASE WHEN regexp_matches({x_}, '{KIND_RULES[0][1]}') THEN 'hand' WHEN regexp_matches({x_}, '{KIND_RULES[1][1]}') THEN 'checked' END"


PENALISED = retrieval.SearchConfig(
    vocab=CORPUS, dims=DIMS, use_places=True, route_words=ROUTE_WORDS, query_kind=kind_of,
    chunk_kind=lambda index: kind_of(F.col("section")),
    topic_rules=((lambda text: text.rlike("(?i)erth"), lambda index: F.col("section").rlike("(?i)en")),))

NAMED_PLACES = "list_distinct(list_transform(regexp_extract_all(lower({0}), 'nation_[0-9]+|asia minor|asia|europe|old world|(?:^|[^\\p{{L}}\\p{{N}}_])via n3'), lambda p: CASE WHEN p = 'old world' THEN 'europe' WHEN contains(p, 'via n3') THEN 'n3' ELSE p END))"


def places_sql(x_):
    """Canonical places of a text; lower-case n3 and Asia Minor are not places."""
    found = NAMED_PLACES.format(x_)
    code = f"CASE WHEN contains({x_}, 'via N3') THEN ['nation_3'] ELSE []::VARCHAR[] END"
    return f"list_distinct(list_concat(list_filter({found}, lambda p: p NOT IN ('asia minor', 'n3')), {code}))"


ASKED_PLACES = "text || CASE WHEN item_id % 2 = 0 THEN ' from NATION_' || CAST(item_id % 25 AS VARCHAR) || CASE WHEN item_id % 4 = 0 THEN ' to Asia' ELSE '' END WHEN item_id % 5 = 0 THEN ' routes' ELSE '' END"


def place_questions(t):
    item = F.col("item_id")
    return t.benchmark.select(item.alias("query_id"), F.concat(
        "text", F.when(item % 2 == 0, F.concat(F.lit(" from NATION_"), (item % 25).cast("string"), F.when(item % 4 == 0, " to Asia").otherwise("")))
        .when(item % 5 == 0, " routes").otherwise("")).alias("text"))


def penalised_sql():
    from answerlake.catalog.texts import NAMED
    docs = f"docs AS (SELECT n.doc_id, n.text, d.source FROM {NAMED} n JOIN documents d USING (doc_id)), bench AS (SELECT item_id, {ASKED_PLACES} AS text FROM benchmark)"
    body = f"{chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL}, {HITS_SQL}".replace("FROM documents", "FROM docs").replace("FROM benchmark", "FROM bench")
    head, tail = body.split("scored AS (", 1)
    pool = tail[tail.index("pool AS ("):]
    region = "['africa', 'america', 'asia', 'europe', 'middle east'][TRY_CAST(substr(p, 8) AS INTEGER) % 5 + 1]"
    return f"""WITH {docs}, {head} cp AS (SELECT chunk_id, {places_sql('text')} AS stated, {sql_kind('section')} AS have, regexp_matches(section, '(?i)en') AS near FROM chunks),
qp AS (SELECT item_id AS query_id, {places_sql('text')} AS want_places, regexp_matches(text, '{ROUTE_WORDS}') AS routes, {sql_kind('text')} AS want, regexp_matches(text, '(?i)erth') AS topic FROM bench),
flags AS (SELECT b.*, length(list_filter(stated, lambda p: starts_with(p, 'nation_'))) >= 2 AS listing, length(list_filter(want_places, lambda p: NOT (list_contains(stated, p)
    OR (starts_with(p, 'nation_') AND list_contains(stated, {region}))))) > 0 AS missing, length(want_places) > 0 OR routes AS named, want, have, topic AND near AS neighbour
  FROM boosted b JOIN cp USING (chunk_id) JOIN qp USING (query_id)),
scored AS (SELECT query_id, chunk_id, doc_id, chunk_no, listing AND missing AS route_mismatch, listing AND NOT named AS route_unasked,
   coalesce(want <> have, false) AS kind_mismatch, neighbour AS topic_mismatch,
   round(raw * CASE WHEN listing AND missing THEN 0.75 WHEN listing AND NOT named THEN 0.85 ELSE 1 END * CASE WHEN coalesce(want <> have, false) THEN 0.35 ELSE 1 END
     * CASE WHEN neighbour THEN 0.35 ELSE 1 END, 4) AS score FROM flags), {pool}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score, route_mismatch, route_unasked, kind_mismatch, topic_mismatch FROM pool"""


@query("penalised_pool", "R9 R10 T20", penalised_sql())
def _(t):
    from answerlake.catalog.texts import named
    docs = named(t).join(t.documents.select("doc_id", "source"), "doc_id")
    base = settle(corpus.embed(corpus.chunk(docs, HEADING), "search_text", dims=DIMS))
    return retrieval.candidate_pool(place_questions(t), base, PENALISED.with_(vocab=penalty_vocabulary())).select(
        "query_id", "rank", "chunk_id", "score", "route_mismatch", "route_unasked", "kind_mismatch", "topic_mismatch")


FUSION = 0.9
COMPOUND = "text || ' What of the ' || right(text, 40) || ' and how the ' || left(text, 30) || '?'"


def fused_sql():
    from answerlake.catalog.texts import INTERROGATIVE, PART_OPENER, TRIM_PART
    bench = f"""c0 AS (SELECT item_id, {q.strip(COMPOUND)} AS text FROM benchmark), c1 AS (SELECT *, {q.clauses('text')} AS parts FROM c0),
c2 AS (SELECT *, list_max(list_filter(list_transform(range(1, length(parts) + 1), lambda i: CASE WHEN regexp_matches(parts[i], '{INTERROGATIVE}') THEN i END), lambda i: i IS NOT NULL)) AS pos FROM c1),
c3 AS (SELECT *, array_to_string(parts[1:pos - 1], ' ') AS context, list_filter(list_transform(string_split(regexp_replace(regexp_replace(parts[pos],
   '(?i)\\s+(and|also|plus|as\\s+well\\s+as)\\s+', chr(1), 'g'), '\\s*;\\s*', chr(1), 'g'), chr(1)), lambda p: {TRIM_PART}), lambda p: length(p) > 0) AS bits FROM c2),
c4 AS (SELECT *, list_filter(bits, lambda p: regexp_matches(p, '{PART_OPENER}') AND length({q.tokens('p')}) >= 2) AS own FROM c3),
c5 AS (SELECT item_id, CASE WHEN pos IS NOT NULL AND length(bits) >= 2 AND length(own) >= 2 THEN list_concat([text],
  list_filter(list_transform(own[1:3], lambda p: {q.strip("(context || ' ' || p)")}), lambda p: lower(p) <> lower(text))) ELSE [text] END AS qs FROM c4),
bench AS (SELECT item_id * 10 + i - 1 AS item_id, qs[i] AS text FROM (SELECT *, unnest(range(1, length(qs) + 1)) AS i FROM c5))"""
    body = f"{chunks_sql()}, {POSTINGS}, {ASKED}, {LEXICAL}, {HITS_SQL}".replace("FROM benchmark", "FROM bench")
    head = body[:body.index("pool AS (")]

    joins = " ".join(f"LEFT JOIN scored p{n} ON p{n}.query_id = p0.query_id + {n} AND p{n}.chunk_id = p0.chunk_id LEFT JOIN top b{n} ON b{n}.query_id = p0.query_id + {n}"
                     for n in (1, 2, 3))
    return f"""WITH {bench}, {head} top AS (SELECT query_id, max(score) AS best FROM scored GROUP BY 1),
f1 AS (SELECT p0.query_id // 10 AS query_id, p0.chunk_id, p0.doc_id, p0.chunk_no, p0.score AS own, b0.best AS best0, {", ".join(f"p{n}.score AS s{n}, b{n}.best AS b{n}" for n in (1, 2, 3))}
  FROM scored p0 JOIN top b0 ON b0.query_id = p0.query_id {joins} WHERE p0.query_id % 10 = 0),
{", ".join(f"g{n} AS (SELECT * REPLACE (CASE WHEN s{n} / CASE WHEN b{n} = 0 THEN 1 ELSE b{n} END * CASE WHEN best0 = 0 THEN 1 ELSE best0 END * {FUSION} > own THEN round(s{n} / CASE WHEN b{n} = 0 THEN 1 ELSE b{n} END * CASE WHEN best0 = 0 THEN 1 ELSE best0 END * {FUSION}, 4) ELSE own END AS own) FROM {'f1' if n == 1 else f'g{n - 1}'})" for n in (1, 2, 3))}
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, own AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, doc_id, chunk_no) AS rank FROM g3) WHERE rank <= 15"""


@query("fused_pool", "R12 T8", fused_sql())
def _(t):
    compound = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(
        "text", F.lit(" What of the "), F.right("text", F.lit(40)), F.lit(" and how the "), F.left("text", F.lit(30)), F.lit("?")).alias("text"))
    # The pool reads the index once, so it is not stored first.
    base = corpus.embed(chunks(t), "search_text", dims=DIMS)
    return retrieval.candidate_pool(compound, base, CONFIG.with_(fusion=FUSION)).select("query_id", "rank", "chunk_id", "score")
