"""Search against a plain brute-force reading of the rules, and ranking on tiny vectors."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.functions.vocabulary import Vocabulary
from answerlake.plans import corpus, retrieval, scoring
from answerlake.plans.blocks import Grid

VOCAB = Vocabulary(
    synonyms={"suitcase": ("baggage",), "cash": ("refund",)},
    places={"oslo": ("norway", "europe"), "bergen": ("norway", "europe"), "paris": ("france", "europe"), "norway": ("europe",),
            "france": ("europe",), "europe": ()}, cities=("oslo", "bergen", "paris"))
DOCS = [
    (1, "Baggage\nSection 1: Allowance\nEach guest may check one bag of 23 kilos. Baggage over the limit is charged.\n"
        "Section 2: Exceptions\nOn Oslo to Bergen routes one bag of 10 kilos is free.", "a.txt"),
    (2, "Refunds\nSection 1: Timelines\nRefunds take seven days. Refunds to Oslo cards take nine days.", "b.txt"),
    (3, "Hand bags\nSection 1: Cabin\nA cabin bag of 12 kilos is free on every route.", "c.txt"),
    (4, "Refunds\nSection 1: Timelines\nRefunds take seven days. Refunds to Oslo cards take nine days.", "d.txt"),
]
ASKED = [(1, "How heavy may my suitcase be to Paris?"), (2, "When do I get cash back and how long do refunds take?"),
         (3, "cabin bag size"), (4, "qqq"), (5, "baggage allowance")]
CFG = retrieval.SearchConfig(vocab=VOCAB, dims=32, use_places=True, route_words="(?i)route|exception", k=3)


@pytest.fixture(scope="module")
def setup(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    index = corpus.embed(corpus.chunk(docs), "search_text", dims=32).cache()
    asked = spark.createDataFrame(ASKED, "query_id long, text string")
    return asked, index


def brute(spark, text, rows, cfg):
    """Scores of one question over all chunks, chunk by chunk and term by term."""
    def tokens(texts, expand):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        made = x.tokenize(F.col("t"), VOCAB)
        return [r.v for r in df.select("i", (x.expand(made, VOCAB) if expand else made).alias("v")).orderBy("i").collect()]

    asked = tokens([text], True)[0]
    bags = [Counter(t) for t in tokens([r["search_text"] for r in rows], False)]
    heads = [set(t) for t in tokens([f"{r['section']} {r['doc_title']}" for r in rows], True)]
    vec = [np.array(r["embedding"]) for r in rows]
    encoded = np.array(corpus.embed(spark.createDataFrame([(text,)], "t string"), "t", dims=cfg.dims).first()["embedding"])
    places = spark.createDataFrame([(i, t) for i, t in enumerate([text] + [r["text"] for r in rows])], "i int, t string").select(
        "i", x.places_in(F.col("t"), VOCAB).alias("p")).orderBy("i").collect()
    want, stated = places[0].p, [set(r.p) for r in places[1:]]
    n, avg = len(rows), sum(sum(b.values()) for b in bags) / len(rows)
    lex, dense = [], []
    for bag, v in zip(bags, vec, strict=True):
        total = 0.0
        for t in asked:
            df = sum(1 for b in bags if t in b)
            if bag[t]:
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                total += idf * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg))
        lex.append(total)
        norm = np.linalg.norm(v) * np.linalg.norm(encoded)
        dense.append(float(v @ encoded / norm) if norm else 0.0)

    def scaled(values):
        lo, hi = min(values), max(values)
        return [0.0 if hi - lo < 1e-9 else (v - lo) / (hi - lo) for v in values]

    out = []
    for row, a, b, head, places_here in zip(rows, scaled(lex), scaled(dense), heads, stated, strict=True):
        unique = set(asked)
        s = 0.6 * a + 0.4 * b
        s *= 1 + 0.9 * (len(unique & head) / len(unique)) ** 2 if unique else 1
        listing = len(places_here & set(VOCAB.cities)) >= 2
        if listing and any(not ({p, *VOCAB.places[p]} & places_here) for p in want):
            s *= 0.75
        elif listing and not want and "route" not in text and "exception" not in text:
            s *= 0.85
        out.append((round(s, 4), row["chunk_id"]))
    return out


def test_pool_matches_brute_force(spark, setup):
    asked, index = setup
    rows = index.orderBy("doc_id", "chunk_no").collect()
    got = retrieval.candidate_pool(asked, index, CFG).collect()
    for ident, text in ASKED:
        want = {c: s for s, c in brute(spark, text, rows, CFG)}
        mine = {r.chunk_id: r.score for r in got if r.query_id == ident}
        assert mine.keys() == want.keys()
        assert all(abs(mine[c] - want[c]) <= 1.01e-4 for c in want), (text, mine, want)


def test_fusion_matches_brute_force(spark, setup):
    asked, index = setup
    rows = index.orderBy("doc_id", "chunk_no").collect()
    cfg = CFG.with_(fusion=0.95, use_places=False)
    got = {r.chunk_id: r.score for r in retrieval.candidate_pool(asked.filter("query_id = 2"), index, cfg).collect()}
    parts = spark.createDataFrame([(ASKED[1][1],)], "t string").select(x.subqueries(F.col("t"), VOCAB).alias("p")).first()["p"]
    assert len(parts) == 3
    all_scores = [dict((c, s) for s, c in brute_without_places(spark, p, rows)) for p in parts]
    fused = dict(all_scores[0])
    for alt in all_scores[1:]:
        best, own = max(alt.values()) or 1.0, max(fused.values()) or 1.0
        for c in fused:
            fused[c] = max(fused[c], round(alt[c] / best * own * 0.95, 4))
    assert all(abs(got[c] - fused[c]) <= 2.1e-4 for c in fused)


def brute_without_places(spark, text, rows):
    hidden = [dict(r.asDict(), text="") for r in rows]
    return brute(spark, text, hidden, CFG)


@pytest.mark.parametrize("grid", [Grid(1, 1), Grid(5, 3), Grid(2, 40)])
def test_any_grid_gives_the_same_pool(setup, rows, grid):
    asked, index = setup
    for cfg in (CFG, CFG.with_(fusion=0.9)):
        want = rows(retrieval.candidate_pool(asked, index, cfg), "query_id", "rank", "chunk_id", "score")
        assert rows(retrieval.candidate_pool(asked, index, cfg, grid=grid), "query_id", "rank", "chunk_id", "score") == want


def test_more_questions_make_no_more_jobs(spark, setup):
    _, index = setup
    tracker = spark.sparkContext.statusTracker()

    def jobs(n, name):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("refunds to Oslo "), "id").alias("text"))
        spark.sparkContext.setJobGroup(name, name)
        try:
            retrieval.candidate_pool(asked, index, CFG, grid=Grid(2, -(-n // 50))).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    assert jobs(20, "few") == jobs(200, "many")


def test_nearest_vectors_equal_the_plain_product(spark, rows):
    draw = np.random.default_rng(2)
    vectors, asked = draw.normal(size=(60, 5)).round(1), draw.normal(size=(7, 5)).round(1)
    vectors[3], asked[2] = 0.0, 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")

    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    score = scoring.half_up(unit(asked) @ unit(vectors).T, 6)
    want = sorted(((i, rank + 1, int(j)) for i in range(7) for rank, j in enumerate(
        sorted(range(60), key=lambda j: (-score[i, j], j))[:4])), key=str)
    assert rows(retrieval.dense_top_k(q, df, 4), "query_id", "rank", "vec_id") == want


def test_small_blocks_give_the_same_pool(setup, monkeypatch, rows):
    asked, index = setup
    want = rows(retrieval.candidate_pool(asked, index, CFG, 2), "query_id", "rank", "chunk_id", "score")
    top = rows(retrieval.candidate_pool(asked, index, CFG, 15).filter("rank <= 2"), "query_id", "rank", "chunk_id", "score")
    assert want == top


def test_stored_features_are_taken_as_they_are(setup, rows):
    asked, index = setup
    features = retrieval.chunk_features(index, CFG)
    assert rows(retrieval.candidate_pool(asked, features, CFG), "query_id", "rank", "chunk_id") == rows(
        retrieval.candidate_pool(asked, index, CFG), "query_id", "rank", "chunk_id")


def test_search_drops_hits_without_a_shared_word(setup):
    asked, index = setup
    hits = retrieval.search(asked, index, CFG).collect()
    by = {}
    for r in hits:
        by.setdefault(r.query_id, []).append(r)
    for found in by.values():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(found) + 1)) and len(found) <= 3
        assert found[0].lexical_score == 0 or all(r.lexical_score > 0 for r in found)


def pool(scores, docs, vectors):
    return pd.DataFrame({"score": scores, "doc_id": docs, "embedding": [np.array(v, float) for v in vectors]})


def test_mmr_on_tiny_vectors():
    near = pool([1.0, 0.99, 0.9], ["a", "b", "c"], [[1, 0], [1, 0], [0, 1]])
    assert scoring.select_diverse(near, 2, 1.0) == [0, 1]                    # lambda 1 is plain top-k
    assert scoring.select_diverse(near, 2, 0.5) == [0, 2]                    # near-duplicates are broken up
    same_doc = pool([1.0, 0.99, 0.95], ["a", "a", "b"], [[1, 0], [1, 0], [1, 0]])
    assert scoring.select_diverse(same_doc, 2, 0.7, stale=True) == [0, 2]    # stale: document identity only
    assert scoring.select_diverse(near, 9, 0.8) == [0, 2, 1] and len(set(scoring.select_diverse(near, 9, 0.8))) == 3
    assert scoring.select_diverse(pool([0.5, 0.5], ["a", "b"], [[1, 0], [1, 0]]), 2, 0.8) == [0, 1]


def test_stale_vectors_are_reported_and_score_nothing(setup):
    asked, index = setup
    short = index.withColumn("embedding", F.slice("embedding", 1, 8))
    assert corpus.index_is_stale(short, 32).first()["stale"]
    assert retrieval.candidate_pool(asked, short, CFG).agg(F.max(F.abs("dense_score"))).first()[0] == 0.0


def test_hashed_encoder_equals_sparse_form(spark, setup):
    _, index = setup
    sparse = corpus.hashed_embedding(index, "chunk_id", "search_text", 32).collect()
    dense = {r.chunk_id: r.embedding for r in index.select("chunk_id", "embedding").collect()}
    for r in sparse:
        assert abs(dense[r.chunk_id][r.bucket] - r.weight) < 1e-12


def test_guard_refuses_unknown_subjects(spark, setup):
    asked, index = setup
    vocab_table = corpus.vocabulary(index, VOCAB, "search_text")
    rows_ = [(1, "baggage allowance"), (2, "weather forecast tomorrow"), (3, "fee for a pony")]
    q = spark.createDataFrame(rows_, "query_id long, text string")
    hits = retrieval.with_chunks(retrieval.search(q, index, CFG), index)
    got = {r.query_id: r.grounded for r in retrieval.grounding_guard(q, hits, vocab_table, VOCAB).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_lexical_sums_follow_the_matches():
    rng = np.random.default_rng(3)
    tf, weight = rng.poisson(0.3, (20, 30)).astype(float), rng.poisson(0.2, (30, 7))
    asked = [{"query_id": i, "part": 0, "embedding": [1.0], "weights": [
        {"term": f"t{t:02}", "tf": int(weight[t, i]), "idf": 1.0 + t} for t in range(30) if weight[t, i]]} for i in range(7)]
    block = scoring.QuestionBlock.of(pa.Table.from_pylist(asked), None, {}, ())
    kept = [int(t[1:]) for t in block.terms]
    row, term = np.nonzero(tf[:, kept])
    got = scoring._product(20, row, term, tf[:, kept][row, term], block, block.weights)
    assert np.allclose(got, tf @ (weight * (1.0 + np.arange(30))[:, None]))


def test_stored_blocks_stay_smaller_than_the_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i * 7919 % 5000:04}x" for i in range(5000)])
    texts = [(i, " ".join(words[rng.integers(0, 5000, 400)]), "s") for i in range(1500)]
    index = corpus.embed(corpus.chunk(spark.createDataFrame(texts, "doc_id long, text string, source string")), "search_text", dims=32)
    asked = spark.createDataFrame([(i, f"What is {words[i]} and how {words[i + 1]}?") for i in range(1100)], "query_id long, text string")
    context = spark.sparkContext
    was = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        found = retrieval.candidate_pool(asked, index, CFG.with_(use_places=False, fusion=0.9)).count()
    finally:
        context.setCheckpointDir(was or str(tmp_path))
    stored = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert found == 1100 * 15
    assert stored < 2 * sum(len(t) for _, t, _ in texts), stored     # three groups of questions, one copy of the chunks


def test_chunk_terms_are_counted_in_one_sorted_dictionary():
    lists = pa.array([["b", "a", "b"], [], None, ["ö", "z", None, "a"]], pa.list_(pa.string()))
    terms, counts = scoring._tally(lists)
    assert terms.to_pylist() == [["a", "b"], [], [], ["a", "z", "ö"]] and counts.to_pylist() == [[1, 2], [], [], [1, 1, 1]]
    row, term, at = scoring._held(terms.slice(1), pa.array(["a", "q", "ö"]))
    assert (row.tolist(), term.tolist()) == ([2, 2], [0, 2]) and counts.slice(1).flatten().take(pa.array(at)).to_pylist() == [1, 1]
    block = pa.RecordBatch.from_pydict({"terms": terms})
    assert scoring.holders(block, pa.table({"term": ["q", "a", "z"]})).to_pylist() == [{"term": "a", "df": 2}, {"term": "z", "df": 1}]
