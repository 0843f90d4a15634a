"""Ledger, privacy, lifecycle, sources, classification and audits on small tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from answerlake.functions import text as x
from answerlake.operators import audit, classify, ledger, lifecycle, privacy, review
from answerlake.session import settle
from answerlake.sources import fingerprint, io, payloads

T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_minor_units_round_half_up(spark):
    df = spark.createDataFrame([(9675.0,), (0.125,), (0.005,), (1.115,)], "a double")
    assert [r.m for r in df.select(ledger.to_minor(F.col("a")).alias("m")).collect()] == [967500, 13, 1, 112]


def test_payment_settles_once(spark):
    tries = spark.createDataFrame(
        [(i, "pending", 100, "KES", at(0)) for i in (1, 2, 3, 4)] + [(5, "simulated", 100, "KES", at(0)), (6, "failed", 100, "KES", at(0))],
        "id long, status string, amount_minor long, currency string, created_at timestamp_ntz")
    seen = spark.createDataFrame([
        (1, "1", None, None, None, None, at(1)), (1, "2", "paid", 1.0, "kes", None, at(2)), (1, "3", "failed", 1.0, "KES", None, at(3)),
        (1, "4", "paid", 1.0, "KES", "R1", at(30)), (2, "1", "paid", 2.0, "KES", "R2", at(1)), (3, "1", "paid", 1.0, "KES", "R3", at(11)),
        (5, "1", "paid", 1.0, "KES", "R5", at(1)), (6, "1", "paid", 1.0, "KES", "R6", at(1))],
        "attempt_id long, seq string, outcome string, reported double, reported_currency string, receipt string, at timestamp_ntz")
    got = {r.id: (r.after, r.receipt) for r in ledger.payment_states(tries, seen.union(seen)).collect()}
    assert got == {1: ("paid", "R1"), 2: ("needs_review", "R2"), 3: ("expired", None), 4: ("expired", None), 5: ("simulated", None), 6: ("failed", None)}


def test_ledger_counts_paid_money_only(spark):
    df = spark.createDataFrame([("paid", "card", "kes", 100), ("paid", None, None, 50), ("pending", "card", "USD", 7), ("failed", "card", "USD", 9)],
                               "status string, method string, currency string, amount_minor long")
    got = {(r.part, r.key): (r.n, r.amount) for r in ledger.ledger_summary(df).collect()}
    assert got[("settled", "KES")] == (2, 1.5) and got[("pending", "USD")] == (1, 0.07) and ("settled", "USD") not in got
    assert got[("all", "all")][0] == 4 and got[("method", "mobile")][0] == 1


def test_pages_are_disjoint_and_bounded(spark):
    df = spark.range(230).withColumnRenamed("id", "n")
    first, second = (review.paged(df, [F.desc("n")], p, 1000).collect() for p in (1, 2))
    assert len(first) == 100 and not {r.n for r in first} & {r.n for r in second} and first[0].total == 230
    assert review.page(df, [F.desc("n")], 0, -5).count() == 1


def desk(spark):
    return privacy.Desk(
        messages=spark.createDataFrame([("a", 1, "user", "same q", at(0)), ("b", 2, "user", "same q", at(0)), ("o", 3, "user", "x", at(0))],
                                       "session_id string, id long, role string, message string, created_at timestamp_ntz"),
        cases=spark.createDataFrame([("a", "closed"), ("h", "open")], "session_id string, status string"),
        scores=spark.createDataFrame([(1, "a", "same q", 0.5, at(0)), (2, "b", "same q", 0.6, at(0)), (3, "c", "other", 0.7, at(0))],
                                     "id long, session_id string, query string, groundedness double, created_at timestamp_ntz"),
        ledger=spark.createDataFrame([(1, "a", "0712345678", "paid", at(0)), (2, "b", "0712345678", "paid", at(0)), (3, "z", "07", "pending", at(0))],
                                     "id long, session_id string, phone_number string, status string, created_at timestamp_ntz"),
        sessions=spark.createDataFrame([("a", at(0)), ("h", at(0)), ("b", at(60 * 24 * 40))], "session_id string, last_seen_at timestamp_ntz"))


def test_erasure_reaches_equal_questions_and_is_idempotent(spark):
    ids = spark.createDataFrame([("a",)], "session_id string")
    after, counts = privacy.erase(desk(spark), ids)
    assert counts.first().asDict() == {"sessions": 1, "messages": 1, "handover_cases": 1, "payment_contacts": 1, "evaluation_texts": 2}
    assert [r["query"] for r in after.scores.orderBy("id").collect()] == [None, None, "other"]
    assert [r.phone_number for r in after.ledger.orderBy("id").collect()] == [None, "0712345678", "07"]
    again, counts = privacy.erase(after, ids)
    assert counts.first().asDict() == {"sessions": 1, "messages": 0, "handover_cases": 0, "payment_contacts": 0, "evaluation_texts": 0}


def test_retention_spares_active_cases_and_pending_payments(spark):
    memory = spark.createDataFrame([("m", at(0))], "session_id string, updated_at timestamp_ntz")
    log = spark.createDataFrame([(1, at(0))], "id long, created_at timestamp_ntz")
    swept, counts = privacy.purge(desk(spark), "2024-04-20 10:00:00", memory, log)
    row = counts.first()
    assert row.sessions == 2 and row.expired_memory == 1 and row.audit_entries == 0
    assert {r.session_id for r in swept.sessions.collect()} == {"h"}
    assert {r.session_id: r.phone_number for r in swept.ledger.collect()} == {"a": None, "b": None, "z": "07"}


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, name string, n long")
    new = spark.createDataFrame([(2, "c", None, 1), (2, None, None, 2), (3, "d", 3, 3)], "k long, name string, n long, at long")
    plain = {r.k: (r.name, r.n) for r in lifecycle.upsert(old, new, "k", "at").collect()}
    kept = {r.k: (r.name, r.n) for r in lifecycle.upsert(old, new, "k", "at", ["name", "n"]).collect()}
    assert plain == {1: ("a", 1), 2: (None, None), 3: ("d", 3)} and kept == {1: ("a", 1), 2: ("b", 2), 3: ("d", 3)}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "refund_policy.txt").write_text("Refunds\nSection 1: Time\nSeven days.")
    (tmp_path / "notes.md").write_text("no")
    row = io.read_corpus(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.source) for r in row] == [("refund_policy", "refund_policy.txt")] and "\n" in row[0].text
    (tmp_path / "m.json").write_text(json.dumps({"documents": [
        {"file": "refund_policy.txt", "version": "1.0", "retrieved_on": "2026-09-23", "effective_from": "bad"}, {"file": "b.txt", "provenance": "synthetic"}]}, indent=1))
    found = io.read_manifest(spark, str(tmp_path / "m.json")).select("file", "provenance", io.edition_label(
        F.col("version"), F.col("provenance"), F.col("effective_from"), F.col("retrieved_on")).alias("e")).collect()
    assert [tuple(r) for r in found] == [("refund_policy.txt", "undeclared", "version 1.0, as published 23 Sep 2026"),
                                         ("b.txt", "synthetic", "prototype document, not published policy")]
    (tmp_path / "l.csv").write_text('text,label\n"two\nlines, ""quoted""",calm\n,calm\n')
    assert [tuple(r) for r in io.read_labelled(spark, str(tmp_path / "l.csv")).collect()] == [('two\nlines, "quoted"', "calm", "en", "authored")]
    io.export_csv(spark.createDataFrame([(1, "=1+1", None), (2, "ok", "-5")], "id long, a string, b string"), str(tmp_path / "out"), ["a", "b"], [F.desc("id")])
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["a,b", "ok,'-5", "'=1+1,"]


def test_fingerprint_changes_with_text_set_and_settings(spark):
    def mark(rows, **settings):
        return fingerprint.corpus_fingerprint(spark.createDataFrame(rows, "doc_id string, text string"), settings).first()[0]

    base = mark([("a", "x"), ("b", "y")], size=1)
    assert base == mark([("b", "y"), ("a", "x")], size=1) and len(base) == 16
    assert len({base, mark([("a", "x"), ("b", "z")], size=1), mark([("a", "x")], size=1), mark([("a", "x"), ("b", "y")], size=2)}) == 4
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    listed = [fingerprint.corpus_fingerprint(docs, {}, manifest=spark.createDataFrame([("a", v)], "file string, version string")).first()[0]
              for v in ("1", "2")]
    assert len({*listed, fingerprint.corpus_fingerprint(docs, {}).first()[0]}) == 3
    assert mark([("a", "b=c")]) != mark([("a=b", "c")]) and mark([("a", None)]) != mark([("a", "")])
    assert fingerprint.needs_rebuild("x", "x", True) and fingerprint.needs_rebuild("x", None, False) and not fingerprint.needs_rebuild("x", "x", False)


def test_whole_passages_and_case_variants(spark):
    docs = spark.createDataFrame([(1, "one two three  four five six seven"), (2, "one two three four five six eight"), (3, "x seven y"), (4, None)],
                                 "doc_id long, text string")
    passages = spark.createDataFrame([("a", "one two three four five six seven"), ("b", "seven"), ("c", ""), ("d", None), ("e", "two two")],
                                     "item string, text string")
    found = audit.containing_documents(passages, "item", docs, "doc_id", 3)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1), ("b", 1), ("b", 3)]
    assert audit.containing_documents(passages.filter("item = 'c'"), "item", docs, "doc_id").count() == 0
    templates = spark.createDataFrame([("m", "My {n} now"), ("m", "my {n} now")], "label string, template string")
    assert audit.expand_grammar(templates, {"n": spark.createDataFrame([("Bag",)], "n string")}, 9, "s").count() == 1


def test_mobile_success_needs_no_currency_but_a_confirmation(spark):
    from answerlake.operators import ledger
    tries = spark.createDataFrame([(1, "mobile", "c1", "pending", 100, "KES"), (2, "card", "c2", "pending", 100, "USD"), (3, "mobile", "c3", "pending", 100, "KES")],
                                  "id long, method string, checkout_id string, status string, amount_minor long, currency string")
    got = spark.createDataFrame([("mobile", "c1", 1, "paid", 1.0, None, "r1"), ("card", "c2", 1, "paid", 1.0, None, "r2"), ("mobile", "c3", 1, "paid", 1.0, None, "r3"),
                                 ("mobile", "c3", 2, "failed", None, None, None)],
                                "method string, checkout_id string, seq long, outcome string, reported double, reported_currency string, receipt string")
    after = lambda *x: {r.id: r.after for r in ledger.apply_outcomes(tries, got, *x).collect()}
    assert after() == {1: "paid", 2: "needs_review", 3: "paid"}
    assert after(got.filter("checkout_id = 'c1'")) == {1: "paid", 2: "needs_review", 3: "failed"}


def test_malformed_payloads(spark):
    rows = spark.createDataFrame([(1, '{"Body": {}}'), (2, "nonsense"), (3, '{"Body": {"stkCallback": {"CheckoutRequestID": "c", "ResultCode": 0}}}')], "id long, p string")
    assert [(r.id, r.status, r.amount) for r in payloads.parse_callbacks(rows, "p", "id").collect()] == [(3, "paid", None)]
    flight = spark.createDataFrame([("F1", "now", '{"departure": {"delay": "x", "airport": "Field", "iata": "AAA"}}')], "n string, r string, p string")
    row = payloads.normalise_flights(flight, "p", "n", "r", "board").first()
    assert row.delay_minutes is None and row.route is None and row.gate is None and len(row) == 11


def test_split_sizes_are_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("string").alias("label"))
    got = classify.stratified_split(df, "id", "label")
    counts = {(r.label, r.part): r["count"] for r in got.groupBy("label", "part").count().collect()}
    assert counts == {("true", "train"): 187, ("true", "test"): 63, ("false", "train"): 562, ("false", "test"): 188}
    assert got.join(classify.stratified_split(df, "id", "label"), ["id", "part"]).count() == 1000


def test_trained_model_reads_tone(spark):
    calm = ["What is the baggage allowance", "Please confirm the check in time", "How long does a refund take", "Thanks for the information"]
    upset = ["This is ridiculous and nobody helps", "WORST service EVER!!!", "I am furious, still no bag!", "Useless, I demand a manager now!!"]
    rows = [(i, f"{t} number {i}", "calm" if t in calm else "upset") for i, t in enumerate((calm + upset) * 6)]
    df = settle(spark.createDataFrame(rows, "id long, text string, label string"))
    model = classify.train(df, "id", "text", "label", "upset", "calm", iterations=20)
    given = classify.classify(model, df, "id", "text").withColumnRenamed("label", "predicted").join(df, "id")
    assert classify.accuracy(given, "label", "predicted").first()["accuracy"] >= 0.95
    short = spark.createDataFrame([(1, "yes"), (2, "Which bag is useful here?"), (3, "USELESS!!!")], "id long, text string")
    scores = {r.id: r.score for r in classify.classify(model, short, "id", "text").collect()}
    assert scores[1] <= classify.SHORT_CEILING and scores[2] <= classify.QUESTION_CEILING
    probe = classify.perturbation_probe(model, df, "id", "text", lambda c: F.concat(c, F.lit(".")))
    assert probe.first()["pairs"] == 48
    assert classify.expected_labels(model, df, "id", "text", "label").filter("right").count() >= 45


def test_grammar_size_matches_its_expansion(spark):
    templates = spark.createDataFrame([("a", "{x} and {y}"), ("b", "only  {x}"), ("b", "fixed")], "label string, template string")
    pools = {"x": spark.createDataFrame([("1",), ("2",)], "w string"), "y": spark.createDataFrame([("3",), ("$4",), ("5",)], "w string")}
    got = audit.expand_grammar(templates, pools, 100, "s")
    assert {r.text for r in got.collect()} == {f"{a} and {b}" for a in "12" for b in ("3", "$4", "5")} | {"only 1", "only 2", "fixed"}
    assert [r["size"] for r in audit.pool_size(templates, {"x": 2, "y": 3}).collect()] == [6, 2, 1]
    assert audit.expand_grammar(templates, pools, 2, "s").groupBy("label").count().agg(F.max("count")).first()[0] == 2


def test_norm_key(spark):
    df = spark.createDataFrame([("  A\n b ",), ("a B",)], "t string")
    assert df.select(x.norm_key(F.col("t"))).distinct().count() == 1


def test_model_is_retrained_only_when_its_data_change(spark, tmp_path):
    rows = [(i, f"{'awful!!' if i % 2 else 'fine'} text {i}", "upset" if i % 2 else "calm") for i in range(24)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    args = (str(tmp_path / "tone"), "id", "text", "label", "upset", "calm")
    first, trained = classify.train_if_changed(df, *args, iterations=5)
    again, repeated = classify.train_if_changed(df, *args, iterations=5)
    _, changed = classify.train_if_changed(df.filter("id > 0"), *args, iterations=5)
    assert (trained, repeated, changed) == (True, False, True) and again.fingerprint == first.fingerprint


def test_pages_by_partition_counts_equal_the_sorted_rows(spark, monkeypatch):
    from answerlake.operators import review
    monkeypatch.setattr(review, "TOP_ROWS", 10)
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("a"), F.col("id").alias("b")).repartition(7)
    want = [(r.a, r.b) for r in df.orderBy(F.desc("a"), "b").collect()]
    for number in (1, 2, 9, 20, 21):
        got = [(r.a, r.b) for r in review.page(df, [F.desc("a"), F.asc("b")], number, 25).collect()]
        assert got == want[(number - 1) * 25: number * 25]
    assert review.page(df.limit(0), [F.desc("a"), F.asc("b")], 3, 25).collect() == []


def test_passages_are_found_by_their_rarest_run(spark):
    from answerlake.operators.audit import containing_documents
    common = "the quick brown fox jumps over the lazy dog"
    docs = [(i, f"{common} and then number {i} ended {'with a rare tail here' if i == 7 else 'plainly'}") for i in range(30)] + [(90, None), (91, "")]
    passages = [(1, common), (2, f"{common}  and then\nnumber 7 ended with a rare"), (3, "fox jumps under the lazy"), (4, "lazy"), (5, " "),
                (6, f"{common} and then number 999"), (7, None), (8, "quick brown fox jumps over the")]
    got = containing_documents(spark.createDataFrame(passages, "item long, text string"), "item",
                               spark.createDataFrame(docs, "doc long, text string"), "doc", 6).collect()
    want = set()
    for item, text in passages:
        words = (text or "").split()
        for doc, body in docs:
            if words and f" {' '.join(words)} " in f" {' '.join((body or '').split())} ":
                want.add((item, doc))
    assert {(r.item, r.doc) for r in got} == want and len(got) == len(want)


def test_scoring_stays_where_the_text_lies(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} said twice said {i}", "upset" if i % 2 else "calm") for i in range(40)], "id long, text string, label string")
    model = classify.train(df, "id", "text", "label", "upset", "calm", iterations=3)
    given = classify.classify(model, df, "id", "text")
    plan = given._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert given.count() == 40


def test_passages_are_looked_up_whole_and_by_half(spark, tmp_path):
    from answerlake.catalog.registry import all_entries
    from answerlake.session import Tables
    spark.createDataFrame([(1, "a b c d"), (2, "e f g"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x a b y"), (2, "a b  c d"), (3, "e z")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = all_entries()["containing_documents"].build(Tables(spark, str(tmp_path))).collect()
    assert {(r.item_id, r.part, r.doc_id) for r in got} == {(1, "half", 1), (1, "half", 2), (1, "whole", 2), (2, "half", 3)}


def test_lines_are_found_as_the_sql_finds_them(spark, tmp_path):
    import duckdb

    from answerlake.catalog.registry import all_entries
    from answerlake.session import Tables
    rows = [(1, "a\x0bb\nc  d\te\r\n\n"), (2, "x a\x0bb y"), (None, "c d e f"), (3, None), (3, "c d"), (4, ""), (4, "c d e c d e"), (5, "é ü\n" + "w " * 12),
            (6, "é ü " + "w " * 30), (7, " ".join(map(str, range(13)))), (8, "b"), (8, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    item = all_entries()["repeated_lines"]
    got = [(r.line, r.doc_id) for r in item.build(Tables(spark, str(tmp_path))).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(item.sql).fetchall()
    assert len(got) == len(want) and set(got) == set(want) and ("a\x0bb", 2) in got and ("c d", None) in got


def test_runs_that_are_no_passage_stay_where_the_text_lies(spark):
    from answerlake.operators.passages import CHUNK_WORDS, runs_in_texts
    # more passages than the former filter of 2^22 bits told apart; sizes beyond and below n, a text over several chunks
    n, long = 300_000, CHUNK_WORDS + 50
    passages = spark.range(n).select(F.concat_ws(" ", F.col("id"), F.when(F.col("id") % 2 == 0, F.concat_ws(" ", F.lit("p"), F.lit("q")))).alias("passage"))
    sizes = {1: n // 2, 3: n // 2}
    words = [f"z{i}" for i in range(long)]
    words[CHUNK_WORDS - 1: CHUNK_WORDS + 2] = ["4", "p", "q"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "3 4 p 8 p q"), (3, " ".join(f"y{i}" for i in range(40_000)))], "doc_id long, text string")
    got = runs_in_texts(docs, "doc_id", passages, sizes, 2).collect()
    known = {(r.doc_id, r.passage) for r in got if not r.passage.startswith(("y", "z"))}
    assert known >= {(1, "4 p q"), (2, "3"), (2, "8 p q")}
    assert len(got) < 1_000
