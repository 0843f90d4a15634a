"""Text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from answerlake.functions import masking, text as x
from answerlake.functions.vocabulary import Vocabulary, fold_word
from answerlake.operators import extraction as ex
from answerlake.plans import corpus, quality


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("word, want", [
    ("bags", "bag"), ("policies", "policy"), ("classes", "class"), ("class", "class"), ("boxes", "box"), ("ties", "ty"[:0] + "tie"),
    ("business", "business"), ("gas", "gas"), ("123s", "123"), ("dishes", "dish")])
def test_plural_folding_agrees_with_its_preparation_twin(spark, word, want):
    assert one(spark, word, x.fold_plural) == want == fold_word(word)


def test_tokens_keep_duplicates_and_expand_after_them(spark):
    vocab = Vocabulary(phrase_rules=((r"\btake\s+off\b", "departure"),), synonyms={"bags": ("luggage", "suit cases")})
    assert one(spark, "The bags and a bag at TAKE off", lambda c: x.tokenize(c, vocab)) == ["bag", "bag", "departure"]
    assert one(spark, "bags", lambda c: x.expand(x.tokenize(c, vocab), vocab)) == ["bag", "luggage", "suit", "case"]


@pytest.mark.parametrize("text, want", [
    ("a fee of 9,000 or nine thousand", {9000.0}), ("two hundred and five thousand", {200.0, 5000.0}),
    ("twenty one days", {21.0}), ("zero", set()), ("none 3.50.", {3.5}), ("a million", {1000000.0}), ("someone sixteen", {16.0})])
def test_numeric_atoms(spark, text, want):
    assert set(one(spark, text, x.numeric_atoms)) == want


def test_focus_drops_venting_and_keeps_content(spark):
    text = "I HAVE WAITED 2 HOURS! My bag is blue. What is the bag allowance?"
    venting = F.array(F.lit(0))
    assert one(spark, text, lambda c: x.focus(c, emotional_at=venting)) == "My bag is blue. What is the bag allowance?"
    assert one(spark, "Hello there. What now?", lambda c: x.focus(c)) == "Hello there. What now?"


def test_compound_questions_keep_context(spark):
    text = "I fly to Oslo. What am I owed today and what do I owe tomorrow?"
    assert one(spark, text, x.subqueries) == [text, "I fly to Oslo. What am I owed today", "I fly to Oslo. what do I owe tomorrow"]
    assert one(spark, "An infant and a stroller?", x.subqueries) == ["An infant and a stroller?"]
    parts = one(spark, "I have a surfboard. When must I arrive at the airport counter and what is owed?", x.split_question)
    assert parts == ["When must I arrive at the airport counter", "I have a surfboard. what is owed?"]


def test_windows_stop_at_the_end(spark):
    text = " ".join(map(str, range(10)))
    assert one(spark, text, lambda c: x.word_windows(c, 4, 1)) == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    assert one(spark, "  ", lambda c: x.word_windows(c, 4, 1)) == []


def test_sections_title_intro_and_empty_bodies(spark):
    docs = spark.createDataFrame([("d", "Title\nIntro\nSection 1: A\nBody a\nSection 2: B\n", "s"), ("e", "plain text", "s")],
                                 "doc_id string, text string, source string")
    got = [(r.chunk_id, r.section, r.text) for r in corpus.chunk(docs).orderBy("chunk_id").collect()]
    assert got == [("d::0", "Title", "Intro"), ("d::1", "Section 1: A", "Body a"), ("e::0", "e", "plain text")]


def test_places_codes_count_only_in_capitals(spark):
    vocab = Vocabulary(places={"nairobi": ("kenya", "africa"), "kenya": ("africa",), "africa": (), "dar es salaam": ("tanzania",)},
                       aliases={"dar": "dar es salaam", "nbo": "nairobi"}, place_codes=("nbo",), not_places=(r"kenya\s+rail",))
    assert one(spark, "Kenya Rail from NBO to Dar es Salaam", lambda c: x.places_in(c, vocab)) == ["dar es salaam", "nairobi"]
    assert one(spark, "nbo", lambda c: x.places_in(c, vocab)) == []


def test_glossary_longest_phrase_first(spark):
    terms = [("saa ngapi", "what time"), ("mizigo", "baggage"), ("ngapi", "how many"), ("kwenda", "to")]
    assert one(spark, "Je saa ngapi mizigo kwenda London", lambda c: x.glossary(c, terms, ("je",))) == "what time baggage to London"
    assert one(spark, "Je kwenda", lambda c: x.glossary(c, terms, ("je",))) is None


def test_amount_follows_the_words_of_the_question(spark):
    answer = "Correcting a name costs 15 US dollars on a domestic booking and 75 US dollars on an international booking."
    rows = [(1, answer, "my international booking name", "Fees"), (2, answer, "my name", "Fees"), (3, "You get USD 20 compensation.", "x", "Fees"),
            (4, "It is USD 20.", "x", "Care"), (5, "The fee is USD 20.", "x", "Care")]
    df = spark.createDataFrame(rows, "id long, answer string, question string, heading string")
    got = {r.id: (r.amount, r.currency) for r in ex.amounts_by_context(df).collect()}
    assert got == {1: (75.0, "USD"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (20.0, "USD")}


@pytest.mark.parametrize("sentence, question, want", [
    ("Between 1kg and 10kg over.", "5kg over", 6.0), ("Between 11kg and 20kg over.", "5kg over", -2.0), ("four to eight hours", "5 hours", 6.0),
    ("not exceeding 10kg", "12 kg", 0.0), ("more than 10kg", "12 kg", 3.0), ("more than 10 days", "12 kg", 0.0), ("Between 1kg and 10kg", "no number", 0.0)])
def test_band_bonus(spark, sentence, question, want):
    df = spark.createDataFrame([(sentence, question)], "s string, q string")
    assert df.select(quality.band_bonus(F.col("s"), quality.quantities(F.col("q"))).alias("v")).first()["v"] == want


def test_masks_are_stable_when_repeated(spark):
    text = "ring 0712 345 678 or +254112345678, card 4785380592391139"
    once = one(spark, text, masking.mask_text)
    assert once == "ring 2547*****678 or 2541*****678, card 4785380592391139"
    assert one(spark, once, masking.mask_text) == once
    assert one(spark, "ws_CO_1111202612401708374149", masking.mask_checkout) == "ws_CO_11112026124017********"
    assert one(spark, "AB-254708374149", masking.mask_checkout) == "AB-254*********"
    assert one(spark, "12345", masking.mask_phone) == "*****"


def test_json_mask_keeps_structure(spark):
    raw = '[{"tool": "pay", "args": {"to": "0712345678", "n": 254712345678, "list": ["+254712345678"]}}, "x", 3]'
    assert one(spark, raw, masking.mask_json) == \
        '[{"tool":"pay","args":{"to":"2547*****678","n":254712345678,"list":["2547*****678"]}}]'
    assert one(spark, "oops", masking.mask_json) == "[]"
    assert one(spark, '[{"0712345678": "0712345678", "b" : "x: 0712345678"}]', masking.mask_json) == \
        '[{"0712345678":"2547*****678","b":"x: 2547*****678"}]'


def test_scrub_order_and_booking_reference(spark):
    df = spark.createDataFrame([("mail a.b@c.org ref AB12CD or ABCDEF, 4785 3805 9239 1139, 0712345678",)], "t string")
    safe = masking.scrub(F.col("t"))
    row = df.select(safe["text"].alias("t"), safe["found"].alias("f")).first()
    assert row.t == "mail [email] ref [booking ref] or ABCDEF, [number], [phone]"
    assert row.f == ["[phone]", "[email]", "[number]", "[booking ref]"]


def test_context_round_trip(spark):
    blocks = F.array(F.struct(F.lit("A").alias("source"), F.lit("One").alias("section"), F.col("t").alias("text")))
    assert one(spark, "line 1\nline 2", lambda c: x.parse_context(x.serialise_context(blocks)))[0].asDict() == {
        "source": "A", "section": "One", "text": "line 1\nline 2"}


def test_masks_leave_keys_and_hashes_whole(spark):
    for text in ('token = "cf46104961766f9d091417b28d0134544236cffb"', "password=dee0737357822c2d67 ly", 'key "aba1160503dd21ceccc8486e21dbba0753839120"'):
        assert one(spark, text, masking.mask_text) == text
    assert one(spark, "Tel0712345678, x1 0712345678or", masking.mask_text) == "Tel2547*****678, x1 2547*****678or"


def test_joining_words_in_a_row_open_one_part(spark):
    parts = one(spark, "It is late. What is owed for my bags and how and is the counter open?", x.split_question)
    assert parts == ["What is owed for my bags", "how and is the counter open?"]


@pytest.mark.parametrize("text, want", [
    ("ref AB12CD² and XY9ZQ1́ here", "ref AB12CD² and [booking ref]́ here"),
    ("0712345678+254712345678", "[phone][phone]"), ("2547123456781 2 3254 712 345 6780123456.", "[number] 712 [number]."),
    ("AB12CD XY9ZQ1 A1B2C3", "[booking ref] [booking ref] [booking ref]")])
def test_scrub_edges(spark, text, want):
    assert one(spark, text, lambda c: masking.scrub(c)["text"]) == want


def test_band_rules_run_once_a_row(spark, tables):
    from answerlake.catalog.registry import all_entries
    df = spark.createDataFrame([("four to eight hours, over two days, not more than ten days", "5 hours and 9 days")], "s string, q string")
    got = df.select(quality.band_bonus(F.col("s"), quality.quantities(F.col("q"))).alias("v"))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("twenty-four\\b") == 1 and plan.count(r"(\d+(?:\.\d+)?)\s*(kg|kilos?|kilograms?|hours?|hrs?|days?), 0") == 1
    assert got.first()["v"] == 9.0
    assert all_entries()["band_bonus"].build(tables).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
