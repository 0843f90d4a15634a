"""Answer metrics and composition on adversarial cases."""

import pytest
from pyspark.sql import functions as F

from answerlake.plans import quality

SOURCE = "A bag between 1kg and 10kg over the limit is charged Ksh 9,000. Refunds take seven days. There is a fee for changes."


def ground(spark, answer, context=SOURCE):
    answers = spark.createDataFrame([(1, answer)], "query_id long, answer string")
    contexts = spark.createDataFrame([(1, context)], "query_id long, context string")
    return quality.groundedness(answers, contexts).first()["groundedness"]


@pytest.mark.parametrize("answer, want", [
    (SOURCE, 1.0), ("The overweight charge is nine thousand shillings.", 1.0), ("The bag is charged Ksh 12,000.", 0.0),
    ("There is no fee for changes.", 0.0), ("I will help you sort this out right away.", 0.0), ("", 0.0),
    ("Refunds take 7 days.\n\nSource: Policy (version 3, 23 Sep 2026)", 1.0), ("Refunds take 7 days. Refunds take 9 days.", 0.5)])
def test_groundedness(spark, answer, want):
    assert ground(spark, answer) == want


def test_empty_context_supports_nothing(spark):
    assert ground(spark, "Refunds take 7 days.", "") == 0.0


@pytest.mark.parametrize("answer, question, low, high", [
    ("How long does a refund take?", "How long does a refund take?", 0.0, 0.0),
    ("A refund takes seven working days after approval.", "How long does a refund take?", 0.1, 1.0), ("Cats sleep.", "How long does a refund take?", 0.0, 0.0)])
def test_answer_relevance_rewards_new_information(spark, answer, question, low, high):
    df = spark.createDataFrame([(answer, question)], "a string, q string")
    assert low <= df.select(quality.answer_relevance(F.col("a"), F.col("q")).alias("v")).first()["v"] <= high


def test_gold_keys_accept_spelled_figures(spark):
    df = spark.createDataFrame([("It costs nine thousand.", ["9,000", "refund", " "])], "a string, k array<string>")
    row = df.select(quality.answer_relevance_gold(F.col("a"), F.col("k")).alias("v"), quality.missing_keys(F.col("a"), F.col("k")).alias("m")).first()
    assert row.v == 0.5 and row.m == ["refund"]


def hits_frame(spark):
    return spark.createDataFrame([
        (1, 1, "d::0", "fees.txt", "Section 2: Overweight Fees", "A bag between 1kg and 10kg over the limit is charged 90 dollars. A bag between 11kg and 20kg over the limit is charged 180 dollars.", 1.0, 0.5),
        (1, 2, "e::0", "pets.txt", "Section 1: Pets", "Pets travel in the hold under separate rules here.", 0.2, 0.1)],
        "query_id long, rank int, chunk_id string, source string, section string, text string, score double, dense_score double")


def test_composed_answer_picks_the_band_and_cites_it(spark):
    asked = spark.createDataFrame([(1, "My bag is 15 kg over the limit, what is the fee?")], "query_id long, text string")
    answer = quality.compose(asked, hits_frame(spark), verbose=False).first()["answer"]
    assert answer == "A bag between 11kg and 20kg over the limit is charged 180 dollars.\n\nSource: Fees - Section 2: Overweight Fees"


def test_composition_falls_back(spark):
    asked = spark.createDataFrame([(1, "zzz qqq"), (2, "anything")], "query_id long, text string")
    got = {r.query_id: r.answer for r in quality.compose(asked, hits_frame(spark)).collect()}
    assert got[1].startswith("A bag between 1kg and 10kg") and got[2] == quality.NOTHING_FOUND


def test_withheld_figures(spark):
    df = spark.createDataFrame([("It is 5 or 7.5", "five"), ("It is 5", "five"), (" ", "x")], "a string, p string")
    got = [r.v for r in df.select(quality.withheld(F.col("a"), F.col("p")).alias("v")).collect()]
    assert got == ["states figures not in the context (7.5)", None, "empty answer"]


def test_fairness_ignores_empathy_only(spark):
    rows = [(1, "calm", "Text.", ["a"]), (1, "upset", "Sorry.\n\nText.\n\nTalk to a person?", ["a"]), (2, "calm", "Text.", ["a"]), (2, "upset", "Other.", ["b"])]
    df = spark.createDataFrame(rows, "pair_id long, variant string, answer string, sources array<string>")
    got = {r.pair_id: (r.same_answer, r.same_sources) for r in quality.fairness_pairs(df, "calm", "Sorry.\n\n", ["Talk to a person?"]).collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_medians_are_exact(spark):
    import numpy as np
    draw = np.random.default_rng(3)
    groups = {"a": draw.exponential(size=501).tolist(), "b": [2.0] * 40 + [1e9, -5.0], "c": [1.5], "d": [1.0, 4.0], None: [3.0, 1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    got = {r.k: r.median for r in quality.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", 16).collect()}
    assert got == {k: float(np.median(v)) for k, v in groups.items()}
