"""Extraction, toxicity, token files, languages, pseudo-likelihood, packing, fingerprints."""

import random
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from answerlake.llm import html
from answerlake.llm import pseudo_likelihood as pseudo_likelihood_module
from answerlake.llm.fingerprints import fingerprints
from answerlake.llm.idfiles import combine_crc32, decode_ids, document_digests, encode_ids, make_block, read_block, read_ids, write_ids
from answerlake.llm.languages import learn_languages, predicted
from answerlake.llm.packing import best_two_fit, bins
from answerlake.llm.pseudo_likelihood import learn_network, pseudo_likelihood
from answerlake.llm.tokens import Encoder
from answerlake.llm.toxicity import Grammar, learn_grammar, pattern_totals, scored
from answerlake.llm.words import split_words

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header class="site"><p>My site slogan here now</p></header>
<nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="notice">We use cookies to improve. Go on reading.</div>
<div id="content"><h1>Title &eacute; here</h1><p>First  para with <a href=q>link</a> text&nbsp;and more words to fill it up.</p>
<aside><p>Related things you may like</p></aside><form><p>subscribe please</p></form><p>Second para &lt;b&gt; done</p>
<section class="comments"><p>nice post by a reader</p></section></div><footer><p>&copy; 2024 us</p></footer></body></html>"""


def test_main_text_by_priors_and_by_learned_weights(spark):
    expected = "Title é here\nFirst para with link text and more words to fill it up.\nSecond para <b> done"
    assert html.main_text(PAGE, {}) == expected
    marked = [(i, "u", f"<nav><a href=x>go there</a></nav><div class=promo>buy it now</div><article><h1>Head</h1><p>text {i} goes on and on</p></article>") for i in range(30)]
    rows = [*marked, (90, None, None), (91, "u", ""), (92, "u", "<p>"), (93, "u", PAGE)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Head\ntext 3 goes on and on" and [found[i] for i in (90, 91, 92)] == ["", "", ""] and found[93] == expected


@pytest.mark.parametrize("scores", [[random.Random(s).uniform(-2, 2) for _ in range(30)] for s in range(5)] + [[], [-1.0]])
def test_best_region(scores):
    low, high = html.best_region(scores)
    every = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a, len(scores) + 1)]
    assert abs(sum(scores[low:high]) - max([0, *every])) < 1e-9


def test_clause_patterns():
    lexicon = Grammar(words={"gronk": 3.0}, stems={"vequ": 2.0}).lexical()
    assert pattern_totals("you gronk. he said gronk! not a gronk; vequté", lexicon).tolist() == [2.0, 3.0, 3.0, 3.0, 0, 0, 0, 0]
    assert not pattern_totals(None, lexicon).any() and not pattern_totals("clean text.", lexicon).any()


def test_toxicity_learns_words_and_stems(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice("ab cd ef gh ij kl mn op".split()) for _ in range(30)]
        if i % 3 == 0:
            words[draw.randrange(30)] = draw.choice(["zork", "vequ" + draw.choice("abcdefgh") + draw.choice("xyz")])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    grammar = learn_grammar(docs, spark.createDataFrame([x for x in labels if x[0] < 450] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    found = {r.doc_id: r.score for r in scored(docs, grammar).collect()}
    assert all((found[i] >= 0.7) == (i % 3 == 0) for i in range(450, 600)) and found[1000] == found[1001] < 0.5
    none = learn_grammar(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in scored(docs, none).collect())


def test_toxicity_learns_rare_insults_behind_many_ordinary_words(spark):
    draw = random.Random(9)
    plain = sorted({"".join(draw.choice(x) for x in ("bcdfghjklmnp", "aeiou", "qrstvwxz", "aeiou", "bcdfghjk", "aeiou")) for _ in range(20_000)})
    rows, labels = [], []
    for i in range(1600):
        words = draw.sample(plain, 400)
        if i % 2 and i < 24:
            words[draw.randrange(400)] = "zork"
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2))
    assert len({*plain, *(f"{w[:n]}*" for w in plain for n in (4, 5))}) > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    grammar = learn_grammar(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert grammar.words["zork"] > 1.5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_cache_gives_the_library_ids(name):
    encoder = Encoder(public_tokenizers.path(name))
    texts = ["", "  a", " x\n\n y \n", "it's I'll don''s", "a1b2 33", "ünï © ½ x", "日本 text", "é x", "<|endoftext|> hi", None, "TÊTE-à"]
    plain = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.ids(texts) == plain


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_strings_of_added_tokens_give_the_library_ids(name):
    path = public_tokenizers.path(name)
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|ENDOFTEXT|>b", "plain words", "x <|endoftext|><|endoftext|> y"]
    plain = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert Encoder(path).ids(texts) == plain


@pytest.mark.parametrize("ids", [[], [7], [0] * 3000, list(range(20000)), np.random.default_rng(0).zipf(1.3, 30000).clip(0, 60000).tolist()])
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (decode_ids(encode_ids(ids)) == ids).all()


def test_damage_is_found():
    block = make_block([5, None], [2, 1], np.array([4, 1, 1]))
    docs, counts, ids = read_block(block)
    assert (docs, counts, ids.tolist()) == ([5, None], [2, 1], [4, 1, 1])
    with pytest.raises(ValueError):
        read_block(block[:9] + bytes([block[9] ^ 1]) + block[10:])
    assert combine_crc32(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "some words here"), (2, None), (9, "long " * 300), (None, "x"), (5, "again"), (3, "")]
    write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), path, 1, block_tokens=64)
    found = sorted(tuple(r) for r in document_digests(read_ids(spark, str(tmp_path / "ids"))).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    order = [(None, "x"), (2, None), (3, ""), (5, "again"), (5, "some words here"), (9, "long " * 300)]
    start, expected, tokenizer = 0, [], Tokenizer.from_file(path)
    for doc, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    write_ids(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), path, 1)
    assert read_ids(spark, str(tmp_path / "none")).count() == 0


def test_bins_hold_every_piece_once():
    draw = random.Random(8)
    for _ in range(20):
        have = {draw.randint(1, 64): draw.randint(1, 40) for _ in range(draw.randint(1, 25))}
        packed = bins(have, 64)
        left = dict(have)
        for lengths, times in packed:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                left[x] -= times
        assert not any(left.values())


def test_packing(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["one", "two", "three"]) for _ in range(draw.choice([0, 5, 30, 200])))) for i in range(60)] + [(3, "again"), (None, None)]
    found = best_two_fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_tokenizers.path("byte_bpe_50k.json"), 2, 100).collect()
    bins_ = {}
    for r in found:
        bins_.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and (r.piece == 0 or r.length == 100)
    for b in bins_.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    assert sum(r.piece == 0 for r in found) == len(rows)


def test_languages(spark):
    draw, parts = random.Random(1), {"xx": ["abra", "bram", "rabo"], "yy": ["zilk", "kizo", "lizk"]}
    def text(lang, n=30):
        return " ".join(draw.choice(parts[lang]) + draw.choice(parts[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    model = learn_languages(spark.createDataFrame([*rows, (500, None, "xx"), (501, "t", None)], "doc_id long, text string, lang string"))
    new = [(1, text("xx")), (2, text("yy")), (3, text("xx") + " " + text("yy", 60)), (4, None), (5, "12 3!"), (6, "")]
    found = {r.doc_id: r for r in predicted(spark.createDataFrame(new, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["xx", "yy", "yy", "und", "und", "und"]
    assert len(found[1].proportions) == 1 and 0.5 < found[3].proportions["yy"] < 0.8 and found[4].score == 0


def test_pseudo_likelihood_prefers_order(spark):
    draw = random.Random(3)
    text = " ".join("a b c d e f".split() * 200)
    mixed = text.split()
    draw.shuffle(mixed)
    docs = spark.createDataFrame([(i, text) for i in range(200)] + [(99, None)], "doc_id long, text string")
    net = learn_network(docs)
    found = {r.doc_id: r for r in pseudo_likelihood(spark.createDataFrame([(1, text), (2, " ".join(mixed)), (3, None)], "doc_id long, text string"), net).collect()}
    assert found[1].per_word > found[2].per_word + 0.3 and found[3].log_likelihood == 0 and found[3].per_word is None


@pytest.mark.parametrize("known", [2, 401, 65_536])
def test_pseudo_likelihood_gives_every_word_its_own_probability(spark, monkeypatch, known):
    monkeypatch.setattr(pseudo_likelihood_module, "KNOWN", known)
    names = [f"w{i}" for i in range(400)]
    buckets = {}
    for name, h in zip(names, split_words(pa.array([" ".join(names)])).hash.tolist(), strict=True):
        buckets.setdefault(h % pseudo_likelihood_module.BUCKETS, []).append(name)
    common, rare = next(b for b in buckets.values() if len(b) > 1)[:2]      # two words of one bucket
    often = " ".join(f"f{i}" for i in range(400))
    rows = [(i, f"{often} {common if i < 50 else rare if i < 54 else ''}") for i in range(60)]
    model = learn_network(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = [(1, f"f0 {common} f1"), (2, f"f0 {rare} f1"), (2, f"f0 {rare} f1"), (3, None)]
    found = sorted(tuple(r) for r in pseudo_likelihood(spark.createDataFrame(asked, "doc_id long, text string"), model).collect())
    assert [r[:2] for r in found] == [(1, 3), (2, 3), (2, 3), (3, 0)]
    assert found[0][2] - found[1][2] == pytest.approx(np.log(50 / 4), abs=1e-4) and found[1] == found[2]


def test_pseudo_likelihood_trains_on_every_word(monkeypatch):
    seen = []
    train = pseudo_likelihood_module.Network.train

    def counted(self, classes, contexts):
        seen.append(len(classes))
        train(self, classes, contexts)

    start = pseudo_likelihood_module.Network.start(np.zeros(0, np.uint64), np.full(512, 1 / 512))
    monkeypatch.setattr(pseudo_likelihood_module.Network, "train", counted)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f g"] * 10)], names=["text"])
    monkeypatch.setattr(pseudo_likelihood_module, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    out = list(pseudo_likelihood_module._trained(iter([batch]), start))
    assert sum(seen) == 70 and out[0].column("n").to_pylist() == [70]


def test_fingerprints(spark):
    draw = random.Random(6)
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(draw.choice(base) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, None), (102, ""), (None, "x y"), (102, "z")]
    found = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 0.02, 0.9).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(rows) and by[0].fingerprint == by[100].fingerprint and by[0].n_chars == len(texts[0])
    assert np.mean([by[i].near_edited for i in range(60)]) > np.mean([by[i].near_next for i in range(60)]) + 0.1
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_words_go_to_the_library_together_and_once(name, monkeypatch):
    from answerlake.llm import tokens
    path = public_tokenizers.path(name)
    draw = np.random.default_rng(3)
    parts = ["'s", "'", "''re", " ", "  ", "\n", " \n", "İx", "ſt", "Ǆ", "a", "Bc", "éÀ", "9", "42", "—", "?!", "«", "</w>", "don't", "\t", "x\r\n", "…", "zq"]
    texts = ["".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 60))) for _ in range(300)] + [f"w{i} q{i * i}!" for i in range(1500)]
    plain = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoder, calls = Encoder(path), []
    learn = Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, words, first: (calls.append(len(words)), learn(self, words, first)))
    assert [x for at in range(0, len(texts), 100) for x in encoder.ids(texts[at: at + 100])] == plain
    known = sum(calls)
    assert encoder.ids(texts) == plain and sum(calls) == known == len(encoder.known) - encoder.lower
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    assert [x for at in range(0, len(texts), 100) for x in encoder.ids(texts[at: at + 100])] == plain
    monkeypatch.setattr(Encoder, "_ends", lambda self, ids, kind: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    encoder._forget()
    assert encoder.ids(texts[:200]) == plain[:200]


def test_workers_hold_no_words_after_packing(spark):
    def held(batches):
        from answerlake.llm import tokens
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(e.known) for k, e in tokens._ENCODERS.items() if "byte_bpe" in str(k))])], names=["n"])

    rows = [(i, " ".join(f"w{i * 50 + j}x" for j in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert best_two_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), 2).count() >= len(rows)
    found = spark.range(0, 64, 1, 8).mapInArrow(held, "n long").collect()
    assert found and all(r["n"] == 0 for r in found)


def test_letters_whose_lower_case_is_no_common_letter_give_the_library_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(33, 127)] if c not in (0xD7, 0xF7)]
    texts = [f"{a}{b}e {a} x{a}9" for a, b in zip(letters, letters[1:] + letters[:1], strict=True)]
    plain = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert Encoder(path).ids(texts) == plain


def test_known_words_pass_the_rules_by():
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's a TÊTE-à-tête, «ok» don''t", "x1 22 … (ǆ) ſt", "a\tb\n c"]
    plain = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder.tokenizer = types.SimpleNamespace(encode_batch=lambda texts, add_special_tokens: [1 / 0 for _ in texts])
    assert encoder.ids(texts) == plain      # all new words went to the copy without rules
