"""The corpus pipeline against a brute-force version of its stages."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_near import ALNUM, SPACE, brute_components, brute_hits, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, hit string, toxic_score double, component_id long"


def corpus():
    """Texts by doc_id, with planted toxic words, near copies, passages and benchmark items."""
    draw = random.Random(12)
    letters = "abcdefghijklmnop"

    def some(n):
        return ["".join(draw.choice(letters) for _ in range(3)) for _ in range(n)]

    items = [(f"b{i}", " ".join(some(draw.choice([4, 10, 13])))) for i in range(6)] + [("none", None), ("dots", "...")]
    bodies = [some(draw.randrange(25, 60)) for _ in range(260)]
    shared = some(26)
    for i in range(40):
        copy = list(draw.choice(bodies[:30]))
        if i % 3:
            copy[draw.randrange(len(copy))] = "changed"
        bodies.append(copy)
    bodies += [[*some(8), *shared, *some(draw.randrange(8))] for _ in range(6)] + [shared[1:23]]
    bodies += [[*some(12), *items[i % 6][1].upper().split(), *some(9)] for i in range(12)] + [items[2][1].split()]
    texts = {10 + i: draw.choice([" ", "  ", "\n"]).join(b) for i, b in enumerate(bodies)}
    toxic = {}
    for i in range(160):
        doc = 1000 + i
        texts[doc] = " ".join([*some(10), "zork", *some(draw.randrange(20))])
        toxic[doc] = 1
    texts |= {1: None, 2: "", 3: " \n", 4: "short", 5: "short"}
    return texts, {d: toxic.get(d, 0) for d in texts}, items


def brute_pipeline(texts, toxic, items):
    """Text or, where benchmark words were cut out, the words left of every document that stays."""
    kept = {d: t for d, t in texts.items() if not toxic[d]}
    kept = {d: kept[d] for d, (_, c) in brute_components(list(kept.items()), 5, 80).items() if c == d}
    seen, later = set(), {}
    for doc in sorted(kept):
        w, gone = SPACE.findall(kept[doc] or ""), set()
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        if not gone or len(gone) < len(w):
            later[doc] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else kept[doc]
    out = {}
    for doc, text in later.items():
        n, hit, _ = brute_hits(text, items)
        if len(hit) < n or not n:
            out[doc] = [x for i, x in enumerate(ALNUM.findall(lower(text))) if i not in hit] if hit else text or ""
    return out, len(kept), len(later)


def test_pipeline_matches_brute_force(spark, tmp_path):
    texts, toxic, items = corpus()
    rows = [(d, t, "en", "s", len(t or ""), 1, "x", 0.5, None) for d, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected, near, passages = brute_pipeline(texts, toxic, items)
    assert len(expected) < passages < near < len(texts) - 160      # every stage has work

    found, places = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        found.setdefault(r.doc_id, []).append((r.piece, bytes(r.ids)))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(found) == set(expected)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.PACKED_WITH))
    for doc, pieces in found.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces)), "<u4").tolist()
        assert ids[-1] == corpus_pipeline.END_ID
        text = tokenizer.decode(ids[:-1], skip_special_tokens=False)
        assert (ALNUM.findall(lower(text)) if isinstance(expected[doc], list) else text) == expected[doc]
    for pieces in places.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert ends[-1] <= 1024 and [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()]


def test_stages_take_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
