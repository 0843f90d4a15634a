"""Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from answerlake.llm.decontaminate import FMIndex, WaveletMatrix, contamination, decontaminated
from answerlake.llm.jaccard import Bands, _folded, _sketch, jaccard_components, open_pairs, signatures, sketches_of
from answerlake.llm.shared import components
from answerlake.llm import substrings
from answerlake.llm.substrings import without_repeats

SPACE = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = SPACE.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets, parent = {i: shingles(t, n) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * every:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "ünï"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b"), (6, "a b c"), (7, "a b\xa0c d")]
    base = [[draw.choice(words) for _ in range(draw.choice([4, 9, 30, 80, 200]))] for _ in range(14)]
    for i in range(120):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((10 + i, draw.choice([" ", "  ", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_components_match_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, n, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    draw, bands = np.random.default_rng(3), Bands(percent)
    for _ in range(300):
        size = int(draw.integers(1, 120))
        a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(draw.integers(0, 1 + size // 8)):], draw.integers(0, 2**63, int(draw.integers(0, 1 + size // 8)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            one, two = signatures([a, b], bands)
            assert len(np.intersect1d(one, two))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(7, text), (7, text), (9, text), (None, text)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (7, 7), (7, 7), (9, 7)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    assert without_repeats(empty).count() == 0
    assert contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_open_pairs_use_the_sketch_of_every_text_of_a_document(spark):
    # 3 and 5 share a signature with 1, the group's smallest, but only the second text of 3 is like 5
    texts = [(3, 10, [10, *[0] * 127]), (3, 20, [0] * 108 + [1] * 20), (5, 20, [0] * 108 + [1] * 20)]
    sized = spark.createDataFrame([(d, n, bytearray(x)) for d, n, x in texts], "doc_id long, n_shingles long, sketch binary")
    members = spark.createDataFrame([(d, 77, 3, 1) for d in (1, 3, 5)], "doc_id long, sig long, cnt long, pivot long")
    found = spark.createDataFrame([], "node long, component long")
    assert [tuple(r) for r in open_pairs(members, found, sketches_of(sized), 80).collect()] == [(3, 5)]


@pytest.mark.parametrize("block", [4, 2048])
def test_crowds_of_copies_and_near_copies(spark, monkeypatch, block):
    """A third of the rows hold one text, another third near copies of one, some linked and some just not."""
    monkeypatch.setattr("answerlake.llm.jaccard.BLOCK", block)
    draw = random.Random(7)
    one = " ".join(f"c{i}" for i in range(60))
    base = [f"n{i}" for i in range(120)]
    rows = [(i, one) for i in range(100, 140)]
    for i in range(200, 240):
        text = list(base)
        for at in draw.sample(range(len(text)), draw.choice([1, 2, 4, 5, 6])):
            text[at] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(50))) for i in range(40)] + [(200, one)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, sigs int, key string")
    found = jaccard_components(df, 5, 80).collect()
    by = {}
    for d, t in rows:
        by.setdefault(d, []).append(t)
    nodes = [(d, t) for d, ts in by.items() for t in ts]
    want = brute_components([(i, t) for i, (_, t) in enumerate(nodes)], 5, 80)
    up = {d: d for d in by}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (d, _) in enumerate(nodes):
        a, b = root(d), root(nodes[want[i][1]][0])
        up[max(a, b)] = min(a, b)
    assert {(r.doc_id, r.component_id) for r in found} == {(d, root(d)) for d in by} and len(found) == len(rows)


@pytest.mark.parametrize("size", [80, 900, 4000])
def test_sketches_never_exceed_the_difference(size):
    draw = np.random.default_rng(size)
    a = np.unique(draw.integers(0, 2**63, size, dtype=np.uint64))
    for cut in (0, 1, size // 10, size // 2):
        b = np.unique(np.concatenate([a[cut:], draw.integers(0, 2**63, cut, dtype=np.uint64)]))
        one, two = _folded([_sketch(a), _sketch(b)])
        assert np.bitwise_count(one ^ two).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == dict.fromkeys(range(51), 0) | dict.fromkeys(range(100, 160), 100)


def brute_kept(rows, width=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = SPACE.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            window = tuple(w[i:i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        out[doc] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def passages(seed, count=60):
    draw = random.Random(seed)
    shared = [" ".join(draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(draw.choice([19, 20, 21, 60]))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "ha " * 70), (3, " ".join(map(str, range(19))))]
    for i in range(count):
        parts = [" ".join(f"u{draw.randrange(5000)}" for _ in range(draw.randrange(30)))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(shared), " ".join(f"u{draw.randrange(5000)}" for _ in range(draw.randrange(10)))]
        rows.append((10 + i, draw.choice([" ", "\n", "\t "]).join(parts)))
    return rows


def test_a_frequent_line_is_split_over_buckets(spark, monkeypatch):
    draw = random.Random(11)
    line = " ".join(f"line{i}" for i in range(24))
    rows = [(i, " ".join([*(f"u{draw.randrange(9999)}" for _ in range(30)), line, *(f"u{draw.randrange(9999)}" for _ in range(30))])) for i in range(400)]
    rows += [(1000 + i, t) for i, t in passages(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 12_000)
    monkeypatch.setattr(substrings, "MOST_WINDOWS", 1_000)
    sent, buckets = substrings.packed(docs.filter("text is not null"), sum(len(t or "") for _, t in rows))
    windows = {}
    for r in sent.collect():
        head = np.frombuffer(substrings.zstandard.ZstdDecompressor().decompress(r.head), np.int64).reshape(4, -1)
        n = head.shape[1] if r.bucket >= buckets else (head[2] - substrings.WINDOW + 1)[head[3] == 1].sum()
        windows[r.bucket] = windows.get(r.bucket, 0) + n
    assert max(windows) >= buckets and max(windows.values()) <= 1_000
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(docs, digest=True).collect()}
    assert found == brute_kept(rows)


def test_repeats_match_brute_force(spark):
    rows = passages(5)
    found = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_kept(rows)


def test_repeats_of_rows_without_id_or_with_the_same_id(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(1, text, 5), (1, text, 6), (None, text, 7), (2, text, None)]
    found = without_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept long"), ("doc_id", "kept", "text")).toDF(
        "doc_id", "other", "text", "n_words", "n_removed", "clean").collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.clean == text) for r in found) == [(-1, 0, True), (1, 0, True), (1, 0, True), (2, 30, False)]


def test_long_text(spark):
    text = " ".join(f"x{i % 70001}" for i in range(140_000))
    found = without_repeats(spark.createDataFrame([(1, text), (2, "z" * 3_000_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 140_000 - 70_001, 2: 0}


ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width=10):
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        b = ALNUM.findall(lower(body))
        n = min(width, len(b))
        windows = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), hit, sorted(found)


def test_contamination_matches_brute_force(spark):
    draw = random.Random(9)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 9, 10, 14])))) for i in range(8)] + [(20, None), (21, "..."), (3, "extra item words")]
    rows = [(0, None), (1, ""), (2, "?!")]
    for i in range(60):
        parts = [" ".join(draw.choice([*vocabulary, "out", "side"]) for _ in range(draw.randrange(30)))]
        parts += [items[draw.randrange(8)][1].upper() for _ in range(draw.randrange(3))]
        draw.shuffle(parts)
        rows.append((10 + i, draw.choice([" ", ", ", "-"]).join(parts)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    texts = dict(rows)
    for r in contamination(docs, bench).collect():
        n, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, {i for s in r.spans for i in range(s.low, s.high)}, r.items) == (n, hit, found)
    for r in decontaminated(docs, bench).collect():
        n, hit, _ = brute_hits(texts[r.doc_id], items)
        assert len(ALNUM.findall(lower(r.text))) == n - len(hit) if hit else r.text == texts[r.doc_id]
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in contamination(docs, none).collect())


def test_wavelet_matrix_and_index():
    draw = np.random.default_rng(1)
    symbols = draw.integers(1, 9, 500)
    matrix = WaveletMatrix(symbols, 8)
    at = np.arange(501)
    for s in range(9):
        assert (matrix.rank(np.full(501, s), at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
    assert (matrix.access(np.arange(500)) == symbols).all()
    index = FMIndex(symbols, np.array([0, 100, 101, 300]), 8)
    for pattern in ([3], [3, 4], [1, 1, 2]):
        low, high = index.search([np.array(pattern)])
        found = sorted(index.locate(np.arange(low[0], high[0])))
        runs = [range(0, 100), range(100, 101), range(101, 300), range(300, 500)]
        assert found == [i for r in runs for i in r if i + len(pattern) <= r.stop and symbols[i:i + len(pattern)].tolist() == pattern]
