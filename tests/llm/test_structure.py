"""Conversation repair, conversation trie and SimHash against brute force, and their odd inputs."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
import xxhash

from answerlake.llm.conversation_trie import conversation_trie, rebuilt_trie
from answerlake.llm.repair import align, damaged, repaired, repaired_turns
from answerlake.llm.simhash import fingerprint, join_tries, near_links, simhash_components

CONV = "conv_id long, turn long, role string, text string"
NEXT = {"": ("u", "U"), "S": ("u", "U"), "U": ("a", "A"), "A": ("u", "U")}


def cheapest(flags):
    """Cost and ASCII-least audit by trying every edit at every turn."""
    @lru_cache(None)
    def best(i, state, inserted):
        out = [(0, "")] if i == len(flags) and state in ("", "A") else []
        symbol, after = NEXT[state]
        if inserted < 3:
            cost, audit = best(i, after, inserted + 1)
            out.append((cost + 2, "I" + audit))
        if i < len(flags):
            flag = flags[i]
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 3, "D" + audit))
            if flag != "x":
                if state == "" and flag.lower() == "s":
                    cost, audit = best(i + 1, "S", 0)
                    out.append((cost + flag.isupper(), "K" + audit))
                cost, audit = best(i + 1, after, 0)
                kept = flag.lower() == symbol
                out.append((cost + flag.isupper() + (0 if kept else 2), ("K" if kept else "R") + audit))
        return min(out, default=(10**9, ""))
    return best(0, "", 0)


def brute_repair(rows, damage):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = role if role is not None else " ", text if text is not None else " "
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        turns.sort()
        seen, flags, faults = set(), [], [0, 0, 0]
        for _, _, role, text in turns:
            inked = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not inked else 1 if (role, text) in seen else 2 if inked[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            flags.append("x" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
        cost, audit = cheapest("".join(flags))
        todo, said, place = iter(turns), [], -(sum(c != "D" for c in audit) % 2)
        for letter in audit:
            _, _, role, text = next(todo) if letter != "I" else (0, 0, None, "")
            if letter != "D":
                said.append(f"{role if letter == 'K' else ('user', 'assistant')[place % 2]}:{text}")
                place += 1
        numbered = {t for known, t, _, _ in turns if known}
        initials = [r[:1] for _, _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (max(numbered) - min(numbered) + 1 - len(numbered) if numbered else 0, *faults, illegal, cost, audit,
                     hashlib.sha256("\n".join(said).encode()).hexdigest(), said)
    return out


def talk_rows(seed):
    draw, rows = random.Random(seed), []
    texts = ["Hi.", "Yes?", "no end", " \n", "", "Näh! \t", "a.\xa0", None, "long " * 100 + "."]
    for conv in [*range(30), None]:
        for turn in range(draw.randrange(1, 14)):
            role = ("user", "assistant")[turn % 2]
            if draw.random() < .35:
                role = draw.choice(["user", "assistant", "system", "usher", "tool", "", None])
            text = draw.choice(texts) if draw.random() < .4 else f"Turn {turn}."
            rows.append((conv, turn if draw.random() < .95 else None, role, text))
    return rows + rows[:3] + [(77, None, "user", "a."), (77, None, "assistant", "b.")]


@pytest.mark.parametrize(("seed", "damage", "segment", "hold"), [(1, True, 512, 1 << 20), (2, False, 512, 200), (3, True, 3, 300), (4, False, 2, 1 << 20)])
def test_repair_matches_brute_force(spark, seed, damage, segment, hold):
    rows = talk_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV + ", code string")
    df = damaged(df) if damage else df
    want = brute_repair(rows, damage)
    found = repaired(df, segment, hold)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    said = {}
    for r in sorted(repaired_turns(df, found).collect(), key=lambda r: (str(r.conv_id), r.place)):
        said.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert said == {k: v[-1] for k, v in want.items() if v[-1]}


def test_alignment_is_exact():
    draw = random.Random(5)
    for _ in range(400):
        n = draw.choice([0, 1, 2, 3, 6, 12, 24])
        flags = "".join(draw.choice("suauaUAxoS") if draw.random() < .6 else "ua"[i % 2] for i in range(n))
        assert align(flags.encode()) == cheapest(flags)


def test_repair_of_nothing(spark):
    assert repaired(damaged(spark.createDataFrame([], CONV))).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repaired(damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def brute_trie(rows, rebuild):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, digest, len(text.encode()), role, text))
    turns = {c: [(t[4], t[5]) for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:]) if rebuild else tuple(turns[c])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ends = ",".join(str(c) for c in sorted(c for c in members if paths[c] == p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
                    sum(q not in inner for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_matches_brute_force(spark, rebuild, shard_bytes):
    draw = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(draw.choice([1, 2, 3, 5, 9, 14])):
            text = f"t{turn}" if draw.random() < .7 else draw.choice(["é", "", None, "z" * 3000])
            rows.append((conv, turn if draw.random() < .97 else None, draw.choice(["user", "user", "user", None]), text))
    rows += rows[:2] + [(None, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV + ", unit string")
    found = (rebuilt_trie if rebuild else conversation_trie)(df, shard_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    assert rebuilt_trie(spark.createDataFrame([], CONV)).collect() == []


def brute_print(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i: i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(prints, budget=4):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= budget:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints_match_brute_force(monkeypatch):
    draw = random.Random(1)
    for part in (1 << 20, 7, 40):
        monkeypatch.setattr("answerlake.llm.simhash.PART_BYTES", part)
        for n in (0, 1, 2, 3, 4, 5, 60, 900):
            text = " ".join(draw.choice(["Aé", "b", "ÜC", "dd", "\xa0e"]) for _ in range(n))
            assert fingerprint(text) == brute_print(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


def near_prints(seed, m):
    draw = np.random.default_rng(seed)
    out = draw.integers(0, 2**64, max(1, m // 8), dtype=np.uint64)[draw.integers(0, max(1, m // 8), m)]
    for i in range(m):
        for _ in range(draw.integers(0, 6)):
            out[i] ^= np.uint64(1) << np.uint64(draw.integers(0, 64))
    return np.unique(out)


@pytest.mark.parametrize("seed", range(8))
def test_trie_join_spans_the_links(seed):
    prints = near_prints(seed, 200)
    found = join_tries(prints, len(prints), 0, 0, 4)
    assert len(found) < len(prints)
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in found:
        assert (int(prints[a]) ^ int(prints[b])).bit_count() <= 4
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(prints))] == classes(prints)


def test_subtrees_lose_no_link(spark):
    prints = near_prints(11, 400)
    prints = np.unique(np.concatenate([prints, prints[:1] ^ np.arange(60, dtype=np.uint64)]))      # a crowded subtree
    df = spark.createDataFrame([(int(p.astype(np.int64)), i) for i, p in enumerate(prints)], "print long, rep long")
    up = list(range(len(prints)))
    for r in sorted(near_links(df, least=20).collect()):
        old, new = up[r.a], up[r.b]
        up = [min(old, new) if x in (old, new) else x for x in up]
    assert up == classes(prints)


def test_simhash_components_match_brute_force(spark):
    draw, rows = random.Random(4), [(0, None), (1, " \n"), (2, "one"), (3, "One"), (4, "two words")]
    base = [[f"w{draw.randrange(200)}" for _ in range(draw.choice([5, 60, 300]))] for _ in range(12)]
    for i in range(90):
        text = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2])):
            text[draw.randrange(len(text))] = "new"
        rows.append((10 + i, " ".join(text)))
    rows += [rows[7], (None, rows[9][1])]
    got = simhash_components(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int"))
    ids = [r for r in rows if r[0] is not None]
    prints = [brute_print(t) for _, t in ids]
    roots = classes(prints)
    want = {i: (f"{p:016x}", ids[roots[k]][0]) for k, ((i, _), p) in enumerate(zip(ids, prints, strict=True))}
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found if r.doc_id is not None} == want
    assert [(r.fingerprint, r.component_id) for r in found if r.doc_id is None] == [(want[rows[9][0]][0], None)]


def test_simhash_repeated_ids_and_nothing(spark):
    one, other = "a b c d e f g h", "q r s t u v w x y z"
    rows = [(5, one), (5, other), (3, other), (9, one)]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (9, 3)]
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
