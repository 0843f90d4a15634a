"""Token ids of texts by the tokenizers library, which sees each distinct word of a task once.

For the two splitting rules below a text splits into words before anything is merged, so the
ids of a text are those of its words in order. Words are found here only in texts made of
characters whose class is beyond doubt (ASCII, Latin letters, common punctuation); any other
text, any text that holds the string of an added token, and any tokenizer with another rule,
goes to the library whole.

New words go to the library many to a text, set apart so that none touches the next; where a
word's ids begin or end is told by the vocabulary. Where white space belongs to no word, they go
to a copy of the tokenizer that only splits at it, since the rules leave such words as they are.
Words are numbers from then on: a text's ids are gathered by numpy from one array, no object is
made for a word that is known; there only the distinct stretches between white space in a batch
are split into words.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

# fixed values: the word rules of two public vocabularies, for the characters in SAFE
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = "¡£§«»¿–—‘-‚“-„…€"
SAFE = re.compile(f"[^\\t\\n\\r -~{LETTER}{MARKS}]")
# the same without letters that lower-casing takes out of LETTER, as Ɓ and İ
SAFE_LOWERED = re.compile("[^\\t\\n\\r -~" + "".join(c for c in map(chr, range(0xC0, 0x250)) if re.fullmatch(f"[{LETTER}]", c.lower())) + MARKS + "]")
BYTE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\\s0-9{LETTER}]+|\\s+(?!\\S)|\\s+")
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s0-9{LETTER}]+")
PLAIN_LINES = re.compile(PLAIN_WORDS.pattern + "|\n")

CACHED_WORDS = 800_000
WORDS_AT_ONCE = 1_000

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")        # a task has one core


class Numbers(dict):
    """Number of each word, by first sight; new words are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def _room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of an array one after the other, and where each ends; a 0 in front."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends


def _sliced(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    data, places = ids.tobytes(), (4 * bounds).tolist()
    return [data[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str, most_words: int | None = None):
        self.most_words = most_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        added = [x["content"].lower() for x in spec.get("added_tokens") or [] if x.get("content")]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words, self.lower = self._rule(spec)
        self.safe = SAFE_LOWERED if self.lower else SAFE
        self.plain = self.tokenizer
        if self.lower:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()
        vocabulary = self.tokenizer.get_vocab() if self.words else {}
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)     # ids that end a word, or begin one with its space
        self.edge[[i for t, i in vocabulary.items() if (suffix and t.endswith(suffix) if self.lower else t.startswith("Ġ"))]] = True
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1

    def _forget(self):
        self.known, self.used = Numbers(), 0
        self.flat, self.start, self.size = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        if self.lower:
            self.known["\n"] = 0       # has no ids

    @staticmethod
    def _rule(spec: dict):
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not normal:
            return BYTE_WORDS, False
        steps = [x.get("type") for x in before.get("pretokenizers", [])]
        if steps == ["Split", "ByteLevel"] and [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            return PLAIN_WORDS, True
        return None, False

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ends(self, ids: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word of a text of such words begin and end."""
        if kind == "ended":
            ends = np.flatnonzero(self.edge[ids]) + 1
            return np.concatenate([[0], ends[:-1]]), ends
        if kind == "spaced":
            begins = np.flatnonzero(self.edge[ids])
            return begins, np.append(begins[1:], len(ids))
        lines = np.flatnonzero(ids == self.line)
        return np.concatenate([[0], lines + 1]), np.append(lines, len(ids))

    def _store(self, numbers: np.ndarray, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used: self.used + len(ids)] = ids
        self.start[numbers], self.size[numbers] = self.used + begins, ends - begins
        self.used += len(ids)

    def _learn(self, words: list[str], first: int) -> None:
        """Stores the ids of new words, whose numbers begin at `first`."""
        self.start, self.size = _room(self.start, first + len(words)), _room(self.size, first + len(words))
        kinds: dict[str, list[int]] = {"ended": [], "spaced": [], "lines": [], "alone": []}
        if self.lower:
            kinds["ended"] = list(range(len(words)))
        else:
            for i, word in enumerate(words):
                kinds["alone" if word.isspace() else "spaced" if word[0] == " " else "lines"].append(i)
        alone = kinds.pop("alone")
        for kind, own in kinds.items():
            joint = {"ended": " ", "spaced": "", "lines": "\n"}[kind]
            for at in range(0, len(own), WORDS_AT_ONCE):
                some = own[at: at + WORDS_AT_ONCE]
                ids = np.array(self.plain.encode_batch_fast([joint.join([words[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
                begins, ends = self._ends(ids, kind)
                if len(begins) == len(ends) == len(some) and begins[0] == 0 and ends[-1] == len(ids):
                    self._store(np.array(some) + first, begins, ends, ids)
                else:
                    alone += some
        for i, ids in zip(alone, self._encode([words[i] for i in alone]), strict=True):
            self._store(np.array([first + i]), np.zeros(1, np.int64), np.array([len(ids) // 4]), np.frombuffer(ids, "<u4"))

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _taught(self, first: int) -> None:
        if self.known.new:
            self._learn(self.known.new, first)
            self.known.new = []

    def _by_words(self, texts: list[str]) -> list[bytes]:
        first = len(self.known)
        numbers = [self._numbers(self.words.findall(t)) for t in texts]
        self._taught(first)
        every = np.concatenate(numbers)
        ids, ends = _gathered(self.flat, self.start[every], self.size[every])
        return _sliced(ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in numbers])])])

    def _by_stretches(self, texts: list[str]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        stretches = lists.flatten().dictionary_encode()
        first = len(self.known)
        distinct = pa.LargeListArray.from_arrays([0, len(stretches.dictionary)], stretches.dictionary)
        lines = pc.binary_join(distinct, pa.scalar("\n", pa.large_string()))[0].as_py() + "\n" * (len(stretches) > 0)
        words = self._numbers(PLAIN_LINES.findall(lines))
        self._taught(first)
        ids, ends = _gathered(self.flat, self.start[words], self.size[words])
        end = ends[np.flatnonzero(words == 0)]           # a line for each distinct stretch
        start = np.concatenate([[0], end[:-1]])
        which = stretches.indices.to_numpy()
        ids, ends = _gathered(ids, start[which], (end - start)[which])
        return _sliced(ids, ends[lists.offsets.to_numpy()])

    def forget(self) -> None:
        """Lets go of the known words. A worker that rests, or runs another kind of task, holds
        none: Spark takes its workers in turn, so that each would come to hold as many as it may."""
        self._forget()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > (self.most_words or CACHED_WORDS):
            self._forget()
        split, safe, whole = [], [], []
        for i, text in enumerate(texts):
            text = text or ""
            lowered = text.lower() if self.added or self.lower else text
            if self.words is None or self.safe.search(text) or self.added and self.added.search(lowered):
                whole.append((i, text))
            else:
                split.append(i)
                safe.append(lowered if self.lower else text)
        out: list[bytes] = [b""] * len(texts)
        if split:
            for i, ids in zip(split, self._by_stretches(safe) if self.lower else self._by_words(safe), strict=True):
                out[i] = ids
        if whole:
            for (i, _), ids in zip(whole, self._encode([t for _, t in whole]), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, most_words: int | None = None) -> Encoder:
    """The task's encoder of a vocabulary file; a Python worker keeps it for its next tasks."""
    if (path, most_words) not in _ENCODERS:
        _ENCODERS[path, most_words] = Encoder(path, most_words)
    return _ENCODERS[path, most_words]
