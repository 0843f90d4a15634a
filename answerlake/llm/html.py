"""Main text of web pages as a maximum-scoring subsequence (operator 1).

A page is a sequence of tags and words. Words score by the kind of block they stand in, tags
score negative, and one linear scan finds the contiguous region of the highest sum. The
weights are learned from the pages themselves: those that mark their article (an `article` or
`main` element) are the labelled ones, and the weight of a kind of block is the log odds of
its words standing inside that mark. The mark is no part of a block's kind, so the weights
serve pages without it. Blocks inside the region whose kind scores negative (an aside, a form,
reader comments) are left out. All pages count; what is kept of them is one number for each
of the most frequent kinds, MOST_KINDS at most, the rest being scored by their prior.

A block's kind is its element and the nearest enclosing element that groups content and is
not neutral, with its first class or id; mostly linked blocks are a kind of their own.

Defined cases: null, empty and tag-only html gives the empty text; unclosed elements end with
their parent; raw-text elements (script, style, ...) and comments are dropped whole; a page
without any positive block gives the empty text; ties go to the earlier, shorter region; rows
that repeat are extracted one by one; without labelled pages the priors decide.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_KINDS = 5000
LEAST_WORDS = 20
PRIOR_WORDS = 50.0
CLIP = 4.0

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|object|math|canvas|title)\b[^>]*>.*?(?:</\1\s*>|\Z)",
                 re.S | re.I)
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>")
NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br img picture source input meta link base".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GROUPS = frozenset("nav header footer aside form menu dialog fieldset figure table details div section ul ol dl address".split())
NEUTRAL = frozenset("html body article main section div ul ol dl table".split())
CLOSED_BY_BLOCK = frozenset(("p", "dt", "dd", "li", "option", "h1", "h2", "h3", "h4", "h5", "h6"))
# prior: names of parts of a page that are not its article
NOISE = frozenset("nav header footer aside form menu dialog fieldset address ad ads advert adverts advertisement banner sponsor sponsored promo "
                  "promotion popup modal overlay cookie cookies consent notice notices alert disclaimer copyright sidebar side widget related "
                  "recommended share sharing social comment comments reply replies discussion respond disqus navigation navbar breadcrumb "
                  "breadcrumbs toolbar pagination pager subscribe newsletter signup login search masthead topbar footnav toc tags button".split())


def blocks_of(page: str | None):
    """(kind, inside the mark, words, tags before it, text) of each block in page order."""
    page = RAW.sub(" ", page or "")
    stack: list[tuple[str, str | None, bool]] = []      # element, name of a group, in the mark
    out, at = [], 0
    text, linked, whole, tags, in_link = [], 0, 0, 0, 0

    def kind_now():
        leaf = next((n for n, _, _ in reversed(stack) if n not in INLINE), "body")
        group = next((g for _, g, _ in reversed(stack) if g), "")
        return leaf, group, bool(stack) and stack[-1][2]

    def flush():
        nonlocal text, linked, whole, tags
        plain = " ".join(html.unescape("".join(text)).split())
        if plain:
            leaf, group, marked = kind_now()
            if leaf in NEUTRAL:
                leaf = "block"
            kind = f"{group}>{leaf}" + (">a" if 2 * linked > whole else "")
            out.append((kind, marked, plain.count(" ") + 1, tags, plain))
            tags = 0
        text, linked, whole = [], 0, 0

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at: m.start()]
            text.append(piece)
            if not piece.isspace():
                whole += len(piece)
                linked += len(piece) if in_link else 0
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        tags += 1
        if name == "br":
            text.append(" ")
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None and (name not in CLOSED_BY_BLOCK or all(n not in GROUPS for n, _, _ in stack[depth + 1:])):
                del stack[depth:]
                in_link = 0
        elif name not in VOID:
            while stack and stack[-1][0] in CLOSED_BY_BLOCK and not (stack[-1][0] in ("li", "dd", "dt") and name not in ("li", "dd", "dt")):
                stack.pop()
            group = None
            named = [w for x in NAME.findall(m[3]) for w in WORD.findall("".join(x).lower())] if m[3] else []
            noisy = next((w for w in named if w in NOISE), None)
            if name in GROUPS or noisy:
                group = name if name not in NEUTRAL else ""
                if noisy or named:
                    group += "." + (noisy or named[0])
                group = group or None
            stack.append((name, group, (bool(stack) and stack[-1][2]) or name in ("article", "main")))
    text.append(page[at:])
    whole += len(page) - at
    flush()
    return out


def prior(kind: str) -> float:
    """Log odds before any page is seen."""
    group, leaf = kind.split(">")[:2]
    if any(w in NOISE for w in WORD.findall(group)):
        return -2.0
    return -1.0 if kind.endswith(">a") else 1.0 if leaf in ("p", "pre", "blockquote", "h1", "h2", "h3", "li", "td") else 0.2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            found = blocks_of(page)
            if any(marked for _, marked, *_ in found):
                for kind, marked, words, _, _ in found:
                    total.setdefault(kind, [0, 0])[marked] += words
        if len(total) > 100_000:        # a task's table stays small; counts add up later
            yield _rows(total)
            total = {}
    yield _rows(total)


def _rows(total: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())],
        names=["kind", "outside", "inside"])


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights of the most frequent kinds of block, from the pages that mark their article."""
    counts = pages.select("html").mapInArrow(_counted, "kind string, outside long, inside long").groupBy("kind").agg(
        F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    rows = counts.filter(F.col("outside") + F.col("inside") >= LEAST_WORDS).orderBy(
        F.desc(F.col("outside") + F.col("inside")), "kind").limit(MOST_KINDS).collect()
    out = {}
    for kind, outside, inside in rows:
        share = 1 / (1 + np.exp(-prior(kind)))
        odds = np.log((inside + PRIOR_WORDS * share) / (outside + PRIOR_WORDS * (1 - share)))
        out[kind] = float(np.clip(odds, -CLIP, CLIP))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest positive sum, by one scan."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


TAG_SCORE = -0.05
NOISE_SHARE = 0.1        # an aside is left out by its kind, so it needn't break the region in two


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found = blocks_of(page)
    scores, blocks = [], []
    for kind, _, words, tags, text in found:
        weight = weights.get(kind)
        weight = prior(kind) if weight is None else weight
        scores += [TAG_SCORE * tags, weight * words * (1 if weight > 0 else NOISE_SHARE)]
        blocks.append((weight, text))
    low, high = best_region(scores)
    return "\n".join(text for i, (weight, text) in enumerate(blocks) if low <= 2 * i + 1 < high and weight > 0)


def _extracted(batches: Iterator[pa.RecordBatch], weights: dict[str, float], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([main_text(page, weights) for page in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], names=[*names, "text"])


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The named columns of every page and its main text."""
    weights = learn_weights(pages)
    rows = pages.select(*columns, "html")
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns) + ", text string"
    return rows.mapInArrow(lambda x: _extracted(x, weights, list(columns)), schema)
