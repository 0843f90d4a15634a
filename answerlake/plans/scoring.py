"""Block scoring: a block of questions against a block of chunks as small matrix products.

Every question has to be compared with every chunk (the blend is normalised over
the whole corpus), but no (question, chunk) pair ever becomes a row: a block pair
gives only per-question extremes or its best few candidates. Spark merges those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 512


def half_up(values: np.ndarray, digits: int = 4) -> np.ndarray:
    scale = 10.0 ** digits
    return np.floor(values * scale + 0.5) / scale


@dataclass
class QuestionBlock:
    """The question side of one block as matrices."""

    rows: list[dict]                   # sorted by (question, part); part 0 is the whole question
    terms: list[str]
    entries: np.ndarray                # rows of (term, question, multiplicity), by term
    idf: np.ndarray                    # per term
    vectors: np.ndarray                # question x dims, unit length or zero
    places: list[str] = field(default_factory=list)
    asked: np.ndarray | None = None    # place x question
    closure: np.ndarray | None = None  # place x place: column p marks what covers p
    cities: np.ndarray | None = None
    names_route: np.ndarray | None = None

    @classmethod
    def of(cls, asked: pa.Table, covers: dict[str, tuple[str, ...]] | None, aliases: dict[str, str], cities) -> QuestionBlock:
        """From rows with weights (term, tf, idf), embedding and, where places count, their cover."""
        rows = sorted(asked.to_pylist(), key=lambda r: (str(r["query_id"]), r["part"]))
        idf = {w["term"]: w["idf"] for r in rows for w in r["weights"]}
        terms = sorted(idf)
        at = {t: i for i, t in enumerate(terms)}
        entries = np.array([(at[w["term"]], i, w["tf"]) for i, r in enumerate(rows) for w in r["weights"]], dtype=np.int32)
        vectors = np.array([r["embedding"] for r in rows], dtype=float).reshape(len(rows), len(rows[0]["embedding"]) if rows else 0)
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        entries = entries.reshape(-1, 3)
        rows = [{k: v for k, v in r.items() if k not in ("weights", "embedding")} for r in rows]
        block = cls(rows, terms, entries[np.argsort(entries[:, 0], kind="stable")], np.array([idf[t] for t in terms] or [0.0]),
                    np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0))
        if covers is not None:
            block.places = sorted(set(covers) | set(aliases.values()))
            where = {p: i for i, p in enumerate(block.places)}
            block.closure = np.eye(len(where))
            for p, above in covers.items():
                block.closure[[where[a] for a in above], where[p]] = 1.0
            block.asked = np.zeros((len(where), len(rows)))
            for i, r in enumerate(rows):
                block.asked[[where[p] for p in r["places"]], i] = 1.0
            block.cities = np.array([where[c] for c in cities], dtype=int)
            block.names_route = (block.asked.sum(axis=0) > 0) | np.array([bool(r["route_words"]) for r in rows], dtype=bool)
        return block

    def column(self, name: str) -> np.ndarray:
        return np.array([r[name] for r in self.rows], dtype=float)

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.stack([self.column(c) for c in ("lex_lo", "lex_hi", "dense_lo", "dense_hi")])

    @cached_property
    def kinds(self) -> list:
        return [r["kind"] for r in self.rows]

    @cached_property
    def flags(self) -> np.ndarray:
        return np.array([r["flags"] for r in self.rows], dtype=float).reshape(len(self.rows), len(self.rows[0]["flags"]) if self.rows else 0)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Distinct terms per question."""
        return np.bincount(self.entries[:, 1], minlength=len(self.rows))

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the entries of each term begin, and the end of the last."""
        return np.concatenate([[0], np.cumsum(np.bincount(self.entries[:, 0], minlength=max(len(self.terms), 1)))])

    @cached_property
    def weights(self) -> np.ndarray:
        """Per entry: multiplicity times inverse document frequency."""
        return self.entries[:, 2] * self.idf[self.entries[:, 0]]


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    avg_len: float = 1.0
    lexical_weight: float = 0.6
    heading_gain: float = 0.9
    route_factor: float = 0.75
    unasked_factor: float = 0.85
    kind_factor: float = 0.35
    topic_factor: float = 0.35
    exclusive_kinds: tuple[str, ...] = ("checked", "hand")
    pool: int = 15
    fusion: float = 0.0


def _counts(column: pa.Array, known: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, count) of a list column, for the known values only, by row and value."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
    hit = at >= 0
    code, n = np.unique(owner[hit] * width + at[hit], return_counts=True)
    return code // width, code % width, n.astype(float)


def _tally(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A list column as two: each row's distinct values, as places in one sorted dictionary, and their counts."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy(zero_copy_only=False)
    width = max(len(order), 1)
    place = np.empty(width, dtype=np.int64)
    place[order] = np.arange(len(order))
    owner, at = np.repeat(np.arange(len(lists), dtype=np.int64), sizes), found.indices
    if at.null_count:
        owner, at = owner[at.is_valid().to_numpy(zero_copy_only=False)], at.drop_null()
    code, n = np.unique(owner * width + place[at.to_numpy(zero_copy_only=False)], return_counts=True)
    ends = np.concatenate([[0], np.cumsum(np.bincount(code // width, minlength=len(lists)))]).astype(np.int32)
    values = pa.DictionaryArray.from_arrays(pa.array((code % width).astype(np.int32)), found.dictionary.take(pa.array(order)))
    return pa.ListArray.from_arrays(ends, values), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))


def compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Chunk features as they are stored: counted terms instead of tokens, spelt once a block."""
    terms, counts = _tally(batch.column("tokens"))
    made = {"terms": terms, "counts": counts, "length": pc.list_value_length(batch.column("tokens")),
            "heading_terms": _tally(batch.column("heading_tokens"))[0]}
    kept = {c: batch.column(c) for c in batch.schema.names if c not in ("tokens", "heading_tokens")}
    return pa.RecordBatch.from_pydict(kept | made)


#: What the stored blocks say of their rows: chunks, chunks with tokens, and tokens.
MEASURES = {"n": lambda b: b.num_rows, "sized": lambda b: b.num_rows - b.column("tokens").null_count,
            "words": lambda b: pc.sum(pc.list_value_length(b.column("tokens"))).as_py() or 0}


def _held(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, known value, place in the flattened list) of a column from ``_tally``, by row and value, as both are sorted."""
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(lists), dtype=np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    place = pc.fill_null(pc.index_in(flat.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
    value = place[flat.indices.to_numpy(zero_copy_only=False)]
    hit = np.flatnonzero(value >= 0)
    return owner[hit], value[hit], hit


HOLDERS_SCHEMA = "term string, df bigint"


def holders(block: pa.RecordBatch, asked: pa.Table) -> pa.Table:
    """How many chunks of a block hold each of the given terms."""
    flat = block.column("terms").flatten()
    many = np.bincount(flat.indices.to_numpy(zero_copy_only=False), minlength=len(flat.dictionary))
    wanted = pc.is_in(flat.dictionary, value_set=asked["term"].combine_chunks())
    return pa.table({"term": flat.dictionary, "df": pa.array(many, pa.int64())}).filter(wanted)


def _matrix(column: pa.Array, known: pa.Array, width: int) -> np.ndarray:
    """row x value counts of a list column, for the known values only."""
    row, value, n = _counts(column, known, width)
    out = np.zeros((len(column), width))
    out[row, value] = n
    return out


def _product(rows: int, row: np.ndarray, term: np.ndarray, value: np.ndarray, q: QuestionBlock, weight: np.ndarray) -> np.ndarray:
    """chunk x question sums over the terms both hold. A chunk's terms meet only the questions
    that have them, so the work follows the matches and not the number of all terms."""
    starts = q.starts
    many = starts[term + 1] - starts[term]
    first = np.repeat(starts[term] - np.cumsum(many) + many, many)
    at = first + np.arange(len(first))
    place = np.repeat(row, many) * len(q.rows) + q.entries[at, 1]
    return np.bincount(place, np.repeat(value, many) * weight[at], minlength=rows * len(q.rows)).reshape(rows, len(q.rows))


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and a mask of rows whose stored width is the active one."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    fresh = sizes == dims
    out = np.zeros((len(lists), dims))
    if dims and fresh.any():
        kept = lists.filter(pa.array(fresh))
        rows = kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[fresh] = np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
    return out, fresh


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, BLOCK):
        yield batch.slice(start, BLOCK)


def raw_scores(block: pa.RecordBatch, q: QuestionBlock, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(lexical, dense), each chunk x question."""
    row, term, at = _held(block.column("terms"), pa.array(q.terms, pa.string()))
    tf = block.column("counts").flatten().to_numpy(zero_copy_only=False)[at].astype(float)
    length = block.column("length").to_numpy(zero_copy_only=False).astype(float)[row]
    share = tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length / s.avg_len))
    lexical = _product(block.num_rows, row, term, share, q, q.weights)
    vectors, _ = _vectors(block.column("embedding"), q.vectors.shape[1])
    return lexical, vectors @ q.vectors.T


def _per_question(asked: pa.Table, q: QuestionBlock, columns: dict) -> pa.Table:
    return pa.table({"query_id": pa.array([r["query_id"] for r in q.rows], asked.schema.field("query_id").type),
                     "part": pa.array([r["part"] for r in q.rows], pa.int32())} | columns)


EXTREMES_SCHEMA = "query_id {id}, part int, lex_lo double, lex_hi double, dense_lo double, dense_hi double"


def extremes(chunks: pa.RecordBatch, asked: pa.Table, q: QuestionBlock, s: Settings) -> pa.Table:
    """The range of both raw scores of each question over a block of chunks."""
    lo, hi = np.full((2, len(q.rows)), np.inf), np.full((2, len(q.rows)), -np.inf)
    for block in blocks(chunks):
        for i, scores in enumerate(raw_scores(block, q, s)):
            lo[i], hi[i] = np.minimum(lo[i], scores.min(axis=0)), np.maximum(hi[i], scores.max(axis=0))
    found = _per_question(asked, q, {"lex_lo": lo[0], "lex_hi": hi[0], "dense_lo": lo[1], "dense_hi": hi[1]})
    return found if chunks.num_rows else found.slice(0, 0)


def _normalise(values, lo, hi):
    span = hi - lo
    flat = span < 1e-9
    return np.where(flat, 0.0, (values - lo) / np.where(flat, 1.0, span))


def final_scores(block: pa.RecordBatch, q: QuestionBlock, s: Settings):
    """Rounded final, lexical and dense scores and the four penalty flags."""
    lexical, dense = raw_scores(block, q, s)
    bounds = q.bounds
    score = (s.lexical_weight * _normalise(lexical, bounds[0], bounds[1])
             + (1 - s.lexical_weight) * _normalise(dense, bounds[2], bounds[3]))
    row, term, _ = _held(block.column("heading_terms"), pa.array(q.terms, pa.string()))
    found = _product(block.num_rows, row, term, np.ones(len(row)), q, np.ones(len(q.entries)))
    coverage = found / np.maximum(q.sizes, 1)
    score = score * (1 + s.heading_gain * coverage ** 2)
    shape = score.shape
    route = unasked = kind = topic = np.zeros(shape, bool)
    if q.places:
        stated = _matrix(block.column("places"), pa.array(q.places, pa.string()), len(q.places)) > 0
        listing = (stated[:, q.cities].sum(axis=1) >= 2)[:, None]
        missing = (stated.astype(float) @ q.closure) == 0
        route = listing & ((missing.astype(float) @ q.asked) > 0)
        unasked = listing & ~q.names_route[None, :] & ~route
        score = np.where(route, score * s.route_factor, np.where(unasked, score * s.unasked_factor, score))
    if any(k is not None for k in q.kinds):
        have = np.array(block.column("kind").to_pylist(), dtype=object)[:, None]
        want = np.array(q.kinds, dtype=object)[None, :]
        limited = np.isin(want.astype(str), s.exclusive_kinds)
        kind = limited & (have != None) & (have != want)  # noqa: E711 (elementwise)
        score = np.where(kind, score * s.kind_factor, score)
    if q.flags.shape[1]:
        mine = np.array(block.column("topic_flags").to_pylist(), dtype=float).reshape(block.num_rows, -1)
        topic = (mine @ q.flags.T) > 0
        score = np.where(topic, score * s.topic_factor, score)
    return half_up(score), half_up(lexical), half_up(dense), (route, unasked, kind, topic)


BEST_SCHEMA = "query_id {id}, part int, best double"


def best_scores(chunks: pa.RecordBatch, asked: pa.Table, q: QuestionBlock, s: Settings) -> pa.Table:
    """Each question's best final score in a block of chunks (for fusion)."""
    top = np.zeros(len(q.rows))
    for block in blocks(chunks):
        top = np.maximum(top, final_scores(block, q, s)[0].max(axis=0))
    return _per_question(asked, q, {"best": top})


CANDIDATE_SCHEMA = ("query_id {id}, chunk_id string, doc_id {doc}, chunk_no int, score double, lexical_score double, "
                    "dense_score double, route_mismatch boolean, route_unasked boolean, kind_mismatch boolean, "
                    "topic_mismatch boolean, matched_subquery string")


def _fused(q: QuestionBlock, s: Settings, score: np.ndarray, lexical: np.ndarray, dense: np.ndarray, leaders: np.ndarray):
    """Lifts a chunk's score for a whole question to that of the question's best matching part."""
    matched = np.tile(np.arange(score.shape[1], dtype=np.int32), (score.shape[0], 1))
    score, lexical, dense, best = score.copy(), lexical.copy(), dense.copy(), q.column("best")
    for i, end in zip(leaders, [*leaders[1:], len(q.rows)], strict=True):
        own_best = best[i] or 1.0
        for j in range(i + 1, end):
            lifted = score[:, j] / (best[j] or 1.0) * own_best * s.fusion
            up = lifted > score[:, i]
            score[up, i] = half_up(lifted[up])
            # The part's best chunk was lifted to exactly this score, wherever it lies.
            own_best = max(own_best, float(half_up(np.array(own_best * s.fusion))))
            lexical[up, i], dense[up, i], matched[up, i] = lexical[up, j], dense[up, j], j
    return score, lexical, dense, matched


def candidates(chunks: pa.RecordBatch, asked: pa.Table, q: QuestionBlock, s: Settings) -> pa.Table:
    """The ``pool`` best chunks of each question in a block of chunks, ties in corpus order.
    Questions are fused with their parts when ``fusion`` is above zero."""
    leaders = np.flatnonzero(np.array([r["part"] == 0 for r in q.rows], dtype=bool))
    wanted = np.zeros(len(q.rows), bool)
    wanted[leaders] = True
    ids = np.array([r["query_id"] for r in q.rows], dtype=object)
    texts = np.array([r["text"] for r in q.rows], dtype=object)
    kept, floor = None, np.full(len(q.rows), -np.inf)
    for block in blocks(chunks):
        score, lexical, dense, flags = final_scores(block, q, s)
        matched = np.tile(np.arange(len(q.rows)), (block.num_rows, 1))
        if s.fusion > 0:
            score, lexical, dense, matched = _fused(q, s, score, lexical, dense, leaders)
        if block.num_rows > s.pool:
            cut = np.partition(score, block.num_rows - s.pool, axis=0)[block.num_rows - s.pool]
            mask = score >= np.maximum(cut, floor)
        else:
            mask = score >= floor
        row, col = np.nonzero(mask & wanted)
        ident = {c: np.array(block.column(c).to_pylist(), dtype=object)[row] for c in ("chunk_id", "doc_id", "chunk_no")}
        frame = pd.DataFrame({
            "at": col, **ident, "score": score[row, col], "lexical_score": lexical[row, col],
            "dense_score": dense[row, col], "route_mismatch": flags[0][row, col], "route_unasked": flags[1][row, col],
            "kind_mismatch": flags[2][row, col], "topic_mismatch": flags[3][row, col], "matched": matched[row, col]})
        kept = frame if kept is None else pd.concat([kept, frame])
        kept = kept.sort_values(["at", "score", "doc_id", "chunk_no"], ascending=[True, False, True, True])
        kept = kept.groupby("at", sort=False).head(s.pool)
        full = kept.groupby("at")["score"].agg(["size", "min"])
        full = full[full["size"] >= s.pool]
        floor[full.index.to_numpy()] = full["min"].to_numpy()
    names = [("query_id", asked.schema.field("query_id").type), ("chunk_id", pa.string()), ("doc_id", chunks.schema.field("doc_id").type),
             ("chunk_no", pa.int32()), ("score", pa.float64()), ("lexical_score", pa.float64()), ("dense_score", pa.float64()),
             ("route_mismatch", pa.bool_()), ("route_unasked", pa.bool_()), ("kind_mismatch", pa.bool_()), ("topic_mismatch", pa.bool_()),
             ("matched_subquery", pa.string())]
    if kept is None:
        return pa.table({n: pa.array([], t) for n, t in names})
    at, matched = kept["at"].to_numpy(), kept["matched"].to_numpy()
    said = np.where(matched == at, None, texts[matched]) if len(at) else texts[:0]
    made = {"query_id": ids[at], "matched_subquery": said}
    return pa.table({n: pa.array(made.get(n, kept[n].to_numpy() if n not in made else None), t) for n, t in names})


def nearest(k: int):
    """Block function: the k nearest vectors of each question by cosine, ties by name."""

    def run(vectors: pa.RecordBatch, asked: pa.Table) -> pa.Table:
        names = [("query_id", asked.schema.field("query_id").type), ("vec_id", vectors.schema.field("vec_id").type), ("dense", pa.float64())]
        kept = None
        held = asked["embedding"].to_pylist()
        matrix = np.array(held, dtype=float).reshape(len(held), len(held[0]) if held else 0)
        norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
        ids = np.array(asked["query_id"].to_pylist(), dtype=object)
        for block in blocks(vectors) if len(matrix) else ():
            rows, _ = _vectors(block.column("embedding"), matrix.shape[1])
            score = half_up(rows @ matrix.T, 6)
            found, n = np.array(block.column("vec_id").to_pylist(), dtype=object), block.num_rows
            mask = score >= np.partition(score, n - k, axis=0)[n - k] if n > k else np.ones_like(score, bool)
            row, col = np.nonzero(mask)
            frame = pd.DataFrame({"at": col, "vec_id": found[row], "dense": score[row, col]})
            kept = frame if kept is None else pd.concat([kept, frame])
            kept = kept.sort_values(["at", "dense", "vec_id"], ascending=[True, False, True]).groupby("at").head(k)
        if kept is None:
            return pa.table({n: pa.array([], t) for n, t in names})
        made = {"query_id": ids[kept["at"].to_numpy()], "vec_id": kept["vec_id"].to_numpy(), "dense": kept["dense"].to_numpy()}
        return pa.table({n: pa.array(made[n], t) for n, t in names})

    return run


def select_diverse(pool: pd.DataFrame, k: int, lam: float, base: float = 0.6, step: float = 0.3,
                   stale: bool = False) -> list[int]:
    """Greedy marginal-relevance order over one question's pool (at most a few
    rows, best first): positions of the chosen rows."""
    n = len(pool)
    if lam >= 1.0 or n <= 1:
        return list(range(min(k, n)))
    score = pool["score"].to_numpy(float)
    relevance = score / (score.max() or 1.0)
    docs = pool["doc_id"].to_numpy()
    widths = {len(v) if v is not None else 0 for v in pool["embedding"]}
    similar = np.zeros((n, n))
    if not stale and len(widths) == 1 and widths != {0}:
        vec = np.stack(pool["embedding"].to_numpy()).astype(float)
        norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        vec = np.divide(vec, norm, out=np.zeros_like(vec), where=norm > 0)
        similar = vec @ vec.T
    chosen = [0]
    while len(chosen) < min(k, n):
        repeats = (docs[:, None] == docs[chosen][None, :]).sum(axis=1)
        redundancy = np.where(repeats > 0, np.minimum(1.0, base + step * (repeats - 1)), 0.0)
        if not stale:
            redundancy = np.maximum(similar[:, chosen].max(axis=1), redundancy)
        # Rounded so that exact copies tie and keep their pool order.
        value = np.round(lam * relevance - (1 - lam) * redundancy, 10)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
    return chosen
