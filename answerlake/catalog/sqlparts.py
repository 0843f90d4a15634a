"""SQL fragments of the oracle: the text rules written for DuckDB."""

from __future__ import annotations

from answerlake.functions import vocabulary as v
from answerlake.functions.vocabulary import Vocabulary

# The word rules the test corpus is searched with.
CORPUS = Vocabulary(
    phrase_rules=((r"with\s+that", "withthat"), (r"de\s+la", "dela")),
    synonyms={"thes": ("thent", "these reated"), "thnt": ("thint",), "onths": ("month onth",),
              "leaux": ("eaux",), "que": ("quel elle",), "ting": ("tings inging",)},
)


def lit(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def names(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def array(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]::VARCHAR[]"


def fold(t: str) -> str:
    return (f"CASE WHEN length({t}) <= 3 OR regexp_full_match({t}, '[0-9]+') OR {t} IN {names(v.PLURAL_KEEP)} THEN {t} "
            f"WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' "
            f"WHEN regexp_matches({t}, '(sses|shes|ches|xes|zes)$') THEN left({t}, length({t}) - 2) "
            f"WHEN {t} LIKE '%ss' THEN {t} WHEN {t} LIKE '%s' THEN left({t}, length({t}) - 1) ELSE {t} END")


def rewrite(x: str, vocab: Vocabulary = CORPUS) -> str:
    for pattern, word in vocab.phrase_rules:
        x = f"regexp_replace({x}, '(?i){pattern}', '{word}', 'g')"
    return x


def tokens(x: str, vocab: Vocabulary = CORPUS) -> str:
    return (f"list_transform(list_filter(regexp_extract_all(lower({rewrite(x, vocab)}), '[a-z0-9]+'), "
            f"lambda t: t NOT IN {names(vocab.stop_words)}), lambda t: {fold('t')})")


def expand(toks: str, vocab: Vocabulary = CORPUS) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {array(w)}" for k, w in vocab.folded_synonyms().items())
    return f"list_concat({toks}, flatten(list_transform({toks}, lambda u: CASE u {cases} ELSE []::VARCHAR[] END)))"


def topical(toks: str, vocab: Vocabulary = CORPUS) -> str:
    return f"list_filter({toks}, lambda t: t NOT IN {names(vocab.generic_words)})"


def keep_order(x: str) -> str:
    """Distinct list values at their first position."""
    return f"list_filter({x}, lambda item, place: list_position({x}, item) = place)"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12))"


def pieces(x: str, split_at: str) -> str:
    return f"list_filter(list_transform(string_split({split_at}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 0)"


def sentences(x: str) -> str:
    return pieces(x, f"regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g')")


def clauses(x: str) -> str:
    marked = f"regexp_replace(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g')"
    return pieces(x, marked)


def keywords(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '[a-zA-Z0-9'']{{3,}}'), lambda w: lower(w)))"


def content(x: str) -> str:
    return (f"list_filter({keywords(x)}, lambda w: w NOT IN {names(v.METRIC_STOP_WORDS)} "
            f"AND NOT regexp_full_match(w, '[0-9]+'))")


_UNITS = " ".join(f"WHEN '{k}' THEN {float(n)}" for k, n in v.NUMBER_WORDS.items())
_SCALES = " ".join(f"WHEN '{k}' THEN {float(n)}" for k, n in v.MULTIPLIERS.items())


def atoms(x: str) -> str:
    """Digits, then spelled numbers: a left fold over the letter tokens with the
    running value in a struct and finished values in its list."""
    digits = (f"list_filter(list_transform(regexp_extract_all({x}, '[0-9][0-9,]*\\.?[0-9]*'), "
              f"lambda d: TRY_CAST(rtrim(replace(d, ',', ''), '.') AS DOUBLE)), lambda d: d IS NOT NULL)")
    number = f"(CASE w {_UNITS} END)"
    scale = f"(CASE w {_SCALES} END)"
    words = (f"list_transform(list_append(regexp_extract_all(lower({x}), '[a-z]+'), 'zzz'), "
             f"lambda w: {{'u': {number}, 'm': {scale}, 'c': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'out': []::DOUBLE[]}})")
    step = ("CASE WHEN b.u IS NOT NULL THEN {'u': NULL::DOUBLE, 'm': NULL::DOUBLE, 'c': a.c + b.u, 't': a.t, 'out': a.out} "
            "WHEN b.m IS NOT NULL THEN {'u': NULL::DOUBLE, 'm': NULL::DOUBLE, 'c': 0.0::DOUBLE, "
            "'t': a.t + (CASE WHEN a.c = 0 THEN 1 ELSE a.c END) * b.m, 'out': a.out} "
            "ELSE {'u': NULL::DOUBLE, 'm': NULL::DOUBLE, 'c': 0.0::DOUBLE, 't': 0.0::DOUBLE, "
            "'out': CASE WHEN a.c + a.t <> 0 THEN list_append(a.out, a.c + a.t) ELSE a.out END} END")
    start = "{'u': NULL::DOUBLE, 'm': NULL::DOUBLE, 'c': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'out': []::DOUBLE[]}"
    spelled = f"(list_reduce({words}, lambda a, b: {step}, {start})).out"
    return f"list_distinct(list_concat({digits}, {spelled}))"


def negated(x: str) -> str:
    return (f"length(list_filter(regexp_extract_all({x}, '[a-zA-Z'']+'), "
            f"lambda w: lower(w) IN {names(v.NEGATION_CUES)})) > 0")


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def sorted_join(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


def overlap(a: str, b: str) -> str:
    """Number of distinct values two lists share."""
    return f"length(list_intersect({a}, {b}))"


def word_edge(alternatives: str) -> str:
    """Whole words with Unicode edges, for a boolean match."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({alternatives})($|[^\\p{{L}}\\p{{N}}_])"
