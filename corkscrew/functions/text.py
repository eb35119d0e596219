"""Column expressions for text: tokens, word-boundary tests, lexicon flags.

All of these are built-in Spark expressions (JVM side, codegen); no
Python runs per row.

Word boundaries are written as an explicit character class instead of
``\\b``: Java's and RE2's ``\\b`` disagree with Python's on accented
letters, while ``[^\\p{L}\\p{N}_]`` means the same everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
NON_WORD_RUN = NON_WORD + "+"
_REGEX_META = set(".^$*+?()[]{}|\\")


def regex_escape(term: str) -> str:
    """Escape regex metacharacters only (portable to Java regex and RE2)."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in term)


def whole_word_pattern(terms: Iterable[str]) -> str:
    """Pattern true when any term occurs bounded by non-word characters."""
    alts = "|".join(regex_escape(t) for t in terms)
    return f"(^|{NON_WORD})(?:{alts})($|{NON_WORD})"


def lowered(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.lower(F.coalesce(col, F.lit("")))


def words(text: Column | str) -> Column:
    """Array of maximal word-character runs of the lower-cased text."""
    return F.filter(F.split(lowered(text), NON_WORD_RUN), lambda w: w != F.lit(""))


def drop_words(arr: Column, stop: Sequence[str]) -> Column:
    """Remove stop words from a token array, keeping order and repeats."""
    if not stop:
        return arr
    return F.filter(arr, lambda w: ~w.isin(list(stop)))


def vectorizer_tokens(text: Column | str, stop: Sequence[str] = (), min_len: int = 2) -> Column:
    """Tokens of the TF-IDF vectoriser: word runs of ``min_len``+ chars, stop words removed."""
    toks = F.filter(words(text), lambda w: F.length(w) >= F.lit(min_len))
    return drop_words(toks, stop)


def ascii_words(text: Column | str, min_len: int = 3) -> Column:
    """Words made only of ``a-z`` with at least ``min_len`` letters."""
    return F.filter(words(text), lambda w: w.rlike(f"^[a-z]{{{min_len},}}$"))


RUN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def runs(text: Column | str) -> Column:
    """Maximal alternating word / non-word runs of the lower-cased text
    (their concatenation is the whole text)."""
    return F.regexp_extract_all(lowered(text), F.lit(f"({RUN})"), 1)


def term_width(term: str) -> int:
    """Number of runs a term spans (a term starts and ends with a word character)."""
    import regex

    return len(regex.findall(RUN, term.lower()))


def run_grams(run_arr: Column, width: int) -> Column:
    """Concatenations of ``width`` consecutive runs (width 1: the runs themselves)."""
    if width == 1:
        return run_arr
    grams = F.transform(
        F.sequence(F.lit(0), F.size(run_arr) - F.lit(width)),
        lambda i: F.concat(*[run_arr[i + j] for j in range(width)]),
    )
    return F.when(F.size(run_arr) >= width, grams).otherwise(F.array().cast("array<string>"))


def whole_word_hit(run_arr: Column, terms: Sequence[str], grams: dict | None = None) -> Column:
    """True when any term occurs bounded by non-word characters.

    A bounded occurrence of a term made of k words is exactly 2k-1
    consecutive runs of the text, so the test is a hash-set overlap
    between the term list and the run n-grams: linear in the text, where
    a regex alternation retries every term at every position.
    """
    by_width: dict[int, list[str]] = {}
    for t in terms:
        by_width.setdefault(term_width(t), []).append(t.lower())
    hit = None
    for w, ts in sorted(by_width.items()):
        g = grams[w] if grams and w in grams else run_grams(run_arr, w)
        one = F.coalesce(F.arrays_overlap(g, F.array(*[F.lit(t) for t in ts])), F.lit(False))
        hit = one if hit is None else hit | one
    return hit if hit is not None else F.lit(False)


def lexicon_flag(text: Column | str, group: str, terms: Sequence[str], mode: str = "word") -> Column:
    """0/1 flag for one lexicon group.

    mode ``word``: any term as a whole word; ``substring``: any term as a
    plain substring; ``group_name``: the group name itself as a substring.
    """
    low = lowered(text)
    if mode == "word":
        # bind the runs to a lambda variable so the split runs once per row
        # (an expression used inside the n-gram lambda would be re-run per element)
        hit = F.element_at(F.transform(F.array(runs(text)), lambda r: whole_word_hit(r, terms)), 1)
    elif mode == "substring":
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t)
    elif mode == "group_name":
        hit = low.contains(group)
    else:
        raise ValueError(f"unknown lexicon mode {mode!r}")
    return hit.cast("int").alias(group)


def lexicon_flags(text: Column | str, lexicon: Mapping[str, Sequence[str]], mode: str = "word") -> list[Column]:
    """One flag column per group, in lexicon order (one wide projection)."""
    return [lexicon_flag(text, g, terms, mode) for g, terms in lexicon.items()]


RUNS_COL = "__runs"
MATCH_COL = "__matched"


def terms_by_width(lexicon: Mapping[str, Sequence[str]]) -> dict[int, list[str]]:
    out: dict[int, set] = {}
    for terms in lexicon.values():
        for t in terms:
            out.setdefault(term_width(t), set()).add(t.lower())
    return {w: sorted(ts) for w, ts in sorted(out.items())}


def matched_terms(run_arr: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Distinct lexicon terms present as whole words: one hash-set
    intersection per term width over the run n-grams of the text."""
    parts = [F.array_intersect(run_grams(run_arr, w), F.array(*[F.lit(t) for t in ts])) for w, ts in terms_by_width(lexicon).items()]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def flags_from_matches(lexicon: Mapping[str, Sequence[str]]) -> list[Column]:
    """One 0/1 flag per group from the (small) array of matched terms."""
    m = F.col(MATCH_COL)
    return [
        F.coalesce(F.arrays_overlap(m, F.array(*[F.lit(t.lower()) for t in terms])), F.lit(False)).cast("int").alias(g)
        for g, terms in lexicon.items()
    ]
