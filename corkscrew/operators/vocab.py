"""Word statistics over free text and the vocabulary audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ascii_words, drop_words
from .common import broadcast_if_small, word_table


def audit_words(df: DataFrame, text_col: str, stop: Sequence[str] = fixed.AUDIT_STOP_WORDS, min_len: int = 3) -> DataFrame:
    """One row per ``[a-z]{min_len,}`` word occurrence, stop words removed."""
    return df.select(F.explode(drop_words(ascii_words(text_col, min_len), stop)).alias("word"))


def word_frequencies(words: DataFrame) -> DataFrame:
    """Corpus frequency per word; partial (map-side) aggregation absorbs hot words."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))


def top_words(freq: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` most frequent words, ties by word ascending (bounded top-k)."""
    return freq.orderBy(F.desc("frequency"), F.asc("word")).limit(top_n)


def drop_known(words: DataFrame, known: Sequence[str] | DataFrame, col: str = "word") -> DataFrame:
    """Anti join against known words; a literal list is broadcast (its size is the parameter)."""
    if isinstance(known, DataFrame):
        other = broadcast_if_small(known.select(F.col(known.columns[0]).alias(col)))
    else:
        known = list(known)
        if not known:
            return words
        other = F.broadcast(word_table(words.sparkSession, known, col))
    return words.join(other, col, "left_anti")


def known_words(lexicon: dict, known: str = "groups") -> list[str]:
    """Words treated as already known: the group names (default) or all synonyms."""
    if known == "groups":
        return list(lexicon)
    if known == "synonyms":
        return [t for terms in lexicon.values() for t in terms]
    raise ValueError(f"unknown known-word mode {known!r}")


def vocab_audit(
    df: DataFrame,
    text_col: str,
    known: Sequence[str] | DataFrame = (),
    stop: Sequence[str] = fixed.AUDIT_STOP_WORDS,
    top_n: int = fixed.AUDIT_TOP_N,
) -> DataFrame:
    """Words -> stop list -> counts -> top N -> drop known words -> status.

    The top N is taken before known words are removed, so fewer than N
    rows may remain (same order of steps as the original audit).
    """
    freq = word_frequencies(audit_words(df, text_col, stop))
    top = top_words(freq, top_n)
    return drop_known(top, known).select(
        "word", "frequency", F.lit(fixed.AUDIT_WORD_STATUS).alias("status")
    )
