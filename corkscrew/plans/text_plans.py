"""Registered text queries: words, stop lists, lexicon flags, vocabulary audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import NON_WORD_RUN, ascii_words, drop_words, whole_word_pattern
from ..operators.lexicon import lexicon_counts, lexicon_flags
from ..operators.vocab import audit_words, drop_known, known_words, vocab_audit, word_frequencies
from ..session import table
from .registry import register, sql_list
from .standins import STANDIN_LEXICON

LEX = STANDIN_LEXICON


def split_sql(col: str) -> str:
    return f"regexp_split_to_array(lower(coalesce({col}, '')), '{NON_WORD_RUN}')"


STOP_SQL = sql_list(fixed.AUDIT_STOP_WORDS)


def flag_sql(col: str, mode: str) -> str:
    low = f"lower(coalesce({col}, ''))"
    parts = []
    for g, terms in LEX.items():
        if mode == "word":
            hit = f"regexp_matches({low}, '{whole_word_pattern(terms)}')"
        elif mode == "substring":
            hit = "(" + " OR ".join(f"contains({low}, '{t}')" for t in terms) + ")"
        else:
            hit = f"contains({low}, '{g}')"
        parts.append(f"CAST({hit} AS INTEGER) AS {g}")
    return ", ".join(parts)


def words_sql(where: str = "") -> str:
    return (
        f"SELECT doc_id, word FROM (SELECT doc_id, unnest({split_sql('text')}) AS word "
        f"FROM documents) WHERE regexp_full_match(word, '[a-z]{{3,}}') {where}"
    )


@register(
    "txt_lexicon_word",
    f"SELECT doc_id, {flag_sql('text', 'word')} FROM documents",
)
def q_lexicon_word(spark, sf_dir):
    return lexicon_flags(table(spark, sf_dir, "documents"), "text", LEX, "word", keep=["doc_id"])


@register(
    "txt_lexicon_substring",
    f"SELECT conv_id, turn, {flag_sql('text', 'substring')} FROM conversations",
)
def q_lexicon_substring(spark, sf_dir):
    return lexicon_flags(table(spark, sf_dir, "conversations"), "text", LEX, "substring", keep=["conv_id", "turn"])


@register(
    "txt_lexicon_group_name",
    f"SELECT conv_id, turn, {flag_sql('text', 'group_name')} FROM conversations",
)
def q_lexicon_group_name(spark, sf_dir):
    return lexicon_flags(table(spark, sf_dir, "conversations"), "text", LEX, "group_name", keep=["conv_id", "turn"])


_counts_union = " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", CAST(sum({g}) AS BIGINT) AS documents FROM f" for g in LEX
)


@register(
    "txt_lexicon_counts",
    f"WITH f AS (SELECT {flag_sql('text', 'word')} FROM documents), "
    f"c AS ({_counts_union}) SELECT * FROM c WHERE documents > 0",
)
def q_lexicon_counts(spark, sf_dir):
    flags = lexicon_flags(table(spark, sf_dir, "documents"), "text", LEX, "word")
    return lexicon_counts(flags, list(LEX))


@register(
    "txt_words_ascii",
    f"SELECT doc_id, word, count(*) AS n FROM ({words_sql()}) GROUP BY doc_id, word",
)
def q_words_ascii(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(ascii_words("text")).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@register(
    "txt_stopwords",
    f"SELECT doc_id, word, count(*) AS n FROM ({words_sql('AND word NOT IN ' + STOP_SQL)}) "
    "GROUP BY doc_id, word",
)
def q_stopwords(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(drop_words(ascii_words("text"), fixed.AUDIT_STOP_WORDS)).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@register(
    "txt_word_count",
    f"SELECT word, count(*) AS frequency FROM ({words_sql('AND word NOT IN ' + STOP_SQL)}) GROUP BY word",
)
def q_word_count(spark, sf_dir):
    return word_frequencies(audit_words(table(spark, sf_dir, "documents"), "text"))


AUDIT_KNOWN = known_words(LEX, "synonyms")


@register(
    "e2e_vocab_audit",
    f"WITH c AS (SELECT word, count(*) AS frequency FROM ({words_sql('AND word NOT IN ' + STOP_SQL)}) "
    f"GROUP BY word), t AS (SELECT * FROM c ORDER BY frequency DESC, word ASC LIMIT {fixed.AUDIT_TOP_N}) "
    f"SELECT word, frequency, '{fixed.AUDIT_WORD_STATUS}' AS status FROM t "
    f"WHERE word NOT IN {sql_list(AUDIT_KNOWN)}",
)
def q_vocab_audit(spark, sf_dir):
    return vocab_audit(table(spark, sf_dir, "documents"), "text", known=AUDIT_KNOWN)


@register(
    "join_known_anti",
    f"SELECT word, count(*) AS frequency FROM ({words_sql('AND word NOT IN ' + STOP_SQL)}) "
    f"WHERE word NOT IN {sql_list(AUDIT_KNOWN)} GROUP BY word",
)
def q_known_anti(spark, sf_dir):
    """Counts of the words outside the lexicon."""
    freq = word_frequencies(audit_words(table(spark, sf_dir, "documents"), "text"))
    return drop_known(freq, AUDIT_KNOWN)
