"""Token and flag operators against Python's ``re`` on the same strings."""

import re

import pytest
from pyspark.sql import functions as F

from corkscrew.functions import fixed
from corkscrew.functions.text import ascii_words, lexicon_flag, vectorizer_tokens, words
from corkscrew.operators.lexicon import lexicon_counts, lexicon_flags
from corkscrew.operators.vocab import vocab_audit

TEXTS = [
    "Fresh acidity, bright cherry!",
    "placid waters",
    "Bell pepper and off-dry style",
    "an éclair with cream",
    "",
    None,
    "Über straße, naïve café; x-large HOT-rod 42abc abc_def",
    "line one\nline two\ttabbed",
]


def py_words(t):
    return re.findall(r"\w+", (t or "").lower())


def test_words_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", words("t").alias("w")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == py_words(t), t


def test_ascii_words_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", ascii_words("t").alias("w")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == re.findall(r"\b[a-z]{3,}\b", (t or "").lower()), t


def test_vectorizer_tokens(spark):
    df = spark.createDataFrame([("The a of Cat sat on xy",)], "t string")
    toks = df.select(vectorizer_tokens("t", ["the", "on"]).alias("w")).first()["w"]
    assert toks == ["of", "cat", "sat", "xy"]


@pytest.mark.parametrize(
    "text,group,terms,word,sub",
    [
        ("fresh acidity", "acidity", ["acid", "acidity"], 1, 1),
        ("placid", "acidity", ["acid"], 0, 1),
        ("bell pepper", "vegetable", ["bell pepper"], 1, 1),
        ("bell pepper", "spices", ["pepper"], 1, 1),
        ("off-dry", "sweet", ["off-dry"], 1, 1),
        ("off-dry", "dry", ["dry"], 1, 1),
        ("éclair", "pastry", ["clair"], 0, 1),
        ("", "pastry", ["clair"], 0, 0),
        (None, "pastry", ["clair"], 0, 0),
    ],
)
def test_lexicon_word_and_substring(spark, text, group, terms, word, sub):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(
        lexicon_flag("t", group, terms, "word").alias("w"), lexicon_flag("t", group, terms, "substring").alias("s")
    ).first()
    assert (r["w"], r["s"]) == (word, sub)
    py_word = int(bool(re.search("|".join(rf"\b{re.escape(t)}\b" for t in terms), (text or "").lower())))
    assert r["w"] == py_word


def test_group_name_mode(spark):
    df = spark.createDataFrame([("lots of acidity here",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(lexicon_flag("t", "acidity", [], "group_name")).collect()]
    assert got == [1, 0]


def test_review_lexicon_shape():
    assert len(fixed.REVIEW_LEXICON) == 33
    assert "lush" in fixed.REVIEW_LEXICON["sweet"] and "lush" in fixed.REVIEW_LEXICON["body_full"]
    assert len(fixed.AUDIT_STOP_WORDS) == 63


def test_flags_and_counts(spark):
    df = spark.createDataFrame([(1, "cherry and oak"), (2, "oak barrel"), (3, "nothing")], "id int, t string")
    lex = {"red_fruit": ["cherry"], "oak": ["oak", "barrel"], "mineral": ["slate"]}
    flags = lexicon_flags(df, "t", lex, keep=["id"])
    assert [tuple(r) for r in flags.orderBy("id").collect()] == [(1, 1, 1, 0), (2, 0, 1, 0), (3, 0, 0, 0)]
    counts = {r["group"]: r["documents"] for r in lexicon_counts(flags, list(lex)).collect()}
    assert counts == {"red_fruit": 1, "oak": 2}


def test_vocab_audit_top_n_before_known(spark):
    df = spark.createDataFrame([("alpha alpha alpha beta beta gamma the wine",)], "t string")
    out = vocab_audit(df, "t", known=["alpha"], top_n=2)
    assert [tuple(r) for r in out.collect()] == [("beta", 2, "NOUVEAU")]
