"""Corpus pipeline: toxicity, quality rules, near-dedup, substring dedup, packing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscrew.llm import packing, quality, simhash, substring, toxicity
from corkscrew.llm.queries import TOXIC_CATEGORIES, toxicity_labels, word_bpe
from corkscrew.llm.spark import relax, settle, tune
from corkscrew.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last chain probability is 0.5 or more go."""
    tune(spark)
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXIC_CATEGORIES)
    scored = toxicity.predict(docs, chain, suffix="__p")
    return scored.where(F.col("toxic__p") < 0.5).select(docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the repetition rules reject go."""
    tune(spark)
    return quality.judge(docs).where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays, once; rows
    without an id belong to no group and stay."""
    tune(spark)
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    stay = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated passages go; a text that loses none stays as it is."""
    tune(spark)
    out = substring.remove_duplicates(docs)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts with their places in sequences."""
    tune(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]

#: A trained classifier, fingerprints and a tokenizer have no SQL form; tests
#: hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        relax(spark)
    return docs
