"""TF-IDF vocabulary and weights in long form (an inverted index).

Fit: tokens -> term counts per record -> corpus statistics per term ->
vocabulary = the ``max_features`` terms with the highest corpus frequency
(ties by term) -> idf = ln((1+n)/(1+df)) + 1 -> weight = tf * idf, L2
normalised per record. MLlib's ``IDF`` has no ``+1`` term, so the formula
is written out.

Layout for scale: a record's tokens already sit in one row, so term counts
are runs of its sorted tokens and need no shuffle. Corpus statistics are one
partially aggregated pass (a term found in every record costs one row per
task); the number of records comes from the same pass. The vocabulary (at
most ``max_features`` rows) is collected and becomes a count vectoriser, whose
sparse vectors are weighted and normalised inside the row. ``by_id`` moves these
compact vectors, never tokens, for searches that add up per record.
"""

from __future__ import annotations

import functools
import glob
import math
import os
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import vectorizer_tokens
from .knn import record_parts


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark MLlib's default stop list (read from the installed jar, no JVM needed)."""
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:  # pragma: no cover - non-standard install
        from pyspark.ml.feature import StopWordsRemover

        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    with zipfile.ZipFile(jars[0]) as z:
        text = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in text.split() if w)


@dataclass
class TfidfModel:
    vocab: DataFrame  # pos, term, cf, df, idf  (at most max_features rows)
    vectors: DataFrame  # id, _vec: L2-normalised weights, one row per record
    terms: list  # (term, idf) by position
    n_docs: int
    stop: tuple[str, ...]
    id_col: str = "id"
    placed: bool = False  # vectors are hash-partitioned by id

    @property
    def index(self) -> DataFrame:
        """(id, term, weight); no shuffle."""
        return long_form(self.vectors, self.vocab, self.id_col)

    @property
    def by_id(self) -> DataFrame:
        """``index`` with all rows of a record in one task, known to the planner."""
        placed = self.vectors if self.placed else self.vectors.repartition(F.col(self.id_col))
        return long_form(placed, self.vocab, self.id_col)

    @property
    def rows(self) -> DataFrame:
        """(id, terms, weights), one row per record; terms are their positions in the vocabulary."""
        return term_rows(self.vectors, self.id_col)

    def persist(self) -> TfidfModel:
        self.vocab = self.vocab.cache()
        self.vectors = self.vectors.repartition(record_parts(self.vectors, self.n_docs), F.col(self.id_col)).cache()
        self.placed = True
        return self

    def unpersist(self) -> TfidfModel:
        self.vocab.unpersist()
        self.vectors.unpersist()
        return self


def _runs(df: DataFrame, text_col: str, stop: Sequence[str], *keep: str) -> DataFrame:
    """keep..., ``_runs``: array of (term, tf) of every text, by sorting its tokens in the row."""
    toks = df.select(*keep, F.sort_array(vectorizer_tokens(text_col, stop)).alias("_toks"))
    new = lambda i: (i == 0) | (F.get("_toks", i) != F.get("_toks", i - 1))
    starts = F.when(F.size("_toks") > 0, F.filter(F.sequence(F.lit(0), F.size("_toks") - 1), new))
    firsts = toks.select(*keep, "_toks", starts.alias("_starts"))
    tf = lambda p, j: (F.coalesce(F.get("_starts", j + 1), F.size("_toks")) - p).cast("bigint")
    runs = F.transform("_starts", lambda p, j: F.struct(F.get("_toks", p).alias("term"), tf(p, j).alias("tf")))
    return firsts.select(*keep, runs.alias("_runs"))


def _exploded(df: DataFrame, arr: Column | str, *keep: str) -> DataFrame:
    """keep..., ``_x`` per element. The outer form plus a null test keeps the
    optimizer from computing the array a second time for a size filter."""
    return df.select(*keep, F.explode_outer(arr).alias("_x")).where(F.col("_x").isNotNull())


def term_counts(df: DataFrame, id_col: str, text_col: str, stop: Sequence[str]) -> DataFrame:
    """(id, term, tf), one row per record and term; ids are unique."""
    return _exploded(_runs(df, text_col, stop, id_col), "_runs", id_col).select(id_col, "_x.term", "_x.tf")


def long_form(vectors: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight) of sparse vectors; the vocabulary's bound makes the broadcast safe."""
    v = vectors.select(id_col, F.unwrap_udt("_vec").alias("_v"))
    v = v.select(id_col, F.col("_v.indices").alias("pos"), F.col("_v.values").alias("weight"))
    pairs = _exploded(v, F.arrays_zip("pos", "weight"), id_col).select(id_col, "_x.pos", "_x.weight")
    return pairs.join(F.broadcast(vocab.select("pos", "term")), "pos").select(id_col, "term", "weight")


def term_rows(vectors: DataFrame, id_col: str) -> DataFrame:
    """(id, terms, weights) of sparse vectors; terms are positions in the vocabulary."""
    v = vectors.select(id_col, F.unwrap_udt("_vec").alias("_v"))
    return v.select(id_col, F.col("_v.indices").alias("terms"), F.col("_v.values").alias("weights"))


def weight_vectors(df: DataFrame, id_col: str, text_col: str, terms: Sequence, stop: Sequence[str]) -> DataFrame:
    """(id, _vec): tf * idf over the vocabulary, L2-normalised inside the row."""
    toks = F.coalesce(vectorizer_tokens(text_col, stop), F.array().cast("array<string>"))
    rows = df.select(F.col(id_col), toks.alias("_toks"))
    if not terms:
        return rows.limit(0).select(id_col, F.lit(None).cast(Vectors.sparse(0, [], []).__UDT__).alias("_vec"))
    stages = [
        CountVectorizerModel.from_vocabulary([t for t, _ in terms], inputCol="_toks", outputCol="_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([w for _, w in terms]), inputCol="_tf", outputCol="_raw"),
        Normalizer(p=2.0, inputCol="_raw", outputCol="_vec"),
    ]
    return PipelineModel(stages).transform(rows).select(id_col, "_vec")


def fit_tfidf(
    df: DataFrame,
    id_col: str = "id",
    text_col: str = "description",
    max_features: int = fixed.TFIDF_MAX_FEATURES,
    stop: Sequence[str] | None = None,
) -> TfidfModel:
    spark = df.sparkSession
    stop = tuple(default_stop_words() if stop is None else stop)
    # one entry without a term per record: its count is the number of records
    record = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf")))
    entries = F.when(F.col("_runs").isNull(), record).otherwise(F.concat(record, "_runs"))
    stats = _exploded(_runs(df, text_col, stop), entries).groupBy("_x.term").agg(
        F.sum("_x.tf").cast("bigint").alias("cf"),
        F.count(F.lit(1)).alias("df"),
    )
    # at most max_features + 1 rows reach the driver
    top = stats.orderBy(F.col("term").isNotNull(), F.desc("cf"), F.asc("term")).limit(max_features + 1).collect()
    n_docs = sum(r["df"] for r in top if r["term"] is None)
    rows = [(r["term"], r["cf"], r["df"], math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0) for r in top if r["term"] is not None]
    vocab = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, term string, cf bigint, df bigint, idf double")
    terms = [(r[0], r[3]) for r in rows]
    vectors = weight_vectors(df, id_col, text_col, terms, stop)
    return TfidfModel(vocab=vocab, vectors=vectors, terms=terms, n_docs=n_docs, stop=stop, id_col=id_col)


def transform_tfidf(model: TfidfModel, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight) of new texts under the fitted vocabulary and idf; unseen terms ignored."""
    return long_form(weight_vectors(df, id_col, text_col, model.terms, model.stop), model.vocab, id_col)


def transform_rows(model: TfidfModel, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``transform_tfidf`` with one row per text: (id, terms, weights), terms by position."""
    return term_rows(weight_vectors(df, id_col, text_col, model.terms, model.stop), id_col)
