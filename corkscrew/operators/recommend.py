"""Requests -> nearest records -> colour filter -> one answer per request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .common import broadcast_if_small
from .knn import knn_cosine
from .lookup import color_allows, lookup_default
from .review import META_COLUMNS, default_columns, drop_missing, with_title
from .tfidf import TfidfModel, fit_tfidf, transform_rows


@dataclass
class Recommender:
    """Fitted neighbour index plus the metadata of every indexed record."""

    tfidf: TfidfModel
    meta: DataFrame  # id, title, variety, description, points, price

    def persist(self) -> Recommender:
        self.tfidf.persist()
        self.meta = self.meta.cache()
        return self


def index_metadata(reviews: DataFrame, id_col: str = "id") -> DataFrame:
    """Clean table for the index: title (filler 'Domaine Inconnu'), required
    description / variety / title, the five metadata columns."""
    titled = with_title(reviews, fixed.TITLE_FILLER_INDEX)
    kept = drop_missing(titled, ["description", "variety", "title"])
    return default_columns(kept, META_COLUMNS, id_col)


def fit_recommender(reviews: DataFrame, id_col: str = "id", max_features: int = fixed.TFIDF_MAX_FEATURES, stop=None) -> Recommender:
    meta = index_metadata(reviews, id_col)
    model = fit_tfidf(meta, id_col, "description", max_features, stop)
    return Recommender(tfidf=model, meta=meta)


def neighbours(rec: Recommender, requests: DataFrame, k: int = fixed.KNN_QUERY_K, qid_col: str = "request_id", text_col: str = "features", **kw) -> DataFrame:
    """(request_id, rank, id, distance) for the ``k`` nearest records."""
    id_col = rec.tfidf.id_col
    qw = transform_rows(rec.tfidf, requests, qid_col, text_col)
    return knn_cosine(qw, rec.tfidf.rows, requests.select(qid_col), rec.meta.select(id_col), k, qid_col, id_col, placed=rec.tfidf.placed, n_records=rec.tfidf.n_docs, **kw)


def recommend(
    rec: Recommender,
    requests: DataFrame,
    colors: DataFrame,
    k: int = fixed.KNN_QUERY_K,
    unknown: str = "pass",
    fallback: bool = True,
    qid_col: str = "request_id",
    text_col: str = "features",
    wish_col: str = "color",
) -> DataFrame:
    """One row per request: the nearest record whose colour fits the wish,
    else (``fallback``) the nearest record with status 'Fallback (Couleur ignorée)'.

    ``colors`` is a (variety, color) map; varieties it lacks are 'unknown'.
    """
    nn = neighbours(rec, requests, k, qid_col, text_col)
    id_col = rec.tfidf.id_col
    # candidates are at most k per request: that bound (not a count of the
    # candidates, which would run the search twice) decides the broadcasts
    n_requests = requests.count()
    cand = broadcast_if_small(nn, known_rows=n_requests * k).join(rec.meta.select(id_col, "variety"), id_col)
    cand = lookup_default(cand, colors, "variety", "color", out="bottle_color")
    wishes = requests.select(qid_col, F.col(wish_col).alias("_wish"))
    cand = cand.join(wishes, qid_col)
    ok = color_allows("_wish", "bottle_color", unknown)
    pick = F.struct("rank", id_col, "distance", "bottle_color")
    best = cand.groupBy(qid_col).agg(F.min(F.when(ok, pick)).alias("_fit"), F.min(pick).alias("_near"))
    chosen = F.coalesce(F.col("_fit"), F.col("_near")) if fallback else F.col("_fit")
    status = F.when(F.col("_fit").isNotNull(), F.lit(fixed.STATUS_OPTIMAL)).otherwise(F.lit(fixed.STATUS_FALLBACK))
    picks = best.select(qid_col, status.alias("status"), chosen.alias("_b")).where(F.col("_b").isNotNull()).select(qid_col, "status", "_b.*")
    # texts of the chosen record only
    texts = rec.meta.select(id_col, "title", "variety", "description", "points", "price")
    out = texts.join(broadcast_if_small(picks, known_rows=n_requests), id_col)
    if not fallback:
        out = requests.select(qid_col).distinct().join(out, qid_col, "left")
        out = out.withColumn("status", F.coalesce("status", F.lit(fixed.STATUS_NONE)))
    return out.select(qid_col, "status", "rank", id_col, "distance", "title", "variety", "description", "points", "price", "bottle_color")


def respond(answers: DataFrame, categories: DataFrame | None = None, qid_col: str = "request_id") -> DataFrame:
    """Response rows: predicted category (suffix on fallback) and a nested bottle.

    ``categories`` is (request_id, category) from a served model; without
    one the category is 'Inconnu'.
    """
    if categories is not None:
        answers = answers.join(categories, qid_col, "left")
    else:
        answers = answers.withColumn("category", F.lit(None).cast("string"))
    cat = F.coalesce(F.col("category").cast("string"), F.lit(fixed.CATEGORY_UNAVAILABLE))
    cat = F.when(F.col("status") == fixed.STATUS_FALLBACK, F.concat(cat, F.lit(fixed.CATEGORY_FALLBACK_SUFFIX))).otherwise(cat)
    return answers.select(qid_col, cat.alias("category"), "status", response_bottle().alias("bottle"))


def response_bottle() -> Column:
    """Nested bottle: description cut to 200 characters plus '...', price null -> 0.0."""
    return F.struct(
        F.col("title").cast("string").alias("title"),
        F.concat(F.substring(F.coalesce(F.col("description"), F.lit("")), 1, fixed.DESCRIPTION_CUT), F.lit(fixed.DESCRIPTION_ELLIPSIS)).alias("description"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
        F.col("variety").cast("string").alias("variety"),
    )
