"""Registered queries: request stream, and full responses with a served model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.lexicon import lexicon_flags
from ..operators.models import ClosedFormClassifier
from ..operators.recommend import fit_recommender, recommend, respond
from ..session import scratch_path
from ..streaming.requests import read_answers, stream_recommend
from .knn_plans import K_QUERY, _colors, _recommend_sql
from .ml_plans import _flags_sql, _nb_sql
from .registry import register
from .standins import REQUESTS_SQL, REVIEWS_SQL, STANDIN_LEXICON, requests, reviews


@register("e2e_stream_recommend", _recommend_sql(strict=False))
def q_stream_recommend(spark, sf_dir):
    """Requests written as four files, consumed two files per micro-batch
    (available-now trigger); the sink equals the batch answer."""
    rec = fit_recommender(reviews(spark, sf_dir)).persist()
    src = scratch_path(spark, "requests")
    requests(spark, sf_dir).repartition(4, "request_id").write.mode("overwrite").parquet(src)
    sink = scratch_path(spark, "answers")
    ckpt = scratch_path(spark, "stream-ckpt")
    stream_recommend(spark, rec, _colors(spark), src, sink, ckpt, max_files_per_trigger=2)
    return read_answers(spark, sink).drop("batch_id")


_CATEGORY_SQL = _nb_sql(
    "bernoulli", list(STANDIN_LEXICON),
    train=f"SELECT id, {_flags_sql('description', STANDIN_LEXICON)}, variety AS target FROM ({REVIEWS_SQL})",
    test=f"SELECT request_id AS id, {_flags_sql('features', STANDIN_LEXICON)}, NULL AS target FROM ({REQUESTS_SQL})",
)


@register(
    "e2e_respond",
    _recommend_sql(strict=False).replace(" SELECT n.request_id,", ", ans AS (SELECT n.request_id,", 1)
    + f"), cats AS ({_CATEGORY_SQL} SELECT id, prediction FROM pred) "
    f"SELECT request_id, coalesce(prediction, '{fixed.CATEGORY_UNAVAILABLE}') || CASE WHEN status = '{fixed.STATUS_FALLBACK}' THEN '{fixed.CATEGORY_FALLBACK_SUFFIX}' ELSE '' END AS category, "
    f"status, title, substr(coalesce(description, ''), 1, {fixed.DESCRIPTION_CUT}) || '{fixed.DESCRIPTION_ELLIPSIS}' AS description, "
    "coalesce(CAST(price AS DOUBLE), 0.0) AS price, variety FROM ans LEFT JOIN cats ON cats.id = ans.request_id",
)
def q_respond(spark, sf_dir):
    """Answer + category predicted by a naive Bayes model over lexicon flags
    (same word-mode flags for training and serving)."""
    revs = reviews(spark, sf_dir)
    rec = fit_recommender(revs)
    groups = list(STANDIN_LEXICON)
    train = lexicon_flags(revs, "description", STANDIN_LEXICON, "word", keep=["id", "variety"])
    model = ClosedFormClassifier(inputCols=groups, labelCol="variety", kind="bernoulli").fit(train)
    reqs = requests(spark, sf_dir)
    req_flags = lexicon_flags(reqs, "features", STANDIN_LEXICON, "word", keep=["request_id"])
    cats = model.transform(req_flags).select("request_id", F.col("prediction").alias("category"))
    ans = recommend(rec, reqs, _colors(spark), K_QUERY)
    r = respond(ans, cats)
    return r.select("request_id", "category", "status", "bottle.title", "bottle.description", "bottle.price", "bottle.variety")
