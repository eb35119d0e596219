"""Registered queries: TF-IDF index, nearest neighbours, recommendation, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import NON_WORD_RUN
from ..operators.common import broadcast_if_small, literal_table
from ..operators.knn import knn_cosine
from ..operators.lookup import color_allows, lookup_default
from ..operators.recommend import fit_recommender, neighbours, recommend, respond
from ..operators.tfidf import default_stop_words, term_counts, transform_rows, transform_tfidf
from ..session import table
from .registry import register, sql_list
from .standins import (
    REQUESTS_SQL,
    REVIEWS_SQL,
    SOURCE_COLORS,
    USER_TURNS_SQL,
    color_map_sql,
    requests,
    reviews,
    user_turns,
)

K_FIT = fixed.KNN_FIT_K
K_QUERY = fixed.KNN_QUERY_K
NFEAT = fixed.TFIDF_MAX_FEATURES
STOP = sql_list(default_stop_words())
R9 = 9  # output rounding of computed weights


def _split(col: str) -> str:
    return f"unnest(regexp_split_to_array(lower(coalesce({col}, '')), '{NON_WORD_RUN}'))"


META_SQL = (
    "SELECT id, concat(coalesce(winery, 'Domaine Inconnu'), ' ', coalesce(variety, '')) AS title, "
    f"variety, description, points, price FROM ({REVIEWS_SQL}) "
    "WHERE description IS NOT NULL AND variety IS NOT NULL"
)


def index_ctes() -> str:
    """CTEs meta, tf, vocab, idx of the fitted index (DuckDB)."""
    return (
        f"meta AS ({META_SQL}), "
        f"tok AS (SELECT id, {_split('description')} AS term FROM meta), "
        f"tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE length(term) >= 2 AND term NOT IN {STOP} GROUP BY id, term), "
        "nd AS (SELECT count(*) AS n FROM meta), "
        "stats AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term), "
        f"top AS (SELECT * FROM stats ORDER BY cf DESC, term ASC LIMIT {NFEAT}), "
        "vocab AS (SELECT term, cf, df, ln((1.0 + nd.n) / (1.0 + df)) + 1.0 AS idf FROM top, nd), "
        "w0 AS (SELECT id, term, tf * idf AS w FROM tf JOIN vocab USING (term)), "
        "idx AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w0)"
    )


def query_ctes(requests_sql: str) -> str:
    """CTEs q, qw: request weights under the fitted vocabulary (DuckDB)."""
    return (
        f"q AS ({requests_sql}), "
        f"qtok AS (SELECT request_id, {_split('features')} AS term FROM q), "
        f"qtf AS (SELECT request_id, term, count(*) AS tf FROM qtok WHERE length(term) >= 2 AND term NOT IN {STOP} GROUP BY request_id, term), "
        "qw0 AS (SELECT request_id, term, tf * idf AS w FROM qtf JOIN vocab USING (term)), "
        "qw AS (SELECT request_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY request_id)) AS weight FROM qw0)"
    )


def knn_ctes(k: int) -> str:
    """CTE nn: (request_id, rank, id, distance), needs q, qw, idx, meta."""
    return (
        "prods AS (SELECT qw.request_id, idx.id, qw.weight * idx.weight AS prod FROM qw JOIN idx USING (term)), "
        f"fill AS (SELECT q.request_id, f.id, 0.0 AS prod FROM q, (SELECT id FROM meta ORDER BY id LIMIT {k}) f), "
        "dots AS (SELECT request_id, id, sum(prod) AS dot FROM (SELECT * FROM prods UNION ALL SELECT * FROM fill) u GROUP BY request_id, id), "
        "dist AS (SELECT request_id, id, round(1.0 - dot, 6) + 0.0 AS distance FROM dots), "
        "ranked AS (SELECT request_id, id, distance, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance, id) AS INTEGER) AS rank FROM dist), "
        f"nn AS (SELECT request_id, rank, id, distance FROM ranked WHERE rank <= {k})"
    )


def _recommender(spark, sf_dir):
    return fit_recommender(reviews(spark, sf_dir))


def _colors(spark):
    return literal_table(spark, SOURCE_COLORS.items(), "variety string, color string")


@register(
    "txt_tokens",
    f"WITH {index_ctes()} SELECT id, term, tf FROM tf",
)
def q_tokens(spark, sf_dir):
    rec_meta = fit_recommender(reviews(spark, sf_dir)).meta
    return term_counts(rec_meta, "id", "description", default_stop_words())


@register(
    "txt_vocab_topn",
    f"WITH {index_ctes()} SELECT term, cf, df FROM vocab",
)
def q_vocab_topn(spark, sf_dir):
    return _recommender(spark, sf_dir).tfidf.vocab.select("term", "cf", "df")


@register(
    "txt_idf",
    f"WITH {index_ctes()} SELECT term, df, round(idf, {R9}) AS idf FROM vocab",
)
def q_idf(spark, sf_dir):
    v = _recommender(spark, sf_dir).tfidf.vocab
    return v.select("term", "df", F.round("idf", R9).alias("idf"))


@register(
    "txt_tfidf",
    f"WITH {index_ctes()} SELECT id, term, round(weight, {R9}) AS weight FROM idx",
)
def q_tfidf(spark, sf_dir):
    idx = _recommender(spark, sf_dir).tfidf.index
    return idx.select("id", "term", F.round("weight", R9).alias("weight"))


@register(
    "txt_tfidf_query",
    f"WITH {index_ctes()}, {query_ctes(REQUESTS_SQL)} SELECT request_id, term, round(weight, {R9}) AS weight FROM qw",
)
def q_tfidf_query(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    qw = transform_tfidf(rec.tfidf, requests(spark, sf_dir), "request_id", "features")
    return qw.select("request_id", "term", F.round("weight", R9).alias("weight"))


@register(
    "join_knn_cosine",
    f"WITH {index_ctes()}, {query_ctes(USER_TURNS_SQL)}, {knn_ctes(K_FIT)} SELECT * FROM nn",
)
def q_knn_cosine(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    return neighbours(rec, user_turns(spark, sf_dir), K_FIT)


PART_REQUESTS_SQL = "SELECT p_partkey AS request_id, p_name AS features, NULL AS color FROM part"


@register(
    "join_knn_zero_fill",
    f"WITH {index_ctes()}, {query_ctes(PART_REQUESTS_SQL)}, {knn_ctes(K_QUERY)} SELECT * FROM nn",
)
def q_knn_zero_fill(spark, sf_dir):
    """Short part names as requests: most share no term with the index, so
    their neighbours come from the fill at distance 1."""
    rec = _recommender(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"), F.col("p_name").alias("features")
    )
    qw = transform_rows(rec.tfidf, part, "request_id", "features")
    return knn_cosine(qw, rec.tfidf.rows, part.select("request_id"), rec.meta.select("id"), K_QUERY, n_records=rec.tfidf.n_docs)


@register(
    "join_metadata",
    f"WITH {index_ctes()}, {query_ctes(REQUESTS_SQL)}, {knn_ctes(K_QUERY)} "
    "SELECT nn.request_id, nn.rank, nn.id, nn.distance, meta.title, meta.variety, meta.points, meta.price "
    "FROM nn JOIN meta USING (id)",
)
def q_join_metadata(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    reqs = requests(spark, sf_dir)
    nn = broadcast_if_small(neighbours(rec, reqs, K_QUERY), known_rows=reqs.count() * K_QUERY)
    return nn.join(rec.meta.select("id", "title", "variety", "points", "price"), "id")


@register(
    "join_lookup_default",
    f"SELECT m.id, m.variety, coalesce(c.color, 'unknown') AS color FROM ({META_SQL}) m "
    f"LEFT JOIN ({color_map_sql(SOURCE_COLORS)}) c USING (variety)",
)
def q_lookup_default(spark, sf_dir):
    meta = _recommender(spark, sf_dir).meta.select("id", "variety")
    return lookup_default(meta, _colors(spark), "variety", "color")


def _cand_sql() -> str:
    return (
        f"WITH {index_ctes()}, {query_ctes(REQUESTS_SQL)}, {knn_ctes(K_QUERY)}, "
        f"cm AS ({color_map_sql(SOURCE_COLORS)}), "
        "cand AS (SELECT nn.request_id, nn.rank, nn.id, nn.distance, meta.title, meta.variety, meta.description, "
        "meta.points, meta.price, coalesce(cm.color, 'unknown') AS bottle_color, q.color AS wish "
        "FROM nn JOIN meta USING (id) LEFT JOIN cm ON meta.variety = cm.variety JOIN q ON q.request_id = nn.request_id)"
    )


@register(
    "flt_color",
    _cand_sql()
    + " SELECT request_id, rank, id, bottle_color, wish, "
    "(wish IS NULL OR bottle_color = 'unknown' OR bottle_color = wish) AS allowed, "
    "(wish IS NULL OR bottle_color = wish) AS allowed_strict FROM cand",
)
def q_color_filter(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    reqs = requests(spark, sf_dir)
    nn = broadcast_if_small(neighbours(rec, reqs, K_QUERY), known_rows=reqs.count() * K_QUERY)
    cand = lookup_default(nn.join(rec.meta.select("id", "variety"), "id"), _colors(spark), "variety", "color", out="bottle_color")
    cand = cand.join(reqs.select("request_id", F.col("color").alias("wish")), "request_id")
    return cand.select(
        "request_id", "rank", "id", "bottle_color", "wish",
        color_allows("wish", "bottle_color", "pass").alias("allowed"),
        color_allows("wish", "bottle_color", "fail").alias("allowed_strict"),
    )


_ANSWER_COLS = "rank, id, distance, title, variety, description, points, price, bottle_color"


def _recommend_sql(strict: bool) -> str:
    ok = "(wish IS NULL OR bottle_color = wish)" if strict else "(wish IS NULL OR bottle_color = 'unknown' OR bottle_color = wish)"
    fit = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS rn FROM cand WHERE {ok}) WHERE rn = 1"
    if strict:
        pick = (
            f"SELECT q.request_id, CASE WHEN f.request_id IS NULL THEN '{fixed.STATUS_NONE}' ELSE '{fixed.STATUS_OPTIMAL}' END AS status, "
            + ", ".join(f"f.{c}" for c in _ANSWER_COLS.split(", "))
            + " FROM q LEFT JOIN fit f ON f.request_id = q.request_id"
        )
    else:
        pick = (
            f"SELECT n.request_id, CASE WHEN f.request_id IS NULL THEN '{fixed.STATUS_FALLBACK}' ELSE '{fixed.STATUS_OPTIMAL}' END AS status, "
            + ", ".join(f"coalesce(f.{c}, n.{c}) AS {c}" if c != "bottle_color" else "CASE WHEN f.request_id IS NULL THEN n.bottle_color ELSE f.bottle_color END AS bottle_color" for c in _ANSWER_COLS.split(", "))
            + " FROM (SELECT * FROM cand WHERE rank = 1) n LEFT JOIN fit f ON f.request_id = n.request_id"
        )
    return _cand_sql() + f", fit AS ({fit}) " + pick


@register("e2e_recommend", _recommend_sql(strict=False))
def q_recommend(spark, sf_dir):
    rec = _recommender(spark, sf_dir)
    return recommend(rec, requests(spark, sf_dir), _colors(spark), K_QUERY)


@register("e2e_recommend_strict", _recommend_sql(strict=True))
def q_recommend_strict(spark, sf_dir):
    """Strict variant: unknown colours fail the wish and there is no fallback."""
    rec = _recommender(spark, sf_dir)
    return recommend(rec, requests(spark, sf_dir), _colors(spark), K_QUERY, unknown="fail", fallback=False)


_RESPONSE_SQL = (
    _recommend_sql(strict=False).replace(" SELECT n.request_id,", ", ans AS (SELECT n.request_id,", 1)
    + ") SELECT request_id, "
    f"CASE WHEN status = '{fixed.STATUS_FALLBACK}' THEN '{fixed.CATEGORY_UNAVAILABLE}{fixed.CATEGORY_FALLBACK_SUFFIX}' "
    f"ELSE '{fixed.CATEGORY_UNAVAILABLE}' END AS category, status, title AS bottle_title, "
    f"substr(coalesce(description, ''), 1, {fixed.DESCRIPTION_CUT}) || '{fixed.DESCRIPTION_ELLIPSIS}' AS bottle_description, "
    "coalesce(CAST(price AS DOUBLE), 0.0) AS bottle_price, variety AS bottle_variety FROM ans"
)


@register("prj_response", _RESPONSE_SQL)
def q_response(spark, sf_dir):
    """Response rows (no served model here, so the category is 'Inconnu');
    the nested bottle is flattened for the check."""
    rec = _recommender(spark, sf_dir)
    ans = recommend(rec, requests(spark, sf_dir), _colors(spark), K_QUERY)
    r = respond(ans)
    return r.select(
        "request_id", "category", "status",
        *[F.col("bottle")[c].alias(f"bottle_{c}") for c in ["title", "description", "price", "variety"]],
    )
