"""Behaviour of the neighbour search and the recommender."""

import pytest
from pyspark.sql import functions as F

from corkscrew.operators.common import literal_table
from corkscrew.operators.recommend import fit_recommender, neighbours, recommend, respond

REVIEWS = [
    (1, "W1", "Merlot", "red cherry plum oak tannins", 90, 20.0),
    (2, "W2", "Chardonnay", "butter vanilla oak creamy citrus", 88, 15.0),
    (3, "W3", "Riesling", "citrus lime honey sweet apricot", 91, 18.0),
    (4, "W4", "Syrah", "pepper smoke red plum spicy", 89, 25.0),
    (5, "W5", "Mystery", "pepper smoke spicy leather", 87, None),
    (6, "W6", "Pinot", "cherry earth mushroom light", 92, 30.0),
]
COLORS = [("Merlot", "red"), ("Chardonnay", "white"), ("Riesling", "white"), ("Syrah", "red"), ("Pinot", "red")]


@pytest.fixture(scope="module")
def rec(spark):
    df = spark.createDataFrame(REVIEWS, "id long, winery string, variety string, description string, points int, price double")
    return fit_recommender(df, stop=[]).persist()


@pytest.fixture(scope="module")
def colors(spark):
    return literal_table(spark, COLORS, "variety string, color string")


def reqs(spark, rows):
    return spark.createDataFrame(rows, "request_id long, features string, color string")


def test_zero_hit_request_gets_k_neighbours_at_distance_one(spark, rec):
    nn = neighbours(rec, reqs(spark, [(1, "zzzz", "red")]), k=3).orderBy("rank").collect()
    assert [(r["rank"], r["id"], r["distance"]) for r in nn] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_fewer_hits_than_k_are_filled(spark, rec):
    nn = neighbours(rec, reqs(spark, [(1, "mushroom", None)]), k=4).orderBy("rank").collect()
    assert nn[0]["id"] == 6 and nn[0]["distance"] < 1.0
    assert [r["id"] for r in nn[1:]] == [1, 2, 3]


def test_colour_wish_never_returns_other_known_colour(spark, rec, colors):
    r = reqs(spark, [(1, "red spicy pepper structure", "white"), (2, "red spicy pepper structure", "red"),
                     (3, "butter vanilla oak", None)])
    out = {x["request_id"]: x for x in recommend(rec, r, colors, k=6).collect()}
    for rid, row in out.items():
        assert row["status"] in ("Optimal", "Fallback (Couleur ignorée)")
        if row["status"] == "Optimal" and rid == 1:
            assert row["bottle_color"] in ("white", "unknown")
    assert out[2]["bottle_color"] in ("red", "unknown")
    assert out[3]["variety"] == "Chardonnay"


def test_fallback_to_nearest(spark, rec, colors):
    r = reqs(spark, [(1, "pepper smoke spicy", "rose")])
    strict = recommend(rec, r, colors, k=2, unknown="fail", fallback=False).first()
    assert strict["status"] == "Aucun résultat" and strict["id"] is None
    loose = recommend(rec, r, colors, k=2, unknown="fail", fallback=True).first()
    assert loose["status"] == "Fallback (Couleur ignorée)" and loose["rank"] == 1


def test_unknown_colour_passes_by_default(spark, rec, colors):
    r = reqs(spark, [(1, "leather", "white")])
    row = recommend(rec, r, colors, k=2).first()
    assert row["variety"] == "Mystery" and row["status"] == "Optimal"


def test_response_shape(spark, rec, colors):
    r = reqs(spark, [(1, "leather", "rose")])
    ans = recommend(rec, r, colors, k=1, unknown="fail")
    resp = respond(ans).first()
    assert resp["category"] == "Inconnu (Couleur non garantie)"
    assert resp["bottle"]["description"].endswith("...") and resp["bottle"]["price"] == 0.0


def test_salted_join_equals_broadcast_join(spark, rec):
    """Forcing the large-request path (salted shuffle join) gives the same neighbours."""
    from corkscrew.operators.knn import knn_cosine
    from corkscrew.operators.tfidf import transform_tfidf

    r = reqs(spark, [(1, "pepper smoke", None), (2, "citrus honey", None), (3, "zzzz", None), (4, "oak cherry", None)])
    qw = transform_tfidf(rec.tfidf, r, "request_id", "features")
    ids = rec.meta.select("id")
    small = knn_cosine(qw, rec.tfidf.index, r.select("request_id"), ids, 4)
    salted = knn_cosine(qw, rec.tfidf.index, r.select("request_id"), ids, 4, broadcast_max_rows=0, salt=3)
    assert sorted(tuple(x) for x in small.collect()) == sorted(tuple(x) for x in salted.collect())
    assert small.count() == 16
