"""How the driver tables stand in for the review data.

These are parameters of the registered queries, not fixed values of the
toolkit: the review lexicon barely occurs in the driver's prose, so the
queries add a few groups over words that do occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import table

EXTRA_GROUPS = {
    "english": ["the", "of", "and"],
    "german": ["der", "und", "die"],
    "french": ["le", "les", "des"],
    "spanish": ["que", "el", "los"],
    "warm": ["hot", "red", "hot rod"],
    "cool": ["cold", "blue", "blue anvil"],
    "size": ["small", "large", "x-large"],
}

STANDIN_LEXICON = {**fixed.REVIEW_LEXICON, **EXTRA_GROUPS}

# Colour of some sources (the rest are unknown), standing in for the
# variety -> colour map.
SOURCE_COLORS = {
    "src0": "red", "src1": "white", "src2": "red", "src3": "white",
    "src4": "rose", "src5": "red", "src6": "white", "src7": "red",
    "src8": "white", "src9": "red", "src10": "white", "src11": "red",
}

# Colour of some brands (the rest are unknown), for the category audit on part.
BRAND_COLORS = {f"Brand#{i}": ("red" if i % 2 else "white") for i in range(1, 13)}

# Request colour wish derived from the request id: red, white, none.
REQUEST_COLOR_SQL = "CASE {id} % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'white' ELSE NULL END"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a review table: id, winery, variety, description, points, price."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("winery"),
        F.col("source").alias("variety"),
        F.col("text").alias("description"),
        (F.col("n_chars") % 100).alias("points"),
        (F.col("n_chars") / F.lit(100.0)).alias("price"),
    )


REVIEWS_SQL = (
    "SELECT doc_id AS id, lang AS winery, source AS variety, text AS description, "
    "n_chars % 100 AS points, n_chars / 100.0 AS price FROM documents"
)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as a request table: request_id, features, color."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("request_id"),
        F.col("text").alias("features"),
        F.expr(REQUEST_COLOR_SQL.format(id="item_id")).alias("color"),
    )


REQUESTS_SQL = (
    "SELECT item_id AS request_id, text AS features, "
    + REQUEST_COLOR_SQL.format(id="item_id")
    + " AS color FROM benchmark"
)


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as a second request table."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.col("text").alias("features"),
        F.expr(REQUEST_COLOR_SQL.format(id="conv_id")).alias("color"),
    )


USER_TURNS_SQL = (
    "SELECT conv_id * 1000 + turn AS request_id, text AS features, "
    + REQUEST_COLOR_SQL.format(id="conv_id")
    + " AS color FROM conversations WHERE role = 'user'"
)


def color_map_sql(colors: dict, key: str = "variety") -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in colors.items())
    return f"SELECT * FROM (VALUES {rows}) AS t({key}, color)"
