"""Registered queries: review-table projections and filters, preparation, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.audit import audit_totals, category_audit, value_counts
from ..operators.common import literal_table
from ..operators.review import clean_reviews, coerce_numbers, default_columns, drop_missing, prepare, with_title
from ..session import table
from .knn_plans import META_SQL
from .registry import register
from .standins import BRAND_COLORS, SOURCE_COLORS, STANDIN_LEXICON, color_map_sql
from .text_plans import flag_sql

# Review stand-in with derived nulls (the driver tables hold none).
RAW_SQL = (
    "SELECT doc_id AS id, nullif(lang, 'de') AS winery, nullif(source, 'src3') AS variety, "
    "CASE WHEN lang = 'es' AND source = 'src5' THEN NULL ELSE text END AS description, "
    "CAST(n_chars % 100 AS VARCHAR) AS points, CAST(n_chars AS VARCHAR) || '.25' AS price FROM documents"
)


def raw_reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.nullif(F.col("lang"), F.lit("de")).alias("winery"),
        F.nullif(F.col("source"), F.lit("src3")).alias("variety"),
        F.when((F.col("lang") == "es") & (F.col("source") == "src5"), None).otherwise(F.col("text")).alias("description"),
        (F.col("n_chars") % 100).cast("string").alias("points"),
        F.concat(F.col("n_chars").cast("string"), F.lit(".25")).alias("price"),
    )


TITLE_SQL = "concat(coalesce(winery, 'Inconnu'), ' ', coalesce(variety, ''))"


@register("prj_title", f"SELECT id, {TITLE_SQL} AS title FROM ({RAW_SQL})")
def q_title(spark, sf_dir):
    return with_title(raw_reviews(spark, sf_dir)).select("id", "title")


@register(
    "flt_required",
    f"SELECT id, variety FROM ({RAW_SQL}) WHERE description IS NOT NULL AND variety IS NOT NULL",
)
def q_required(spark, sf_dir):
    return drop_missing(raw_reviews(spark, sf_dir), ["description", "variety"]).select("id", "variety")


NUM_RAW_SQL = (
    "SELECT p_partkey, "
    "CASE p_size % 4 WHEN 0 THEN 'abc' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.9' WHEN 2 THEN NULL "
    "ELSE CAST(p_size AS VARCHAR) END AS points, "
    "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 100 AS VARCHAR) END AS price "
    "FROM part"
)


@register(
    "prj_to_number",
    "SELECT p_partkey, CAST(trunc(coalesce(TRY_CAST(points AS DOUBLE), 0)) AS INTEGER) AS points, "
    f"coalesce(TRY_CAST(price AS DOUBLE), 0.0) AS price FROM ({NUM_RAW_SQL})",
)
def q_to_number(spark, sf_dir):
    """Text points / prices with bad and missing values: bad -> 0, points truncated."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    raw = p.select(
        "p_partkey",
        F.when(F.col("p_size") % 4 == 0, F.lit("abc"))
        .when(F.col("p_size") % 4 == 1, F.concat(size, F.lit(".9")))
        .when(F.col("p_size") % 4 == 2, F.lit(None).cast("string"))
        .otherwise(size)
        .alias("points"),
        F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("p_size") % 5 == 1, F.lit("n/a"))
        .otherwise(F.concat(size, F.lit("."), (F.col("p_partkey") % 100).cast("string")))
        .alias("price"),
    )
    return coerce_numbers(raw)


@register(
    "prj_default_cols",
    "SELECT doc_id AS id, concat(lang, ' ', source) AS title, source AS variety, text AS description, "
    "0 AS points, 0 AS price FROM documents",
)
def q_default_cols(spark, sf_dir):
    """A review table without points and price: both default to 0."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("lang"), F.lit(" "), F.col("source")).alias("title"),
        F.col("source").alias("variety"),
        F.col("text").alias("description"),
    )
    return default_columns(d)


PREPARE_SQL = (
    f"WITH c AS (SELECT id, {TITLE_SQL} AS title, variety, description, "
    "CAST(trunc(coalesce(TRY_CAST(points AS DOUBLE), 0)) AS INTEGER) AS points, "
    f"coalesce(TRY_CAST(price AS DOUBLE), 0.0) AS price FROM ({RAW_SQL}) "
    "WHERE description IS NOT NULL AND variety IS NOT NULL) "
)


@register(
    "e2e_prepare",
    PREPARE_SQL + f"SELECT id, {flag_sql('description', 'word')}, variety AS target FROM c",
)
def q_prepare(spark, sf_dir):
    """Title -> required columns -> numbers -> lexicon flags and target."""
    _, features = prepare(raw_reviews(spark, sf_dir), STANDIN_LEXICON)
    return features


@register("prj_clean_reviews", PREPARE_SQL + "SELECT * FROM c")
def q_clean_reviews(spark, sf_dir):
    """The clean review table written by the preparation (before flags)."""
    return clean_reviews(raw_reviews(spark, sf_dir)).select("id", "title", "variety", "description", "points", "price")


@register(
    "agg_value_counts",
    "SELECT p_brand, count(*) AS frequency FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand",
)
def q_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "part"), "p_brand")


def _brand_audit(spark, sf_dir):
    colors = literal_table(spark, BRAND_COLORS.items(), "p_brand string, color string")
    return category_audit(table(spark, sf_dir, "part"), "p_brand", colors)


AUDIT_PART_SQL = (
    "WITH c AS (SELECT p_brand, count(*) AS frequency FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand), "
    f"m AS ({color_map_sql(BRAND_COLORS, 'p_brand')}), "
    "a AS (SELECT c.frequency, c.p_brand AS category, coalesce(m.color, 'NON DÉFINI') AS current_color, "
    "CASE WHEN m.color IS NULL THEN 'A FAIRE' ELSE 'OK' END AS status FROM c LEFT JOIN m USING (p_brand)) "
)


@register("e2e_category_audit", AUDIT_PART_SQL + "SELECT * FROM a")
def q_category_audit(spark, sf_dir):
    return _brand_audit(spark, sf_dir)


@register(
    "agg_audit_totals",
    AUDIT_PART_SQL
    + "SELECT count(*) AS categories, count(*) FILTER (WHERE status = 'OK') AS known, "
    "count(*) FILTER (WHERE status <> 'OK') AS missing, CAST(sum(frequency) AS BIGINT) AS rows FROM a",
)
def q_audit_totals(spark, sf_dir):
    return audit_totals(_brand_audit(spark, sf_dir))


@register(
    "prj_status",
    f"WITH c AS (SELECT variety, count(*) AS frequency FROM ({META_SQL}) GROUP BY variety), "
    f"m AS ({color_map_sql(SOURCE_COLORS)}) "
    "SELECT c.frequency, c.variety AS category, coalesce(m.color, 'NON DÉFINI') AS current_color, "
    "CASE WHEN m.color IS NULL THEN 'A FAIRE' ELSE 'OK' END AS status FROM c LEFT JOIN m USING (variety)",
)
def q_status(spark, sf_dir):
    """Colour and status per variety of the indexed reviews."""
    from ..operators.recommend import index_metadata
    from .standins import reviews

    colors = literal_table(spark, SOURCE_COLORS.items(), "variety string, color string")
    return category_audit(index_metadata(reviews(spark, sf_dir)), "variety", colors)
