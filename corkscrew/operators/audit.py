"""Coverage audit of a category column against a lookup map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import audit_status, lookup_default


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, frequency) for non-null values; map-side partial counts absorb hot values."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("frequency"))


def category_audit(df: DataFrame, col: str, lookup: DataFrame) -> DataFrame:
    """Frequency, current colour (or 'NON DÉFINI') and status per category.

    Ordered by frequency descending, then category.
    """
    counts = value_counts(df, col)
    with_color = lookup_default(counts, lookup, col, "_color", default=None)
    shown, status = audit_status("_color")
    out = with_color.select(
        F.col("frequency"),
        F.col(col).alias("category"),
        shown.alias("current_color"),
        status.alias("status"),
    )
    return out.orderBy(F.desc("frequency"), F.asc("category"))


def audit_totals(audit: DataFrame) -> DataFrame:
    """One row: categories, known, missing, rows."""
    return audit.agg(
        F.count(F.lit(1)).alias("categories"),
        F.count_if(F.col("status") == "OK").alias("known"),
        F.count_if(F.col("status") != "OK").alias("missing"),
        F.sum("frequency").cast("bigint").alias("rows"),
    )
