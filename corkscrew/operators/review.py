"""Review-table projections and filters, and the preparation job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .lexicon import lexicon_flags

META_COLUMNS = ["title", "variety", "description", "points", "price"]


def with_title(df: DataFrame, filler: str = fixed.TITLE_FILLER_PREPARE) -> DataFrame:
    """Add ``title = winery || ' ' || variety`` when the table has no title.

    Missing winery becomes ``filler``; missing variety becomes '' in the
    title (the variety column itself is left as it is).
    """
    if "title" in df.columns:
        return df
    title = F.concat(F.coalesce(F.col("winery"), F.lit(filler)), F.lit(" "), F.coalesce(F.col("variety"), F.lit("")))
    return df.withColumn("title", title)


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any required column."""
    return df.na.drop(subset=list(required))


def to_number(col: str | Column) -> Column:
    """Text to double; anything that is not a number becomes 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def coerce_numbers(df: DataFrame, points: str = "points", price: str = "price") -> DataFrame:
    """``points`` to int (truncated), ``price`` to double; bad or null -> 0."""
    return df.withColumns(
        {points: to_number(points).cast("int"), price: to_number(price)}
    )


def default_columns(df: DataFrame, keep: Sequence[str] = META_COLUMNS, id_col: str | None = "id") -> DataFrame:
    """Keep the metadata columns; ``points`` / ``price`` are 0 when absent."""
    cols = [F.col(id_col)] if id_col and id_col in df.columns else []
    for c in keep:
        cols.append(F.col(c) if c in df.columns else F.lit(0).alias(c))
    return df.select(*cols)


def clean_reviews(df: DataFrame, filler: str = fixed.TITLE_FILLER_PREPARE) -> DataFrame:
    """Title -> required columns -> numbers (the cleaning half of preparation)."""
    titled = with_title(df, filler)
    kept = drop_missing(titled, ["description", "variety"])
    return coerce_numbers(kept)


def prepare(
    df: DataFrame,
    lexicon: Mapping[str, Sequence[str]],
    id_col: str = "id",
    mode: str = "word",
) -> tuple[DataFrame, DataFrame]:
    """Clean the review table and compute the lexicon flags.

    Returns ``(clean, features)``: the clean table, and per row the flag
    columns plus ``target`` (the variety), ready for model selection.
    """
    clean = clean_reviews(df)
    return clean, prepare_features(clean, lexicon, id_col, mode)


def prepare_features(clean: DataFrame, lexicon: Mapping[str, Sequence[str]], id_col: str = "id", mode: str = "word") -> DataFrame:
    """Flags and target in one projection of the clean table (no join)."""
    flags = lexicon_flags(clean.withColumn("target", F.col("variety")), "description", lexicon, mode, keep=[id_col, "target"])
    return flags.select(id_col, *lexicon, "target")
