"""Lookups against small maps: colour of a category, colour filter, audit status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .common import broadcast_if_small


def lookup_default(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    value: str,
    default: str | None = fixed.UNKNOWN_COLOR,
    out: str | None = None,
) -> DataFrame:
    """Left join ``df.key`` to ``lookup(key, value)``; misses get ``default``.

    The map side is broadcast behind a size check (a colour map has a few
    hundred rows; a large one falls back to a shuffle join).
    """
    out = out or value
    right = lookup.select(F.col(lookup.columns[0]).alias(key), F.col(lookup.columns[1]).alias("_lv"))
    joined = df.join(broadcast_if_small(right), key, "left")
    filled = F.coalesce(F.col("_lv"), F.lit(default)) if default is not None else F.col("_lv")
    return joined.withColumn(out, filled).drop("_lv")


def color_allows(wish: str | Column, color: str | Column, unknown: str = "pass") -> Column:
    """True when a candidate may be served for the colour wish.

    No wish: always. Known colour: must equal the wish. Unknown colour:
    passes (``unknown='pass'``) or fails (``unknown='fail'``, the strict form).
    """
    w = F.col(wish) if isinstance(wish, str) else wish
    c = F.col(color) if isinstance(color, str) else color
    is_unknown = c.isNull() | (c == F.lit(fixed.UNKNOWN_COLOR))
    unknown_ok = F.lit(unknown == "pass")
    return w.isNull() | F.when(is_unknown, unknown_ok).otherwise(c == w)


def audit_status(color: str | Column) -> tuple[Column, Column]:
    """(colour or 'NON DÉFINI', 'OK' when the colour is known else 'A FAIRE')."""
    c = F.col(color) if isinstance(color, str) else color
    shown = F.coalesce(c, F.lit(fixed.AUDIT_COLOR_DEFAULT))
    status = F.when(c.isNull(), F.lit(fixed.AUDIT_STATUS_TODO)).otherwise(F.lit(fixed.AUDIT_STATUS_OK))
    return shown, status
