"""Small shared helpers: size-checked broadcast, literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is at most this; beyond it
# the join falls back to a shuffle join (AQE may still convert it at run
# time using real sizes).
BROADCAST_MAX_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only behind a checked row count.

    ``known_rows`` skips the count when the caller already has a proven
    bound (a parameter list, a top-N result).
    """
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def literal_table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A small table from parameter values (lexicons, stop lists, lookups)."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def word_table(spark: SparkSession, words: Iterable[str], col: str = "word") -> DataFrame:
    return literal_table(spark, [(w,) for w in dict.fromkeys(words)], f"{col} string")
