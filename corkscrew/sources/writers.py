"""Writers: review CSV, 0/1 matrices as text, label files, audit CSV, artefacts.

Every writer produces many part files (no ``coalesce(1)``): each part is
a complete file of its own (headers repeat per part, as Spark writes them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def _csv_writer(df: DataFrame, header: bool, sep: str = ",", mode: str = "overwrite"):
    return (
        df.write.mode(mode)
        .option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
    )


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Table to CSV with a header, doubled quotes inside quoted fields."""
    _csv_writer(df, header=True, mode=mode).csv(path)
    return path


def write_dense(df: DataFrame, cols: Sequence[str], path: str, order_by: str | None = None) -> str:
    """0/1 (or integer) matrix as space-separated lines, one row per line."""
    if order_by:
        df = df.orderBy(order_by)
    line = F.concat_ws(" ", *[F.col(c).cast("bigint").cast("string") for c in cols])
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_labels(df: DataFrame, col: str, path: str, order_by: str | None = None) -> str:
    """One label per line, no header."""
    if order_by:
        df = df.orderBy(order_by)
    _csv_writer(df.select(col), header=False).csv(path)
    return path


def write_audit_csv(df: DataFrame, path: str) -> str:
    """';'-separated CSV, UTF-8 with a byte-order mark so spreadsheets read accents.

    The mark is written as the first character of the header, so every
    part file starts with it.
    """
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BOM + first)
    _csv_writer(marked, header=True, sep=";").csv(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    """Artefact (lexicon, vocabulary, index, metadata, leaderboard) as Parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Append rows (leaderboard, results) to a Parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
