"""Repeatable hash-based splits and samples (no shuffle, same rows every run).

A row's draw is ``u = hex(md5(seed || ':' || id))[0:8] mod 10000 / 10000``;
it depends only on the seed and the row id, so the split is stable
across runs, engines and cluster sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .stats import rank_within

BUCKETS = 10_000


def hash_bucket(id_col: str, seed: int = 42) -> Column:
    """Integer in [0, 10000) from the seed and the row id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def holdout_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows whose bucket is below ``test_size`` go to test."""
    cut = int(round(test_size * BUCKETS))
    b = hash_bucket(id_col, seed)
    return df.where(b >= cut), df.where(b < cut)


def with_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    cut = int(round(test_size * BUCKETS))
    return df.withColumn(name, hash_bucket(id_col, seed) < cut)


def plain_sample(df: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """Unstratified sample: rows whose 60-bit draw is below ``ratio`` (no
    ratio above 1e-18 is rounded to nothing)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return df.where(draw < int(round(ratio * 2**60)))


def sample_ratio(n_rows: int, ratio: float, cap: int) -> float:
    """The ratio actually used: ``ratio``, lowered so at most ``cap`` rows are kept."""
    if ratio <= 0 or ratio >= 1:
        return 1.0
    return cap / n_rows if n_rows * ratio > cap else ratio


def stratified_sample(
    df: DataFrame,
    id_col: str,
    label: str,
    ratio: float = 0.3,
    cap: int = 50_000,
    seed: int = 42,
    min_class: int = 2,
) -> DataFrame:
    """Class-stratified subsample: from each class keep the ``round(r * size)``
    rows with the lowest hash draw, r = ratio capped at ``cap`` rows in all.

    The per-class rank comes from one range-partitioned sort on
    (class, draw), so even a class holding a third of the rows is ranked
    by many tasks. When a class has fewer than ``min_class`` rows the
    sample is taken unstratified instead (as the original falls back).
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    stats = sizes.agg(F.sum("_size").alias("n"), F.min("_size").alias("smallest")).first()
    n = int(stats["n"] or 0)
    r = sample_ratio(n, ratio, cap)
    if r >= 1.0:
        return df
    if (stats["smallest"] or 0) < min_class:
        return plain_sample(df, id_col, r, seed)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keys = df.select(F.col(id_col), F.col(label), digest.alias("_draw"))
    ranked = rank_within(keys, [label], ["_draw", id_col], "_r")
    kept = ranked.join(broadcast_if_small(sizes), label).where(F.col("_r") < F.round(F.col("_size") * F.lit(r)))
    kept_ids = kept.select(id_col)
    n_kept = kept_ids.count()
    return df.join(broadcast_if_small(kept_ids, known_rows=n_kept), id_col).select(*df.columns)
