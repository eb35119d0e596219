"""Learning-task detection from the target column(s): one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .stats import is_numeric

BINARY = "binary-classification"
MULTI = "multi-classification"
MULTILABEL = "multi-label-classification"
REGRESSION = "regression"


def task_type_df(df: DataFrame, targets: Sequence[str], mode: str = "documented") -> DataFrame:
    """One row: (task_type, n_unique, n_rows).

    Several targets -> multi-label. One target: 2 values -> binary; a
    numeric target with fewer than 20 values or a value/row ratio below
    0.01 -> multi-class; other numeric targets -> regression; text
    targets -> multi-class. ``mode='as_run'`` first turns the target into
    text with missing values as 'Inconnu' (so regression never occurs),
    as the original did.
    """
    targets = list(targets)
    if len(targets) > 1:
        return df.agg(
            F.lit(MULTILABEL).alias("task_type"),
            F.count_distinct(F.struct(*targets)).alias("n_unique"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    t = targets[0]
    numeric = mode == "documented" and is_numeric(df.schema[t].dataType)
    y = F.col(t) if numeric else F.coalesce(F.col(t).cast("string"), F.lit(fixed.LABEL_FILLER))
    stats = df.agg(F.count_distinct(y).alias("n_unique"), F.count(F.lit(1)).alias("n_rows"))
    if numeric:
        kind = (
            F.when(F.col("n_unique") == 2, F.lit(BINARY))
            .when((F.col("n_unique") < 20) | (F.col("n_unique") / F.col("n_rows") < 0.01), F.lit(MULTI))
            .otherwise(F.lit(REGRESSION))
        )
    else:
        kind = F.when(F.col("n_unique") == 2, F.lit(BINARY)).otherwise(F.lit(MULTI))
    return stats.select(kind.alias("task_type"), "n_unique", "n_rows")


def detect_task_type(df: DataFrame, targets: str | Sequence[str], mode: str = "documented") -> str:
    targets = [targets] if isinstance(targets, str) else list(targets)
    return task_type_df(df, targets, mode).first()["task_type"]
