"""Rows as numeric blocks: the form in which iterative models read their rows.

``compact`` merges equal rows into one with a weight, so that a table of a few
flags is fitted on as many rows as it has combinations. ``blocks`` packs rows
into binary blocks of bounded size (Arrow batches), as an RDD whose elements
are NumPy arrays: the models of this package pass over them once a step, add
up small arrays per partition and reduce them in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "__weight"
#: Rows for which one partition of blocks is enough.
ROWS_PER_PARTITION = 50_000


def compact(df: DataFrame, columns: Sequence[str], weight: str = WEIGHT) -> DataFrame:
    """Distinct combinations of ``columns`` with the number of rows that hold each."""
    return df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).cast("double").alias(weight))


def blocks(df: DataFrame, features: Sequence[str], target: Sequence[str] | str, weight: str | None = None, rows: int | None = None) -> RDD:
    """RDD of (X, Y, w): float64 matrices of the features and of the numeric
    target columns, and the rows' weights. Nulls are NaN. ``rows``: their
    number, if known; few rows are put into few partitions."""
    target = [target] if isinstance(target, str) else list(target)
    weight_col = F.col(f"`{weight}`").cast("double") if weight and weight in df.columns else F.lit(1.0)
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*features, *target])], weight_col.alias("w"))
    if rows is not None:
        wide = wide.coalesce(max(1, min(-(-rows // ROWS_PER_PARTITION), df.sparkSession.sparkContext.defaultParallelism * 1000)))
    p, q = len(features), len(target)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["block"])

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = np.frombuffer(row[0]).reshape(-1, p + q + 1)
        return m[:, :p], m[:, p : p + q], m[:, p + q]

    return wide.mapInArrow(pack, "block binary").rdd.map(unpack)


class Held:
    """The few blocks of one task, with the calls of an RDD that models make:
    a table of at most ``ROWS_PER_PARTITION`` (weighted) rows is fitted inside
    one task by the same steps, without a job for each."""

    def __init__(self, elements):
        self.elements = list(elements)

    def map(self, of) -> Held:
        return Held(of(e) for e in self.elements)

    def persist(self, *_) -> Held:
        return self

    def unpersist(self) -> None: ...

    def checkpoint(self) -> None: ...

    def foreachPartition(self, _) -> None: ...


def fit_on(data: RDD, rows: int, fit):
    """``fit(data)``, inside one task if the rows are few."""
    if rows > ROWS_PER_PARTITION:
        return fit(data)
    return data.coalesce(1).mapPartitions(lambda it: [fit(Held(it))]).collect()[0]


def _add(a, b):
    return [x + y for x, y in zip(a, b)] if isinstance(a, list) else a + b


def reduced(values, add=_add):
    out = None
    for value in values:
        out = value if out is None else add(out, value)
    return out


def total(data: RDD | Held, of, add=_add):
    """Sum (or another ``add``) over all elements of ``of(element)`` (an array
    or a list of arrays), inside each partition first, then in a tree."""
    if isinstance(data, Held):
        return reduced(map(of, data.elements), add)
    sums = data.mapPartitions(lambda it: [v for v in [reduced(map(of, it), add)] if v is not None])
    if data.getNumPartitions() <= 8:
        return reduced(sums.collect(), add)
    return None if sums.isEmpty() else sums.treeReduce(add)
