"""Column statistics in as few passes as possible.

* Counts, nulls, zeros, moments, extremes: one aggregate over all columns.
* Distinct counts and most-frequent values: one long (column, value)
  table, partially aggregated per (column, value) before any shuffle, so
  a value holding a third of the rows costs one row per task.
* Exact quantiles: Spark's exact ``percentile`` keeps a value -> count map
  per column in one task, so it is used only for columns whose distinct
  count (checked first) is small; other columns go through one
  range-partitioned sort with a global rank (``rank_within``), which
  spreads even a single hot value over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small

# Above this many distinct values a column's quantiles use the sort path.
PERCENTILE_MAX_DISTINCT = 200_000


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = cols or df.columns
    return [c for c in cols if is_numeric(df.schema[c].dataType)]


def categorical_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = cols or df.columns
    return [c for c in cols if not is_numeric(df.schema[c].dataType)]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, int]:
    """Missing cells per column (one aggregate). NaN counts as missing for doubles."""
    cols = list(cols or df.columns)
    def miss(c):
        t = df.schema[c].dataType
        cond = _q(c).isNull() | F.isnan(_q(c)) if isinstance(t, (T.DoubleType, T.FloatType)) else _q(c).isNull()
        return F.count_if(cond).alias(c)
    row = df.agg(*[miss(c) for c in cols]).first() if cols else None
    return {c: int(row[c]) for c in cols} if row else {}


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) rows for the non-null cells of ``cols`` (values as strings)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def distinct_and_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, distinct, mode): exact distinct count and most frequent value
    (ties -> smallest value) per column, in two partially-aggregated passes."""
    per_value = long_values(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value")))
    return per_value.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"), best["value"].alias("mode"))


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean, population std, min, max, max |x| (one aggregate)."""
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c).cast("double")
        aggs += [
            F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.max(F.abs(x)).alias(f"abs{i}"),
        ]
    wide = df.agg(*aggs)
    rows = [x for i, c in enumerate(cols) for x in (F.lit(c), *(F.col(f"{k}{i}") for k in ("mean", "std", "min", "max", "abs")))]
    return wide.select(F.stack(F.lit(len(cols)), *rows).alias("column", "mean", "std", "min", "max", "max_abs"))


def rank_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column | str],
    name: str = "_rank",
    partitions: int | None = None,
) -> DataFrame:
    """0-based rank of each row inside its group by ``order_cols``, at any group size.

    One range-partitioned sort on (group, order): ranges split a huge
    group over many tasks. A row's global position is its position in
    its task plus the row count of earlier tasks (one row per task,
    broadcast); subtracting the row count of earlier groups (one row per
    group) gives the rank inside the group. Ties in ``order_cols`` get
    distinct consecutive ranks.

    The sorted, tagged rows are checkpointed (reliable, in the shared
    checkpoint folder) so the per-task counts and the rows they are
    applied to come from the same materialised data; pass a narrow
    projection (keys only) and join the rank back if rows are wide.
    """
    from ..session import cut_lineage

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in [*group_cols, *order_cols]]
    sorted_df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    tagged = cut_lineage(
        sorted_df.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    )
    per_task = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    task_off = per_task.select("_pid", "_first", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_toff"))
    pos = tagged.join(F.broadcast(task_off), "_pid").withColumn("_gpos", F.col("_toff") + F.col("_mid") - F.col("_first"))
    if group_cols:
        sizes = tagged.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_gn"))
        g_off = sizes.select(*group_cols, (F.sum("_gn").over(Window.orderBy(*group_cols)) - F.col("_gn")).alias("_goff"))
        pos = pos.join(broadcast_if_small(g_off), list(group_cols))
        rank = F.col("_gpos") - F.col("_goff")
    else:
        rank = F.col("_gpos")
    return pos.select(*df.columns, rank.alias(name))


def _quantiles_by_sort(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), _q(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("p")
    ).select("p.ci", "p.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = {r["ci"]: r["n"] for r in long.groupBy("ci").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = []
    for ci, n in counts.items():
        for p in probs:
            pos = (n - 1) * p
            wanted += [(ci, math.floor(pos)), (ci, math.ceil(pos))]
    # tie-break so equal values (a hot value) can still be split by the range partitioner
    ranked = rank_within(long.withColumn("_tb", F.xxhash64(F.monotonically_increasing_id())), ["ci"], ["v", "_tb"])
    picks = ranked.join(
        F.broadcast(df.sparkSession.createDataFrame(sorted(set(wanted)), "ci int, _rank long")), ["ci", "_rank"]
    )
    at = {(r["ci"], r["_rank"]): r["v"] for r in picks.collect()}
    out = {}
    for ci, c in enumerate(cols):
        n = counts.get(ci, 0)
        vals = []
        for p in probs:
            if n == 0:
                vals.append(None)
                continue
            pos = (n - 1) * p
            lo, hi = math.floor(pos), math.ceil(pos)
            vals.append(at[(ci, lo)] + (at[(ci, hi)] - at[(ci, lo)]) * (pos - lo))
        out[c] = vals
    return out


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], max_distinct: int = PERCENTILE_MAX_DISTINCT
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation (nulls and NaN ignored)."""
    cols = list(cols)
    if not cols:
        return {}
    approx = df.agg(*[F.approx_count_distinct(_q(c)).alias(c) for c in cols]).first()
    small = [c for c in cols if approx[c] <= max_distinct]
    big = [c for c in cols if approx[c] > max_distinct]
    out: dict[str, list[float | None]] = {}
    if small:
        def clean(c):
            x = _q(c).cast("double")
            return F.when(~F.isnan(x), x)
        row = df.agg(*[F.percentile(clean(c), list(probs)).alias(c) for c in small]).first()
        for c in small:
            out[c] = list(row[c]) if row[c] is not None else [None] * len(probs)
    if big:
        out.update(_quantiles_by_sort(df, big, probs))
    return out


def sorted_codes(values: DataFrame, col: str, code: str = "code") -> DataFrame:
    """Dictionary (value, code) with code = position of the value in sorted
    order of the distinct values, from 0 (distributed: no single-task window)."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    return rank_within(distinct, [], [col], code)
