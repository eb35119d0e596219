"""Cleaning of wide sparse features in long form (row_id, idx, val).

A table of a million columns is never widened: cells are summed up by column
in one aggregation, which decides filling, dropping and scaling of all columns,
and the result is joined to the cells. A cell that is not stored is zero; a
stored null, NaN or infinite value is missing.

* missing cells get the column's median over all rows, zeros included: zero
  where the middle of the sorted column falls on zeros, else the ranked value
  (``rank_within``, any column size);
* columns that are constant after that, or missing in every row, go;
* the others are divided by their largest absolute value.

Defined results: rows without cells stay, as vectors of zeros; columns not
seen in fitting are dropped; an empty table gives empty statistics and an
empty result; repeated cells of a row should have been added up by the reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import broadcast_if_small
from .stats import rank_within


def _value() -> Column:
    v = F.col("val").cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _medians(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(idx, fill): medians of ``columns`` whose middle is not on zeros."""
    low = F.floor((F.col("known") - 1) / 2)
    high = F.ceil((F.col("known") - 1) / 2)
    zeros = F.col("known") - F.col("below") - F.col("above")

    def on_zeros(p: Column) -> Column:
        return (p >= F.col("below")) & (p < F.col("below") + zeros)

    open_ = columns.where((F.col("missing") > 0) & (F.col("known") > 0) & ~(on_zeros(low) & on_zeros(high)))
    open_ = open_.select("idx", "below", zeros.alias("zeros"), low.alias("low"), high.alias("high"))
    own = cells.select("row_id", "idx", _value().alias("v")).where("v <> 0").join(broadcast_if_small(open_.select("idx")), "idx")
    ranked = rank_within(own, ["idx"], ["v", "row_id"], "rank").join(broadcast_if_small(open_), "idx")
    at = F.col("rank") + F.when(F.col("v") > 0, F.col("zeros")).otherwise(0)
    share = ((at == F.col("low")).cast("int") + (at == F.col("high")).cast("int")) * F.col("v") / 2
    return ranked.groupBy("idx").agg(F.sum(share).alias("fill"))


@dataclass
class SparseCleaner:
    """``columns``: (idx, fill, max_abs) of the columns that stay, a written table."""

    columns: DataFrame
    width: int

    def clean(self, cells: DataFrame) -> DataFrame:
        """Filled and scaled cells (row_id, idx, val) that are not zero."""
        joined = cells.join(broadcast_if_small(self.columns), "idx")
        val = F.coalesce(_value(), F.col("fill")) / F.col("max_abs")
        return joined.select("row_id", "idx", val.alias("val")).where("val <> 0")

    def vectors(self, cells: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` (with row_id) and their ``features``, sparse vectors of the file's width."""
        per_row = self.clean(cells).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("_cells"))
        joined = rows.join(per_row, "row_id", "left").withColumn("_cells", F.coalesce("_cells", F.array().cast("array<struct<idx:int,val:double>>")))
        return joined.withColumn("features", sparse_vector(F.col("_cells"), self.width)).drop("_cells")


def sparse_vector(cells: Column, width: int) -> Column:
    """ML vector of an array of (idx, val) in ascending order, made in the JVM
    (the vector's own struct, read by its type)."""
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), cells["idx"].cast("array<int>").alias("indices"), cells["val"].cast("array<double>").alias("values")
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]


def fit_sparse(cells: DataFrame, n_rows: int) -> SparseCleaner:
    """Statistics of every stored column over ``n_rows`` rows."""
    v = _value()
    spark = cells.sparkSession
    sums = cells.groupBy("idx").agg(
        F.count_if(v.isNull()).alias("missing"), F.count_if(v < 0).alias("below"), F.count_if(v > 0).alias("above"), F.count(v).alias("stored"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    sums = sums.withColumn("known", F.lit(n_rows).cast("long") - F.col("missing"))
    path = scratch_path(spark, "sparse-sums")
    sums.write.parquet(path)
    sums = spark.read.schema(sums.schema).parquet(path)
    top = sums.agg(F.max("idx")).first()[0]
    fills = sums.join(broadcast_if_small(_medians(cells, sums)), "idx", "left").withColumn("fill", F.coalesce("fill", F.lit(0.0)))
    # values that the filled column holds beside the stored ones
    zero = F.when(F.col("known") > F.col("stored"), F.lit(0.0))
    filled = F.when(F.col("missing") > 0, F.col("fill"))
    lo, hi = F.least("lo", zero, filled), F.greatest("hi", zero, filled)
    kept = fills.where((F.col("known") > 0) & (lo < hi)).select("idx", "fill", F.greatest(F.abs(lo), F.abs(hi)).alias("max_abs"))
    path = scratch_path(spark, "sparse-columns")
    kept.write.parquet(path)
    return SparseCleaner(spark.read.schema(kept.schema).parquet(path), 0 if top is None else top + 1)
