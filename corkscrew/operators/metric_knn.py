"""k-nearest-neighbour regression as an exact metric join.

Equal training vectors are one entry that keeps its ``k`` lowest targets, equal
vectors to predict are one query, so repeated rows cost nothing twice. Some
entries, drawn by hash, are pivots; an entry lies in the cell of its nearest
pivot and there in a ring of distances from it. Rings hold about
``RING_ROWS`` entries: the unit that is joined, so a big cell is many keys.

1. A query's first bound: cells sorted by (distance to the pivot + radius) hold
   k targets within that distance.
2. It meets the rings of its own cell next to its distance from the pivot; the
   k-th distance found there is a second bound.
3. By the triangle inequality only rings whose distances from their pivot lie
   within the bound of the query's can hold a nearer entry, and by the
   bisector of two pivots whole cells are left out. The query is sent to those
   rings alone; the distances there are exact, and the k nearest are averaged.

Nearness is (distance rounded to 9 places, target); nothing else breaks ties,
so the mean does not depend on the order of rows. Rows with a null or NaN
feature or target are not learnt from, and null or NaN features get a null
prediction; with fewer than k rows all of them are averaged.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

PIVOTS = 64
RING_ROWS = 64
DIGITS = 9


def _distance(a: Column, b: Column, p: int) -> Column:
    total = F.lit(0.0)
    for i in range(p):
        total = total + (a[i] - b[i]) * (a[i] - b[i])
    return F.sqrt(total)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose features are all numbers, with the vector ``x`` (minus zero is zero)."""
    parts = [F.col(f"`{c}`").cast("double") for c in cols]
    good = F.lit(True)
    for c in parts:
        good = good & c.isNotNull() & ~F.isnan(c)
    return df.where(good).withColumn("x", F.array(*[c + F.lit(0.0) for c in parts]))


def build(df: DataFrame, cols: Sequence[str], label: str, k: int, path: str, pivots: int = PIVOTS) -> dict:
    """Write the index of ``df`` to ``path``; returns pivots and cells (small)."""
    p = len(cols)
    y = F.col(f"`{label}`").cast("double")
    rows = _vectors(df.where(y.isNotNull() & ~F.isnan(y)), cols).select("x", y.alias("y"))
    lowest = rows.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("y"))).where(F.col("n") <= k)
    entries = lowest.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("ys"))  # at most k each
    spark = df.sparkSession
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.schema(entries.schema).parquet(f"{path}/entries")
    chosen = [list(r["x"]) for r in entries.orderBy(F.xxhash64("x"), "x").select("x").limit(pivots).collect()]
    if not chosen:
        return {"p": p, "k": k, "pivots": [], "cells": []}
    placed = entries.withColumn("at", _nearest(F.col("x"), chosen, p)).select("x", "ys", F.col("at.cell").alias("cell"), F.col("at.d").alias("d"))
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ys")).alias("targets"), F.max("d").alias("radius")).collect()}
    cells = []
    for j in range(len(chosen)):
        r = sizes.get(j)
        rings = max(1, -(-r["n"] // RING_ROWS)) if r else 1
        radius = float(r["radius"]) if r else 0.0
        cells.append({"targets": int(r["targets"]) if r else 0, "radius": radius, "rings": rings, "width": radius / rings or 1.0})
    width, last = _literals([c["width"] for c in cells]), _literals([c["rings"] - 1 for c in cells])
    ring = F.least(F.floor(F.col("d") / F.element_at(width, F.col("cell") + 1)), F.element_at(last, F.col("cell") + 1)).cast("int")
    placed.withColumn("ring", ring).write.parquet(f"{path}/index")
    return {"p": p, "k": k, "pivots": chosen, "cells": cells}


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pivot_array(pivots: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in pivots])


def _to_pivots(x: Column, pivots: Sequence[Sequence[float]], p: int) -> Column:
    return F.transform(_pivot_array(pivots), lambda v: _distance(x, v, p))


def _nearest(x: Column, pivots: Sequence[Sequence[float]], p: int) -> Column:
    return F.array_min(F.transform(_to_pivots(x, pivots, p), lambda d, j: F.struct(d.alias("d"), j.alias("cell"))))


def _kth(entries: Column, k: int) -> Column:
    """Distance within which (distance, targets) entries, sorted, hold k targets; null if they do not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("d"))
    reached = F.aggregate(entries, start, lambda a, e: F.struct((a["n"] + e["n"]).cast("int").alias("n"), F.when(a["n"] < k, e["d"]).otherwise(a["d"]).alias("d")))
    return F.when(reached["n"] >= k, reached["d"])


def _rings(state: dict, low: Column, high: Column, j: Column) -> Column:
    width, last = _literals([c["width"] for c in state["cells"]]), _literals([c["rings"] - 1 for c in state["cells"]])
    a = F.greatest(F.floor(low / F.element_at(width, j + 1)), F.lit(0))
    b = F.least(F.floor(high / F.element_at(width, j + 1)), F.element_at(last, j + 1).cast("long"))
    return F.when(a <= b, F.sequence(a.cast("int"), b.cast("int"))).otherwise(F.array().cast("array<int>"))


def _meet(asked: DataFrame, index: DataFrame, state: dict) -> DataFrame:
    """(q, d, ys) of every entry in an asked ring that the ring bound leaves open."""
    p = state["p"]
    pairs = asked.join(index, ["cell", "ring"]).where(F.abs(F.col("dq") - F.col("d")) <= F.col("bound"))
    return pairs.select("q", F.round(_distance(F.col("q"), F.col("x"), p), DIGITS).alias("d"), "ys", "bound").where(F.col("d") <= F.col("bound"))


def _best(met: DataFrame, k: int) -> DataFrame:
    """(q, near): the k nearest (distance, target), sorted."""
    one = met.select("q", "d", F.explode("ys").alias("y"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "y"))
    return one.withColumn("n", rank).where(F.col("n") <= k).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "y"))).alias("near"))


def search(queries: DataFrame, path: str, state: dict) -> tuple[DataFrame, DataFrame]:
    """((q, near) of every distinct vector ``q``, the (q, cell, ring) rows that were asked)."""
    spark, k, p = queries.sparkSession, state["k"], state["p"]
    index = spark.read.parquet(f"{path}/index")
    cells = state["cells"]
    radius, targets = _literals([c["radius"] for c in cells]), _literals([c["targets"] for c in cells])
    q = queries.withColumn("dp", _to_pivots(F.col("q"), state["pivots"], p))
    reach = F.array_sort(F.transform("dp", lambda d, j: F.struct((d + F.element_at(radius, j + 1)).alias("d"), F.element_at(targets, j + 1).alias("n"))))
    slack = F.lit(2 * 10.0**-DIGITS)
    q = q.withColumn("bound", F.coalesce(_kth(reach, k), F.lit(float("inf"))) + slack)
    q = q.withColumn("home", F.array_min(F.transform("dp", lambda d, j: F.struct(d.alias("d"), j.alias("cell")))))
    where_ = scratch_path(spark, "knn-queries")
    q.write.parquet(where_)
    q = spark.read.schema(q.schema).parquet(where_)

    width = _literals([c["width"] for c in cells])
    w = F.element_at(width, F.col("home.cell") + 1)
    first = q.select("q", F.col("home.d").alias("dq"), "bound", F.col("home.cell").alias("cell"), F.explode(_rings(state, F.col("home.d") - w, F.col("home.d") + w, F.col("home.cell"))).alias("ring"))
    seen = _best(_meet(first, index, state), k).select("q", F.when(F.size("near") >= k, F.element_at("near", k)["d"] + slack).alias("found"))
    second = q.join(seen, "q", "left").withColumn("bound", F.least("bound", F.coalesce("found", "bound")))

    each = F.transform("dp", lambda d, j: F.struct(d.alias("dq"), j.alias("cell")))
    apart = _literals([0.0])
    if len(cells) > 1:
        rows = [[sum((a - b) ** 2 for a, b in zip(u, v)) ** 0.5 for v in state["pivots"]] for u in state["pivots"]]
        apart = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    # farther from the bisector of home and this pivot than the bound: nothing here is near enough
    gap = (F.col("c.dq") * F.col("c.dq") - F.col("home.d") * F.col("home.d")) / (2 * F.element_at(F.element_at(apart, F.col("home.cell") + 1), F.col("c.cell") + 1))
    open_ = (F.col("c.cell") == F.col("home.cell")) | (gap <= F.col("bound")) if len(cells) > 1 else F.lit(True)
    asked = second.select("q", "bound", "home", F.explode(each).alias("c")).where(open_)
    low, high = F.col("c.dq") - F.col("bound"), F.col("c.dq") + F.col("bound")
    some = F.element_at(targets, F.col("c.cell") + 1) > 0
    asked = asked.where(some).select("q", F.col("c.dq").alias("dq"), "bound", F.col("c.cell").alias("cell"), F.explode(_rings(state, low, high, F.col("c.cell"))).alias("ring"))
    return _best(_meet(asked, index, state), k), asked


class _KnnParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "target column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "folder of the index (shared); a scratch folder unless set", TypeConverters.toString)

    def _init_defaults(self):
        self._setDefault(inputCols=[], labelCol="label", predictionCol="prediction", k=5, path="")


class MetricKnnModel(Model, _KnnParams, DefaultParamsReadable, DefaultParamsWritable):
    """Refers to the index in ``path``, which has to stay."""

    learnt = Param(Params._dummy(), "learnt", "pivots and cells, as JSON", TypeConverters.toString)

    def __init__(self, learnt: str = "{}", **kw):
        super().__init__()
        self._init_defaults()
        self._setDefault(learnt="{}")
        self._set(learnt=learnt, **kw)

    @property
    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.learnt))

    def queries(self, df: DataFrame) -> DataFrame:
        return _vectors(df, self.getOrDefault(self.inputCols)).select(F.col("x").alias("q")).distinct()

    def asked(self, df: DataFrame) -> DataFrame:
        """Share of (query, entry) pairs that are compared: pairs, all_pairs."""
        state, path = self.state, self.getOrDefault(self.path)
        _, asked = search(self.queries(df), path, state)
        size = df.sparkSession.read.parquet(f"{path}/index").groupBy("cell", "ring").count()
        both = asked.join(size, ["cell", "ring"]).agg(F.sum("count").alias("pairs"))
        n = size.agg(F.sum("count").alias("n")).first()["n"]
        return both.withColumn("all_pairs", F.lit(self.queries(df).count() * n))

    def _transform(self, df: DataFrame) -> DataFrame:
        out, state = self.getOrDefault(self.predictionCol), self.state
        if not state["pivots"]:
            return df.withColumn(out, F.lit(None).cast("double"))
        near, _ = search(self.queries(df), self.getOrDefault(self.path), state)
        mean = F.aggregate("near", F.lit(0.0), lambda a, e: a + e["y"]) / F.size("near")
        path = scratch_path(df.sparkSession, "knn-answers")
        near.select("q", mean.alias(out)).write.parquet(path)
        answers = df.sparkSession.read.parquet(path)
        cols = self.getOrDefault(self.inputCols)
        key = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in cols])
        return df.drop(out).withColumn("__q", key).join(answers.withColumnRenamed("q", "__q"), "__q", "left").drop("__q")


class MetricKnn(Estimator, _KnnParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols: Sequence[str] = (), labelCol: str = "label", predictionCol: str = "prediction", k: int = 5, path: str = ""):
        super().__init__()
        self._init_defaults()
        self._set(inputCols=list(inputCols), labelCol=labelCol, predictionCol=predictionCol, k=k, path=path)

    def _fit(self, df: DataFrame) -> MetricKnnModel:
        cols, label, k = (self.getOrDefault(x) for x in (self.inputCols, self.labelCol, self.k))
        path = self.getOrDefault(self.path) or scratch_path(df.sparkSession, "knn")
        state = build(df, cols, label, k, path)
        return MetricKnnModel(learnt=json.dumps(state), inputCols=cols, labelCol=label, predictionCol=self.getOrDefault(self.predictionCol), k=k, path=path)
