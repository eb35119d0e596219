"""Random forests for regression on bootstrapped cells.

Rows that share the bins of all features (a cell) go the same way in every
tree, and a split of the squared error needs of a cell its weight and its sum
of targets alone. So one pass over the rows draws every row's Poisson count for
every tree (the bootstrap of Spark ML's forests) and adds weight and targets up
by (tree, cell); each tree is then grown in a task of its own, a level at a
time over all its nodes. In a node the best threshold of some features drawn
among those that vary there is taken, by the fall in variance.

The cells of a tree are held by one task, so that a table with more than
``MAX_CELLS_HELD`` of them is fitted by Spark ML's own forest over the rows.
Features and labels of the training rows must be finite; a missing value in a
row to be answered goes into the lowest bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import TreeEnsembleModel, _TreeParams, bin_edges, to_bins

#: Most cells of a table whose trees are grown in one task each.
MAX_CELLS_HELD = 50_000
#: Cells whose sums a task of the bootstrap pass holds before it passes them on.
FLUSH_CELLS = 10_000
#: Numbers in the histograms of one step of a tree.
STEP_CELLS = 1 << 20


def cell_numbers(bins: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(bins), np.int64)
    for j, size in enumerate(sizes):
        out = out * size + bins[:, j]
    return out


def cell_bins(cells: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    out = np.empty((len(cells), len(sizes)), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        cells, out[:, j] = np.divmod(cells, sizes[j])
    return out


def draws(rng: np.random.Generator, n_trees: int, rows: int) -> np.ndarray:
    """How often every tree takes every row."""
    return rng.poisson(1.0, (n_trees, rows))


def bootstrapped(wide: DataFrame, edges: Sequence[np.ndarray], base: float, n_trees: int, seed: int) -> DataFrame:
    """(tree, cells, weights, sums) of rows (x0.., y, w): lists over cells of the
    drawn weight and the drawn sum of ``y - base``; a cell may come from many tasks."""
    p, sizes, most = len(edges), [len(e) + 1 for e in edges], FLUSH_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held, sums = np.zeros(0, np.int64), np.zeros((2, n_trees, 0))

        def passed_on() -> pa.RecordBatch:
            taken = [(t, np.flatnonzero(sums[0, t] > 0)) for t in range(n_trees)]
            taken = [(t, c) for t, c in taken if len(c)]
            lists = [[held[c] for _, c in taken], [sums[0, t, c] for t, c in taken], [sums[1, t, c] for t, c in taken]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            arrays = [pa.array([t for t, _ in taken], pa.int32()), *map(pa.array, lists, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["tree", "cells", "weights", "sums"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            cells, at = np.unique(cell_numbers(to_bins(x[:, :p], edges), sizes), return_inverse=True)
            both = np.union1d(held, cells)
            if len(both) > len(held):
                wider = np.zeros((2, n_trees, len(both)))
                wider[:, :, np.searchsorted(both, held)] = sums
                held, sums = both, wider
            at = np.searchsorted(held, cells)[at]
            weights = draws(rng, n_trees, len(x)) * x[:, p + 1]
            for t in range(n_trees):
                sums[0, t] += np.bincount(at, weights[t], len(held))
                sums[1, t] += np.bincount(at, weights[t] * (x[:, p] - base), len(held))
            if len(held) > most:
                yield passed_on()
                held, sums = np.zeros(0, np.int64), np.zeros((2, n_trees, 0))
        if len(held):
            yield passed_on()

    return wide.mapInArrow(run, "tree int, cells array<long>, weights array<double>, sums array<double>")


def grow_cells(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, sizes: Sequence[int], take: int, max_depth: int, rng: np.random.Generator, least: float) -> tuple[np.ndarray, ...]:
    """(feature, bin, left, value) of the nodes of one tree over cells with a
    positive weight; splits that gain no more than ``least`` are none."""
    p, width = bins.shape[1], max(sizes, default=1)
    feature, bin_, left, value = ([np.full(1, v)] for v in (-1, 0, 0, 0.0))
    value[0] = np.array([total.sum() / max(weight.sum(), 1e-300)])
    made, first = 1, 0  # nodes so far; number of the level's first node
    node = np.zeros(len(bins), np.int64)  # place in the level; cells of leaves are left out
    live = np.arange(len(bins))
    for depth in range(max_depth):
        n = len(feature[-1])
        if not len(live):
            break
        order = np.argsort(node, kind="stable")
        live, node = live[order], node[order]
        starts = np.searchsorted(node, np.arange(n))
        there = np.flatnonzero(np.append(starts[1:], len(node)) > starts)  # nodes with cells here
        b = bins[live]
        varies = np.zeros((n, p), bool)
        varies[there] = np.maximum.reduceat(b, starts[there]) > np.minimum.reduceat(b, starts[there])
        drawn = np.where(varies, rng.random((n, p)), np.inf)
        allowed = varies & (np.argsort(np.argsort(drawn, axis=1), axis=1) < take)
        best, f_best, b_best = np.full(n, least), np.full(n, -1), np.zeros(n, np.int64)
        lw, ls = np.zeros(n), np.zeros(n)
        step = max(1, STEP_CELLS // width)
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            own = slice(starts[lo], starts[hi] if hi < n else len(node))
            for j in range(p):
                if sizes[j] < 2 or not allowed[lo:hi, j].any():
                    continue
                key = (node[own] - lo) * sizes[j] + b[own, j]
                w, s = (np.bincount(key, v[live[own]], (hi - lo) * sizes[j]).reshape(hi - lo, sizes[j]) for v in (weight, total))
                wl, sl = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
                wa, sa = w.sum(1, keepdims=True), s.sum(1, keepdims=True)
                present = (w[:, :-1] > 0) & (np.cumsum(w[:, ::-1] > 0, axis=1)[:, ::-1][:, 1:] > 0)  # a row at the threshold, rows above it
                wr, sr = wa - wl, sa - sl
                gain = sl**2 / np.where(present, wl, 1) + sr**2 / np.where(present, wr, 1) - sa**2 / np.maximum(wa, 1e-300)
                gain = np.where(present & allowed[lo:hi, j, None], gain, -np.inf)
                at = gain.argmax(1)
                rows = np.arange(hi - lo)
                better = gain[rows, at] > best[lo:hi]
                for out, new in ((best, gain[rows, at]), (f_best, np.full(hi - lo, j)), (b_best, at), (lw, wl[rows, at]), (ls, sl[rows, at])):
                    out[lo:hi] = np.where(better, new, out[lo:hi])
        split = np.flatnonzero(f_best >= 0)
        if not len(split):
            break
        feature[-1], bin_[-1] = f_best, b_best
        left[-1] = np.zeros(n, np.int64)
        left[-1][split] = made + 2 * np.arange(len(split))
        place = np.full(n, -1)
        place[split] = 2 * np.arange(len(split))
        keep = place[node] >= 0
        live, node = live[keep], node[keep]
        right = bins[live, f_best[node]] > b_best[node]
        node = place[node] + right
        w, s = np.bincount(node, weight[live], 2 * len(split)), np.bincount(node, total[live], 2 * len(split))
        feature.append(np.full(2 * len(split), -1))
        bin_.append(np.zeros(2 * len(split), np.int64))
        left.append(np.zeros(2 * len(split), np.int64))
        value.append(s / np.maximum(w, 1e-300))
        made += 2 * len(split)
    return tuple(np.concatenate(v) for v in (feature, bin_, left, value))


class CellForest(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Forest of ``trees`` bootstrapped regression trees of at most ``max_depth``;
    a node draws ``share`` ("third" or "all") of the features."""

    def __init__(self, inputCols: Sequence[str] = (), labelCol: str = "label", weightCol: str = "", predictionCol: str = "prediction", config: str = "{}"):
        super().__init__()
        self._init_defaults()
        self._set(inputCols=list(inputCols), labelCol=labelCol, weightCol=weightCol, predictionCol=predictionCol, config=config)

    def _fit(self, df: DataFrame):
        config = json.loads(self.getOrDefault(self.config))
        cols, label, weight = (self.getOrDefault(x) for x in (self.inputCols, self.labelCol, self.weightCol))
        n_trees, max_depth, seed = int(config.get("trees", 100)), int(config.get("max_depth", 30)), int(config.get("seed", 42))
        w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
        wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(cols)], F.col(f"`{label}`").cast("double").alias("y"), w.alias("w"))
        odd = F.col("w") < 0
        for c in wide.columns:  # as Spark ML's forests have it
            odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        mean = F.sum(F.col("y") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))
        s = wide.agg(F.count_if(odd).alias("odd"), mean.alias("mean"), F.var_pop("y").alias("var"), F.sum("w").alias("n")).first()
        if s["odd"] or s["mean"] is None:
            raise ValueError("a forest needs rows, finite features and labels, and weights that are not negative")
        edges = bin_edges(df, cols)
        sizes = [len(e) + 1 for e in edges]
        held = cols and float(np.prod(np.array(sizes, float))) < 2.0**62 and self._cells(wide, edges, sizes) <= MAX_CELLS_HELD
        if not held:
            return self._over_rows(config).fit(df)
        take, base, least = len(cols) if config.get("share") == "all" else -(-len(cols) // 3), float(s["mean"]), 1e-12 * float(s["var"] * s["n"])

        def tree(key: tuple, table: pa.Table) -> pa.Table:
            number = key[0].as_py()
            cells, at = np.unique(table.column("cells").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            own = [np.bincount(at, table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), len(cells)) for c in ("weights", "sums")]
            nodes = grow_cells(cell_bins(cells, sizes), *own, sizes, take, max_depth, np.random.default_rng([seed, number]), least)
            return pa.table({"tree": pa.array([number], pa.int32()), **{c: pa.array([v.astype(kind).tobytes()], pa.binary()) for c, v, kind in zip(("feature", "bin", "left", "value"), nodes, ("i4", "i4", "i4", "f8"))}})

        sums = bootstrapped(wide, edges, base, n_trees, seed)
        grown = sums.groupBy("tree").applyInArrow(tree, "tree int, feature binary, bin binary, left binary, value binary").collect()  # n_trees rows
        trees = [[{"feature": [-1], "bin": [0], "left": [0], "value": [[base]], "gain": [], "sums": []}] for _ in range(n_trees)]  # a tree that drew no row
        for r in grown:
            feature, bin_, left = (np.frombuffer(r[c], "i4").tolist() for c in ("feature", "bin", "left"))
            trees[r["tree"]][0].update(feature=feature, bin=bin_, left=left, value=[[v] for v in (np.frombuffer(r["value"]) + base).tolist()])
        learnt = {"kind": "mean", "trees": trees, "task": "regression", "classes": [], "n_classes": 0, "edges": [e.tolist() for e in edges]}
        return TreeEnsembleModel(learnt=json.dumps(learnt), inputCols=cols, labelCol=label, predictionCol=self.getOrDefault(self.predictionCol), config=self.getOrDefault(self.config))

    def _cells(self, wide: DataFrame, edges, sizes) -> int:
        """Number of cells, counted no further than needed."""
        p, most = len(edges), MAX_CELLS_HELD

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(0, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                    held = np.union1d(held, cell_numbers(to_bins(x, edges), sizes))
                if len(held) > most:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["cell"])

        return wide.select(*wide.columns[:p]).mapInArrow(run, "cell long").distinct().count()

    def _over_rows(self, config: dict) -> Pipeline:
        cols, label, weight = (self.getOrDefault(x) for x in (self.inputCols, self.labelCol, self.weightCol))
        est = RandomForestRegressor(
            numTrees=int(config.get("trees", 100)), maxDepth=int(config.get("max_depth", 30)), seed=int(config.get("seed", 42)),
            featureSubsetStrategy="all" if config.get("share") == "all" else "auto",
            featuresCol="_features", labelCol=label, predictionCol=self.getOrDefault(self.predictionCol),
        )
        if weight:
            est.setWeightCol(weight)
        return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep"), est])
