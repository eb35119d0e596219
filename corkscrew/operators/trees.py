"""Trees grown level by level from histograms, and the ensembles made of them.

Features are put into bins once, and rows that no step can tell apart become
one weighted row (``merged``). A level of any number of trees is one pass: each
partition adds its rows' statistics up by (node, feature, bin), the sums of a
node meet in one task (in groups of nodes below ``MAX_CELLS``) and decide its
split there; the driver gets the splits, never the sums of the bins. Rows find
their node by walking the trees so far, so no row moves after merging.

* ``fit_boosting``: second-order boosting. Gradients and hessians of the
  softmax (one tree a class and round, all classes in one pass) or of the
  squared error; splits by ``G^2 / (H + l2)``; depth-wise, or leaf-wise: of
  the level-wise tree the ``max_leaves - 1`` splits that a best-first growth
  takes. Scores travel with the rows and are checkpointed every few rounds.
* ``fit_extra_trees``: per node and drawn feature one threshold drawn between
  the node's smallest and largest value, the best of these by Gini impurity
  or variance; no bootstrap; all trees in the same passes. Draws depend on
  seed, tree, node and feature only.
* ``fit_adaboost``: SAMME (stumps) and AdaBoost.R2 (linear loss, weighted
  median), rounds that re-weight rows by the last round's weighted error.

Missing feature values go into the lowest bin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import Held, blocks, fit_on, reduced, total

MAX_BINS = 256
#: Numbers in the histograms of one pass.
MAX_CELLS = 1 << 23
CHECKPOINT_ROUNDS = 20


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: a value belongs to the
    first bin whose edge is not below it. Edges are exact while a feature has
    fewer values than bins, else approximate quantiles (one pass for all)."""
    if not features:
        return []
    shares = [i / max_bins for i in range(1, max_bins)]
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    few = [F.slice(F.sort_array(F.collect_set(F.when(~F.isnan(c), c))), 1, max_bins + 1) for c in cols]
    approx = df.agg(*[F.approx_count_distinct(c, 0.05).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    exact = [i for i in range(len(cols)) if approx[f"n{i}"] <= max_bins // 2]
    aggs = [few[i].alias(f"e{i}") if i in exact else F.percentile_approx(cols[i], shares, 10_000).alias(f"e{i}") for i in range(len(cols))]
    row = df.agg(*aggs).first()
    out = []
    for i in range(len(cols)):
        values = np.unique(np.array([v for v in (row[f"e{i}"] or []) if v is not None and v == v], float))
        out.append(values[:-1] if i in exact else values)  # nothing lies above the largest
    return out


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint16)
    for j, e in enumerate(edges):
        col = np.where(np.isnan(x[:, j]), -np.inf, x[:, j])
        out[:, j] = np.searchsorted(e, col, "left")
    return out


def merged(df: DataFrame, features: Sequence[str], target: str, edges: Sequence[np.ndarray], weight: str | None, squared: bool) -> DataFrame:
    """Rows (x0.., y, w) with one row for all that share their bins and target;
    a value becomes the upper edge of its bin. ``squared``: a fit that needs of
    a bin's targets their weighted sum alone, so that rows that share their bins
    are one row with the mean target."""
    p = len(features)
    w = F.col(f"`{weight}`").cast("double") if weight and weight in df.columns else F.lit(1.0)
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(features)], F.col(f"`{target}`").cast("double").alias("y"), w.alias("w"))
    keys = [f"x{j}" for j in range(p)]

    def to_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [np.append(e, np.inf) for e in edges]
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:p]]
            b = to_bins(np.column_stack(x), edges) if x else None
            yield pa.RecordBatch.from_arrays([*[pa.array(tops[j][b[:, j]]) for j in range(p)], *batch.columns[p:]], schema=batch.schema)

    rows = wide.mapInArrow(to_edges, wide.schema) if p else wide
    if not squared:
        return rows.groupBy(*keys, "y").agg(F.sum("w").alias("w")).select(*keys, "y", "w")
    rows = rows.groupBy(*keys).agg((F.sum(F.col("y") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("y"), F.sum("w").alias("w"))
    return rows.select(*keys, F.coalesce("y", F.lit(0.0)).alias("y"), "w")


@dataclass
class Tree:
    """Nodes in the order of their making; ``feature`` -1 marks a leaf. Rows
    with bin <= ``bin`` go to ``left``, the others to the node after it."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    sums: list[list[float]] = field(default_factory=lambda: [[]])
    value: list[list[float]] = field(default_factory=list)

    def split(self, node: int, feature: int, bin_: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node], self.left[node] = feature, bin_, gain, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.gain.append(0.0)
            self.sums.append([])
        return len(self.feature) - 2, len(self.feature) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, bin_, left = (np.asarray(v) for v in (self.feature, self.bin, self.left))
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            step = left[node] + (bins[rows, np.maximum(f, 0)] > bin_[node])
            node = np.where(inner, step, node)

    def best_first(self, max_leaves: int) -> None:
        """Keep the splits that growth by the largest gain would take."""
        keep, open_ = set(), [0] if self.feature[0] >= 0 else []
        while open_ and len(keep) < max_leaves - 1:
            at = max(open_, key=lambda n: (self.gain[n], -n))
            open_.remove(at)
            keep.add(at)
            open_ += [c for c in (self.left[at], self.left[at] + 1) if self.feature[c] >= 0]
        for n in range(len(self.feature)):
            if n not in keep:
                self.feature[n] = -1


def _splits(rdd: RDD | Held, trees: list[Tree], active: list[tuple[int, int]], bins: int, stats, choose) -> dict:
    """Slot -> (sums, split or None, sums of both children); ``active`` lists a
    slot's (tree, node); ``stats(element)`` gives (bins, rows x trees-or-1 x
    statistics); ``choose`` decides from a node's (feature, bin, statistic) sums."""
    slots: dict[int, dict[int, int]] = {}
    for s, (t, n) in enumerate(active):
        slots.setdefault(t, {})[n] = s

    def of(element):
        b, stat = stats(element)
        n, p = b.shape
        out = np.zeros((len(active) * p * bins, stat.shape[2]))
        for t, own in slots.items():
            slot_of = np.full(len(trees[t].feature), -1, np.int64)
            slot_of[list(own)] = list(own.values())
            slot = slot_of[trees[t].leaf_of(b)]
            rows = np.flatnonzero(slot >= 0)
            at = ((slot[rows, None] * p + np.arange(p)) * bins + b[rows]).ravel()
            s = stat[rows, t if stat.shape[1] > 1 else 0]
            for k in range(s.shape[1]):
                out[:, k] += np.bincount(at, np.repeat(s[:, k], p), len(out))
        return out.reshape(len(active), p, bins, -1)

    def decide(slot, h):
        sums = h[0].sum(0).tolist() if len(h) else []
        found = choose(*active[slot], h)
        if found is None:
            return sums, None, None
        f, b, _ = found
        return sums, found, [h[f, : b + 1].sum(0).tolist(), h[f, b + 1 :].sum(0).tolist()]

    if isinstance(rdd, Held):
        hist = total(rdd, of)
        return {} if hist is None else {s: decide(s, h) for s, h in enumerate(hist)}

    def parts(it):
        hist = reduced(map(of, it))
        return [] if hist is None else enumerate(hist)

    width = max(1, min(rdd.getNumPartitions(), len(active)))
    return dict(rdd.mapPartitions(parts).reduceByKey(np.add, width).map(lambda x: (x[0], decide(*x))).collect())


def grow(rdd: RDD | Held, n_trees: int, bins: int, n_features: int, stats, n_stats: int, choose, max_depth: int) -> list[Tree]:
    """Grow ``n_trees`` trees side by side. ``choose(tree, node, hist)`` returns
    (feature, bin, gain) or None; node sums are kept in the trees. The sums of
    the deepest nodes come from their parents' splits."""
    trees = [Tree() for _ in range(n_trees)]
    level = [(t, 0) for t in range(n_trees)]
    cells = max(1, n_features * bins * n_stats)
    pick = choose if max_depth > 0 else lambda t, node, h: None
    for _ in range(max(1, max_depth)):
        following = []
        step = max(1, MAX_CELLS // cells)
        splits = []
        for lo in range(0, len(level), step):
            active = level[lo : lo + step]
            found = _splits(rdd, trees, active, bins, stats, pick)
            if not found:
                return trees
            splits += [found[s] for s in range(len(active))]
        for (t, node), (sums, split, below) in zip(level, splits):
            trees[t].sums[node] = sums
            if split is not None:
                for c, own in zip(trees[t].split(node, *split), below):
                    trees[t].sums[c] = own
                    following.append((t, c))
        level = following
        if not level:
            break
    return trees


def _sides(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = np.cumsum(h, axis=1)[:, :-1]
    return left, h.sum(1, keepdims=True) - left


def second_order_split(h: np.ndarray, l2: float, min_hessian: float, min_rows: float, allowed: np.ndarray | None = None):
    """Best (feature, bin, gain) of a node's (feature, bin, [G, H, rows]) sums; ties: first feature, then bin."""
    if h.shape[1] < 2:
        return None
    left, right = _sides(h)

    def score(s):
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-12)

    gain = 0.5 * (score(left) + score(right) - score(h.sum(1, keepdims=True)))
    ok = (np.minimum(left[..., 1], right[..., 1]) >= min_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= max(min_rows, 1e-12))
    if allowed is not None:
        ok &= allowed[:, None]
    gain = np.where(ok, np.round(gain, 12), -np.inf)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 1e-9 else None


def purity_split(h: np.ndarray, allowed: np.ndarray, moments: bool):
    """Best (feature, bin, gain) where ``allowed``, by the fall in Gini impurity
    (statistics: class weights) or, with ``moments`` (weight, sum, sum of
    squares), in variance; ties: first feature, then bin."""
    if h.shape[1] < 2:
        return None

    def spread(s):
        if moments:
            return s[..., 2] - s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-300)
        n = s.sum(-1)
        return n - (s**2).sum(-1) / np.maximum(n, 1e-300)

    def rows(s):
        return s[..., 0] if moments else s.sum(-1)

    left, right = _sides(h)
    whole = h.sum(1, keepdims=True)
    gain = spread(whole) - spread(left) - spread(right)
    # sums that differ by rounding alone are ties
    gain = np.where(allowed[:, : gain.shape[1]] & (np.minimum(rows(left), rows(right)) > 0), np.round(gain / np.maximum(spread(whole), 1e-300), 10), -1.0)
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return (f, b, float(gain[f, b] * spread(whole)[f, 0])) if gain[f, b] > 0 else None


# ---------------------------------------------------------------- ensembles


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(score: np.ndarray, y: np.ndarray, w: np.ndarray, task: str, hessian: float) -> np.ndarray:
    """(rows, trees, [G, H, rows]) of the loss at ``score``."""
    if task == "regression":
        return np.stack([w[:, None] * (score - y[:, None]), w[:, None] * np.ones_like(score), w[:, None] * np.ones_like(score)], axis=2)
    p = softmax(score)
    g = p - (y[:, None] == np.arange(score.shape[1]))
    h = hessian * p * (1 - p)
    return np.stack([w[:, None] * g, w[:, None] * np.maximum(h, 1e-16), w[:, None] * np.ones_like(p)], axis=2)


def fit_boosting(data: RDD, edges: list[np.ndarray], task: str, n_classes: int, params: dict, seed: int = 42) -> dict:
    """Ensemble of rounds of trees; ``data`` holds (X, Y, w) blocks with class numbers or values."""
    rounds, rate = int(params.get("rounds", 100)), float(params.get("rate", 0.1))
    l2, min_hessian, min_rows = (float(params.get(k, d)) for k, d in (("l2", 1.0), ("min_hessian", 1.0), ("min_rows", 0.0)))
    max_depth, max_leaves = int(params.get("max_depth", 6)), int(params.get("max_leaves", 0))
    hessian, columns = float(params.get("hessian", 2.0)), float(params.get("columns", 1.0))
    p, bins = len(edges), max([len(e) for e in edges], default=0) + 1
    outputs = 1 if task == "regression" else n_classes
    binned = data.map(lambda e: (to_bins(e[0], edges), e[1][:, 0], e[2])).persist(StorageLevel.MEMORY_AND_DISK)
    if task == "regression":
        sums = total(binned, lambda e: np.array([(e[1] * e[2]).sum(), e[2].sum()]))
        base = [float(sums[0] / sums[1])]
    else:
        counts = total(binned, lambda e: np.bincount(e[1].astype(int), e[2], n_classes))
        base = [float(v) for v in np.log(np.maximum(counts, 1e-12) / counts.sum())]
    state = binned.map(lambda e: (*e, np.tile(np.array(base), (len(e[1]), 1)))).persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    ensemble, before = [], None
    for r in range(rounds):
        allowed = None
        if columns < 1 and p:
            allowed = np.zeros(p, bool)
            allowed[rng.choice(p, max(1, round(columns * p)), replace=False)] = True

        def choose(t, node, h):
            return second_order_split(h, l2, min_hessian, min_rows, allowed)

        trees = grow(state, outputs, bins, p, lambda e: (e[0], gradients(e[3], e[1], e[2], task, hessian)), 3, choose, max_depth)
        if before is not None:
            before.unpersist()  # the first pass over the new scores is done
        for tree in trees:
            if max_leaves:
                tree.best_first(max_leaves)
            tree.value = [[-rate * s[0] / (s[1] + l2) if s and s[1] + l2 > 0 else 0.0] for s in tree.sums]
        ensemble.append(trees)
        if r + 1 == rounds or all(t.feature[0] < 0 for t in trees):  # nothing left to split: later rounds would be the same leaf
            break

        def move(e, trees=trees):
            return (*e[:3], e[3] + np.stack([np.array([v[0] for v in t.value])[t.leaf_of(e[0])] for t in trees], axis=1))

        new = state.map(move).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CHECKPOINT_ROUNDS == 0:
            new.checkpoint()
        before, state = state, new
    state.unpersist()
    binned.unpersist()
    return {"kind": "boosting", "base": base, "trees": [[_dump(t) for t in trees] for trees in ensemble]}


def fit_extra_trees(data: RDD, edges: list[np.ndarray], task: str, n_classes: int, params: dict, seed: int = 42) -> dict:
    n_trees, max_depth = int(params.get("trees", 100)), int(params.get("max_depth", 30))
    p, bins = len(edges), max([len(e) for e in edges], default=0) + 1
    take = p if task == "regression" else max(1, int(np.sqrt(p)))
    binned = data.map(lambda e: (to_bins(e[0], edges), e[1][:, 0], e[2])).persist(StorageLevel.MEMORY_AND_DISK)

    def stats(e):
        y, w = e[1], e[2]
        s = np.stack([w, w * y, w * y * y], axis=1) if task == "regression" else (y[:, None] == np.arange(n_classes)) * w[:, None]
        return e[0], s[:, None, :]

    def choose(t, node, h):
        allowed = np.zeros(h.shape[:2], bool)
        for f, b in drawn_thresholds(h, edges, take, (seed, t, node)):
            allowed[f, b] = True
        return purity_split(h, allowed, task == "regression")

    trees = grow(binned, n_trees, bins, p, stats, 3 if task == "regression" else n_classes, choose, max_depth)
    binned.unpersist()
    for t in trees:
        t.value = [([s[1] / s[0]] if task == "regression" else (np.array(s) / sum(s)).tolist()) if s and sum(s) else [] for s in t.sums]
    return {"kind": "mean", "trees": [[_dump(t)] for t in trees]}


def drawn_thresholds(h: np.ndarray, edges: Sequence[np.ndarray], take: int, key: tuple[int, int, int]) -> list[tuple[int, int]]:
    """(feature, bin) for ``take`` features drawn among those that vary in the
    node, each with a threshold drawn evenly between its ends there."""
    count = np.abs(h).sum(2) > 0
    rng = np.random.default_rng(list(key))
    out = []
    for f in rng.permutation(len(h)):
        there = np.flatnonzero(count[f])
        if len(there) < 2:
            continue
        lo, hi = int(there[0]), int(there[-1])
        e = edges[f]
        u = rng.uniform(e[lo], e[hi] if hi < len(e) else e[hi - 1])
        out.append((int(f), int(np.clip(np.searchsorted(e, u, "right") - 1, lo, hi - 1))))
        if len(out) == take:
            break
    return out


def weighted_tree(binned: RDD, edges, task: str, n_classes: int, max_depth: int) -> Tree:
    """One tree by best Gini or variance splits on (bins, y, weight, boost weight) elements."""
    p, bins = len(edges), max([len(e) for e in edges], default=0) + 1

    def stats(e):
        y, w = e[1], e[2] * e[3]
        s = np.stack([w, w * y, w * y * y], axis=1) if task == "regression" else (y[:, None] == np.arange(n_classes)) * w[:, None]
        return e[0], s[:, None, :]

    def choose(t, node, h):
        return purity_split(h, np.ones(h.shape[:2], bool), task == "regression")

    tree = grow(binned, 1, bins, p, stats, 3 if task == "regression" else n_classes, choose, max_depth)[0]
    if task == "regression":
        tree.value = [[s[1] / s[0]] if s and s[0] else [0.0] for s in tree.sums]
    else:
        tree.value = [[float(np.argmax(np.round(s, 12)))] if s else [0.0] for s in tree.sums]
    return tree


def fit_adaboost(data: RDD, edges: list[np.ndarray], task: str, n_classes: int, params: dict, seed: int = 42) -> dict:
    rounds, rate = int(params.get("rounds", 50)), float(params.get("rate", 1.0))
    depth = int(params.get("max_depth", 3 if task == "regression" else 1))
    binned = data.map(lambda e: (to_bins(e[0], edges), e[1][:, 0], e[2])).persist(StorageLevel.MEMORY_AND_DISK)
    n = float(total(binned, lambda e: np.array([e[2].sum()]))[0])
    state = binned.map(lambda e: (*e, np.full(len(e[1]), 1 / n))).persist(StorageLevel.MEMORY_AND_DISK)
    trees, weights, errors = [], [], []
    for r in range(rounds):
        tree = weighted_tree(state, edges, task, n_classes, depth)
        value = np.array([v[0] for v in tree.value])

        def miss(e, tree=tree, value=value):
            found = value[tree.leaf_of(e[0])]
            return np.abs(e[1] - found) if task == "regression" else (found != e[1]).astype(float)

        if task == "regression":
            most = float(total(state, lambda e: miss(e).max(initial=0.0), max))
        else:
            most = 1.0
        sums = total(state, lambda e: np.array([(e[2] * e[3] * miss(e)).sum(), (e[2] * e[3]).sum()]))
        error = float(sums[0] / sums[1] / most) if most > 0 else 0.0
        limit = 0.5 if task == "regression" else 1 - 1 / n_classes
        if error >= limit and trees:
            break
        trees.append(tree)
        errors.append(error)
        if error <= 1e-12 or error >= limit:  # perfect, or no better than chance from the start
            weights.append(1.0)
            break
        if task == "regression":
            beta = error / (1 - error)
            weights.append(float(rate * np.log(1 / beta)))
            factor = lambda e, b=beta, m=most: b ** (rate * (1 - miss(e) / m))
        else:
            alpha = float(rate * (np.log((1 - error) / error) + np.log(n_classes - 1)))
            weights.append(alpha)
            factor = lambda e, a=alpha: np.exp(a * miss(e))
        after = float(total(state, lambda e: np.array([(e[2] * e[3] * factor(e)).sum()]))[0])
        new = state.map(lambda e, f=factor, z=after: (*e[:3], e[3] * f(e) / z)).persist(StorageLevel.MEMORY_AND_DISK)
        if (r + 1) % CHECKPOINT_ROUNDS == 0 and r + 1 < rounds:
            new.checkpoint()
        new.foreachPartition(lambda it: None)
        state.unpersist()
        state = new
    state.unpersist()
    binned.unpersist()
    return {"kind": "median" if task == "regression" else "vote", "weights": weights, "errors": errors, "trees": [[_dump(t)] for t in trees]}


FITS = {"boosting": fit_boosting, "extra_trees": fit_extra_trees, "adaboost": fit_adaboost}


def _dump(t: Tree) -> dict:
    return {"feature": t.feature, "bin": t.bin, "left": t.left, "value": t.value, "gain": t.gain, "sums": t.sums}


def _load(d: dict) -> Tree:
    return Tree(d["feature"], d["bin"], d["left"], d["gain"], d["sums"], d["value"])


def predict_blocks(model: dict, x: np.ndarray) -> np.ndarray:
    """Class number or value of each row."""
    bins = to_bins(x, [np.array(e, float) for e in model["edges"]])
    groups = [[_load(t) for t in g] for g in model["trees"]]
    if model["kind"] == "boosting":
        score = np.tile(np.array(model["base"]), (len(x), 1))
        for trees in groups:
            score = score + np.stack([np.array([v[0] for v in t.value])[t.leaf_of(bins)] for t in trees], axis=1)
        return score[:, 0] if model["task"] == "regression" else np.round(score, 9).argmax(1)
    if model["kind"] == "mean":
        width = 1 if model["task"] == "regression" else model["n_classes"]
        score = sum(np.array([v or [0.0] * width for v in g[0].value])[g[0].leaf_of(bins)] for g in groups) / max(1, len(groups))
        return score[:, 0] if model["task"] == "regression" else np.round(score, 9).argmax(1)
    found = np.stack([np.array([v[0] for v in g[0].value])[g[0].leaf_of(bins)] for g in groups], axis=1)
    weight = np.array(model["weights"])
    if model["kind"] == "vote":
        votes = np.stack([((found == k) * weight).sum(1) for k in range(model["n_classes"])], axis=1)
        return np.round(votes, 9).argmax(1)
    order = np.argsort(found, axis=1, kind="stable")
    reach = np.cumsum(weight[order], axis=1)
    at = (reach >= 0.5 * weight.sum() - 1e-12).argmax(1)
    return np.take_along_axis(found, order, 1)[np.arange(len(x)), at]


class CellAnswers:
    """Answers of a task: rows that share the bins of all features share theirs,
    which is found once (of the first ``most`` such cells that a task meets)."""

    def __init__(self, model: dict, most: int = 1 << 18):
        self.model, self.most = model, most
        self.edges = [np.array(e, float) for e in model["edges"]]
        self.few = np.prod([len(e) + 1.0 for e in self.edges]) < 2.0**62
        self.cells, self.found = np.zeros(0, np.int64), np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.few or not len(x):
            return predict_blocks(self.model, x).astype(float)
        bins, cell = to_bins(x, self.edges), np.zeros(len(x), np.int64)
        for j, e in enumerate(self.edges):
            cell = cell * (len(e) + 1) + bins[:, j]
        cells, first, own = np.unique(cell, return_index=True, return_inverse=True)
        at = np.searchsorted(self.cells, cells)
        known = np.append(self.cells, -1)[at] == cells
        out = np.empty(len(cells))
        out[known] = self.found[at[known]]
        if not known.all():
            out[~known] = predict_blocks(self.model, x[first[~known]])
            if len(self.cells) < self.most:
                self.cells, self.found = (np.insert(a, at[~known], v[~known]) for a, v in ((self.cells, cells), (self.found, out)))
        return out[own]


class _TreeParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight column, if any", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    config = Param(Params._dummy(), "config", "kind, task and numbers, as JSON", TypeConverters.toString)

    def _init_defaults(self):
        self._setDefault(inputCols=[], labelCol="label", weightCol="", predictionCol="prediction", config="{}")


class TreeEnsembleModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    learnt = Param(Params._dummy(), "learnt", "edges, classes and trees, as JSON", TypeConverters.toString)

    def __init__(self, learnt: str = "{}", **kw):
        super().__init__()
        self._init_defaults()
        self._setDefault(learnt="{}")
        self._set(learnt=learnt, **kw)

    @property
    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.learnt))

    def trees(self, df: DataFrame) -> DataFrame:
        """Nodes as rows (round, output, node, feature, threshold, left, gain, sums)."""
        state, cols = self.state, self.getOrDefault(self.inputCols)
        rows = []
        for r, group in enumerate(state["trees"]):
            for k, t in enumerate(group):
                for n, f in enumerate(t["feature"]):
                    inner = f >= 0
                    rows.append((r, k, n, cols[f] if inner else None, float(state["edges"][f][t["bin"][n]]) if inner else None, t["left"][n] if inner else None, float(t["gain"][n]) if inner and t["gain"] else None, [float(s) for s in t["sums"][n]] if t["sums"] else []))
        return df.sparkSession.createDataFrame(rows, "round int, output int, node int, feature string, threshold double, left int, gain double, sums array<double>")

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state

        @F.pandas_udf("double")
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            found = CellAnswers(state)
            for x in batches:
                yield pd.Series(found(x.to_numpy(dtype=float)))

        cols = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(self.getOrDefault(self.inputCols))]
        found = predict(F.struct(*cols))
        if state["task"] != "regression":
            found = F.element_at(F.array(*[F.lit(c) for c in state["classes"]]), found.cast("int") + 1)
        return df.withColumn(self.getOrDefault(self.predictionCol), found)


class TreeEnsemble(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols: Sequence[str] = (), labelCol: str = "label", weightCol: str = "", predictionCol: str = "prediction", config: str = "{}"):
        super().__init__()
        self._init_defaults()
        self._set(inputCols=list(inputCols), labelCol=labelCol, weightCol=weightCol, predictionCol=predictionCol, config=config)

    def _fit(self, df: DataFrame) -> TreeEnsembleModel:
        config = json.loads(self.getOrDefault(self.config))
        cols, label, weight = (self.getOrDefault(x) for x in (self.inputCols, self.labelCol, self.weightCol))
        task = config["task"]
        ensure_checkpoint_dir(df.sparkSession)
        df = df.where(F.col(f"`{label}`").isNotNull())
        edges = bin_edges(df, cols, int(config.get("max_bins", MAX_BINS)))
        classes, target = [], F.col(f"`{label}`").cast("double")
        if task != "regression":
            classes = sorted(r[0] for r in df.select(F.col(f"`{label}`")).distinct().collect())  # one row a class
            target = class_number(F.col(f"`{label}`"), classes)
        rows = df.withColumn("__y", target)
        rows = merged(rows, cols, "__y", edges, weight, task == "regression" and config["kind"] == "boosting").persist()
        n = rows.count()
        of, seed, n_classes = FITS[config["kind"]], int(config.get("seed", 42)), len(classes)
        learnt = fit_on(blocks(rows, rows.columns[:-2], "y", "w", rows=n), n, lambda data: of(data, edges, task, n_classes, config, seed))
        rows.unpersist()
        learnt.update(task=task, classes=classes, n_classes=len(classes), edges=[e.tolist() for e in edges])
        return TreeEnsembleModel(learnt=json.dumps(learnt), inputCols=cols, labelCol=label, predictionCol=self.getOrDefault(self.predictionCol), config=self.getOrDefault(self.config))


def class_number(label: Column, classes: Sequence) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), label) - 1).cast("double")
