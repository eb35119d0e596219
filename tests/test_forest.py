"""Forests on bootstrapped cells: the trees against brute force, the bootstrap, the way for many cells."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from corkscrew.operators import forest, trees
from corkscrew.operators.models import fit_pipeline, make_pipeline, regression_registry

FEATS = ["a", "b", "c"]


def frame(spark, n, seed=3, noise=0.0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (n, 3)).astype(float)
    y = 3 * x[:, 0] - 2 * x[:, 1] * x[:, 2] + noise * rng.normal(size=n)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3, "id").cache(), x, y


def fitted(df, name="RandomForestRegressor", **params):
    spec = regression_registry()[name]
    return fit_pipeline(make_pipeline(name, spec, {**spec.defaults, **params}, FEATS, "y", 0), df)


def brute(bins, w, y, depth):
    """Mean of each row's leaf of one tree by best splits of all features."""
    mean = (w * y).sum() / w.sum()
    best = (1e-9, None)
    for j in range(bins.shape[1]):
        for b in np.unique(bins[:, j])[:-1]:
            left = bins[:, j] <= b
            gain = sum((w * y)[s].sum() ** 2 / w[s].sum() for s in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
            if gain > best[0] + 1e-9:
                best = (gain, left)
    if depth == 0 or best[1] is None:
        return np.full(len(y), mean)
    out = np.empty(len(y))
    for s in (best[1], ~best[1]):
        out[s] = brute(bins[s], w[s], y[s], depth - 1)
    return out


@pytest.mark.parametrize("depth,step", [(1, 1 << 20), (3, 1 << 20), (30, 8)])
def test_one_tree_equals_brute_force(monkeypatch, depth, step):
    monkeypatch.setattr(forest, "STEP_CELLS", step)
    rng = np.random.default_rng(depth)
    bins = np.unique(rng.integers(0, 5, (60, 3)), axis=0)
    w, y = rng.integers(1, 9, len(bins)).astype(float), rng.normal(size=len(bins))
    feature, bin_, left, value = forest.grow_cells(bins, w, w * y, [5, 5, 5], 3, depth, rng, 1e-9)
    leaf = trees.Tree(feature, bin_, left).leaf_of(bins)
    assert np.allclose(value[leaf], brute(bins, w, y, depth))
    if depth == 30:
        assert np.allclose(value[leaf], y)  # every cell is a leaf


def test_every_row_is_drawn_for_every_tree(spark, monkeypatch):
    monkeypatch.setattr(forest, "FLUSH_CELLS", 10)  # sums of a cell come in several pieces
    df, x, y = frame(spark, 900, noise=1.0)
    wide = df.select(*[F.col(c).alias(f"x{j}") for j, c in enumerate(FEATS)], "y", F.lit(2.0).alias("w"))
    edges = trees.bin_edges(df, FEATS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = forest.bootstrapped(wide, edges, 1.5, 40, 7).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    weight, total = np.zeros((40, 64)), np.zeros((40, 64))
    for r in rows:
        weight[r["tree"], r["cells"]] += r["weights"]
        total[r["tree"], r["cells"]] += r["sums"]
    own = (x @ [16, 4, 1]).astype(int)
    size, mean = np.bincount(own, minlength=64), np.bincount(own, y - 1.5, 64)
    assert (weight % 2 == 0).all() and len({tuple(t) for t in weight}) == 40
    assert np.abs(weight.mean(0) / 2 - size).max() < 5 * np.sqrt(size.max() / 40)
    assert np.abs(total.mean(0) / 2 - mean).max() < 6 * np.sqrt(((y - 1.5) ** 2).max() * size.max() / 40)
    assert len(rows) > 10 * 40


def test_the_whole_forest_is_grown_on_cells(spark, tmp):
    df, x, y = frame(spark, 3000, noise=0.5)
    model = fitted(df)
    found = model.stages[-1]
    assert isinstance(found, trees.TreeEnsembleModel)
    assert len(found.state["trees"]) == 100 and len({str(t) for t in found.state["trees"]}) == 100
    assert found.trees(df).where("feature is null").count() > 100 * 50
    got = np.array([r["prediction"] for r in model.transform(df).orderBy("id").collect()])
    assert np.abs(got - (3 * x[:, 0] - 2 * x[:, 1] * x[:, 2])).max() < 1.0
    assert got.tolist() == [r["prediction"] for r in fitted(df).transform(df).orderBy("id").collect()]
    model.write().overwrite().save(f"{tmp}/m")
    assert got.tolist() == [r["prediction"] for r in PipelineModel.load(f"{tmp}/m").transform(df).orderBy("id").collect()]
    bagged = fitted(df, "BaggingRegressor")
    assert len(bagged.stages[-1].state["trees"]) == 10


def test_many_cells_are_fitted_over_rows(spark, monkeypatch):
    df, _, _ = frame(spark, 2000)
    monkeypatch.setattr(forest, "MAX_CELLS_HELD", 63)
    model = fitted(df, numTrees=5, maxDepth=6)
    assert model.stages[-1].stages[-1].getNumTrees == 5
    assert model.transform(df).where("prediction is null").count() == 0
    monkeypatch.setattr(forest, "MAX_CELLS_HELD", 64)
    assert isinstance(fitted(df, numTrees=5, maxDepth=6).stages[-1], trees.TreeEnsembleModel)


def test_odd_rows(spark):
    df, _, _ = frame(spark, 60)
    missing = df.withColumn("a", F.when(F.col("id") % 3 > 0, F.col("a"))).withColumn("b", F.lit(1.0))
    out = fitted(df, numTrees=4).transform(missing)
    assert out.where("prediction is null or isnan(prediction)").count() == 0
    for bad in (missing, df.withColumn("y", F.when(F.col("id") > 2, F.col("y"))), df.withColumn("y", F.lit(float("nan"))), df.limit(0)):
        with pytest.raises(ValueError):
            fitted(bad, numTrees=2)
    one = df.limit(1)  # trees that draw no row answer with the mean
    assert {r["prediction"] for r in fitted(one, numTrees=9).transform(one).collect()} == {one.first()["y"]}
