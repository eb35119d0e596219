"""Least-angle path against optimality conditions and normal equations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscrew.operators.lars import centred, lars_path
from corkscrew.operators.models import fit_pipeline, lars_rows, make_pipeline, regression_registry

COLS = ["a", "b", "c", "d", "flat"]


def rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4))
    y = x @ [2.0, -1.0, 0.0, 0.5] + rng.normal(size=n)
    return np.column_stack([x, np.full(n, 3.0)]), y


def sums(x, y):
    c, d = x - x.mean(0), y - y.mean()
    return c.T @ c, c.T @ d, len(y)


@pytest.mark.parametrize("seed", range(8))
def test_lasso_knots_are_optimal(seed):
    """At every knot: |X'r| = n alpha with the coefficient's sign on the support, at most n alpha elsewhere."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9))
    gram, xy, n = sums(x, x @ rng.normal(size=9) + 3 * rng.normal(size=60))
    knots = lars_path(gram, xy, n, lasso=True)
    alphas = [k["alpha"] for k in knots]
    assert all(u >= v - 1e-9 for u, v in zip(alphas, alphas[1:]))
    for k in knots:
        corr = xy - gram @ k["coef"]
        assert np.abs(corr).max() <= n * k["alpha"] + 1e-7 * np.abs(xy).max()
        on = np.abs(k["coef"]) > 1e-12
        np.testing.assert_allclose(corr[on], np.sign(k["coef"][on]) * n * k["alpha"], atol=1e-7 * np.abs(xy).max())
    np.testing.assert_allclose(knots[-1]["coef"], np.linalg.solve(gram, xy), rtol=1e-6, atol=1e-8)
    # between knots the path is a straight line: the same holds half-way
    for u, v in zip(knots, knots[1:]):
        half, alpha = (u["coef"] + v["coef"]) / 2, (u["alpha"] + v["alpha"]) / 2
        assert np.abs(xy - gram @ half).max() <= n * alpha + 1e-7 * np.abs(xy).max()


def test_some_lasso_path_drops_a_feature():
    dropped = 0
    for seed in range(30):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9))
        gram, xy, n = sums(x, x @ rng.normal(size=9) + 3 * rng.normal(size=60))
        dropped += sum(k["dropped"] is not None for k in lars_path(gram, xy, n, lasso=True))
    assert dropped > 0


def test_path_in_spark_equals_numpy(spark):
    x, y = rows()
    df = spark.createDataFrame([(*map(float, u), float(v)) for u, v in zip(x, y)], [*COLS, "y"]).repartition(7)
    want = lars_path(*sums(x, y)[:2], len(y))
    got = {(r["step"], r["feature"]): r["coefficient"] for r in lars_rows(df, COLS, "y").collect()}
    assert len(got) == len(want) * len(COLS)
    for k in want:
        for f, c in zip(COLS, k["coef"]):
            assert got[k["step"], f] == pytest.approx(c, abs=1e-9)
    least = np.linalg.lstsq(np.column_stack([x[:, :4], np.ones(len(y))]), y, rcond=None)[0]
    assert [got[want[-1]["step"], f] for f in COLS[:4]] == pytest.approx(least[:4], abs=1e-9)
    assert all(got[k["step"], "flat"] == 0 for k in want)


def test_lasso_lars_model_and_edges(spark):
    x, y = rows()
    data = [(*map(float, u), float(v)) for u, v in zip(x, y)]
    dup = [(*r[:5], r[0], r[5]) for r in data]  # an exact copy of the first feature
    cols = [*COLS, "copy"]
    df = spark.createDataFrame(dup + [(1.0, 1.0, 1.0, 1.0, 3.0, 1.0, None)], [*cols, "y"])
    spec = regression_registry("explo")["LassoLars"]
    model = fit_pipeline(make_pipeline("LassoLars", spec, {"kind": "lasso_lars", "alpha": 0.3}, cols, "y", 0), df)
    coef = model.stages[-1].coef
    w = np.array(coef["weights"][:4]) + np.array([coef["weights"][5], 0, 0, 0])
    gram, xy, n = sums(x[:, :4], y)
    corr = xy - gram @ w
    assert np.abs(corr).max() <= n * 0.3 + 1e-6
    np.testing.assert_allclose(corr[w != 0], np.sign(w[w != 0]) * n * 0.3, rtol=1e-6)
    # nulls count as 0 when predicting
    one = spark.createDataFrame([(None, 0.0, 0.0, 0.0, 0.0, 0.0)], ", ".join(f"{c} double" for c in cols))
    assert model.transform(one).first()["prediction"] == pytest.approx(coef["intercept"])
    none = df.where(F.col("y").isNull())
    assert lars_rows(none, cols, "y").count() == 0
    empty = fit_pipeline(make_pipeline("Lars", regression_registry("explo")["Lars"], {"kind": "lars"}, cols, "y", 0), none)
    assert empty.transform(none).first()["prediction"] == 0.0


def test_centred_sums():
    x, y = rows(50)
    got = centred(50.0, x.sum(0), x.T @ x, np.array([y.sum()]), (x.T @ y)[:, None])
    np.testing.assert_allclose(got[0][:4, :4], sums(x, y)[0][:4, :4], rtol=1e-9)
    np.testing.assert_allclose(got[1][:4], sums(x, y)[1][:4], rtol=1e-9)
