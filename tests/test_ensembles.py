"""Tree ensembles, hinge solver, metric kNN, search: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscrew.operators import blocks as B
from corkscrew.operators import metric_knn, models, selection, trees
from corkscrew.operators.models import classification_registry, fit_pipeline, make_pipeline, regression_registry

FEATS = ["a", "b", "c"]


def frame(spark, x, y):
    rows = [(i, *map(float, r), t) for i, (r, t) in enumerate(zip(x, y))]
    kind = "string" if isinstance(y[0], str) else "double"
    return spark.createDataFrame(rows, f"id long, a double, b double, c double, y {kind}")


def points(seed, n=120, values=6):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, 3)).astype(float)
    return x, x[:, 0] * 2 - x[:, 1] + rng.normal(size=n), rng


def best_split(x, g, h, l2, min_h):
    best = None
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            m = x[:, f] <= t
            if min(h[m].sum(), h[~m].sum()) < min_h:
                continue
            gain = 0.5 * (g[m].sum() ** 2 / (h[m].sum() + l2) + g[~m].sum() ** 2 / (h[~m].sum() + l2) - g.sum() ** 2 / (h.sum() + l2))
            if gain > 1e-9 and (best is None or gain > best[2] + 1e-9):
                best = (f, t, gain)
    return best


def grown(x, g, h, l2, min_h, depth):
    found = best_split(x, g, h, l2, min_h) if depth else None
    if found is None:
        return np.full(len(x), -0.1 * g.sum() / (h.sum() + l2))
    m = x[:, found[0]] <= found[1]
    out = np.empty(len(x))
    for side in (m, ~m):
        out[side] = grown(x[side], g[side], h[side], l2, min_h, depth - 1)
    return out


def boosted(x, y, rounds, depth, n_classes):
    if n_classes:
        score = np.tile(np.log(np.bincount(y, minlength=n_classes) / len(y)), (len(y), 1))
    else:
        score = np.full((len(y), 1), y.mean())
    for _ in range(rounds):
        new = score.copy()
        p = trees.softmax(score)
        for k in range(score.shape[1]):
            g = p[:, k] - (y == k) if n_classes else score[:, 0] - y
            h = 2 * p[:, k] * (1 - p[:, k]) if n_classes else np.ones(len(y))
            new[:, k] += grown(x, g, h, 1.0, 1.0, depth)
        score = new
    return score


@pytest.mark.parametrize("few", [True, False])
def test_boosting_equals_brute_force(spark, monkeypatch, few):
    if not few:  # the same steps as jobs over partitions
        monkeypatch.setattr(B, "ROWS_PER_PARTITION", 40)
    x, t, _ = points(1)
    params = {"rounds": 3, "rate": 0.1, "max_depth": 3}
    spec = regression_registry()["XGBRegressor"]
    got = fit_pipeline(make_pipeline("XGBRegressor", spec, params, FEATS, "y", 0), frame(spark, x, t.tolist())).transform(frame(spark, x, t.tolist()))
    assert np.allclose([r["prediction"] for r in got.orderBy("id").collect()], boosted(x, t, 3, 3, 0)[:, 0])
    y = np.digitize(t, [0, 4])
    labels = [f"k{v}" for v in y]
    spec = classification_registry()["XGBClassifier"]
    got = fit_pipeline(make_pipeline("XGBClassifier", spec, params, FEATS, "y", 3), frame(spark, x, labels)).transform(frame(spark, x, labels))
    assert [r["prediction"] for r in got.orderBy("id").collect()] == [f"k{v}" for v in np.round(boosted(x, y, 3, 3, 3), 9).argmax(1)]


def test_weights_stand_for_rows(spark):
    x, t, _ = points(2, values=3)
    y = ["p" if v > 2 else "q" for v in t]
    df = frame(spark, x, y)
    merged = B.compact(df, [*FEATS, "y"])
    assert merged.count() < 60
    for name in ["XGBClassifier", "LGBMClassifier", "ExtraTreesClassifier", "AdaBoostClassifier", "LinearSVC", "RidgeClassifier", "MultinomialNB", "BernoulliNB"]:
        spec = classification_registry("explo")[name]
        small = {**spec.defaults, **({"trees": 7} if "trees" in spec.defaults else {}), **({"rounds": 5} if "rounds" in spec.defaults else {})}
        one = fit_pipeline(make_pipeline(name, spec, small, FEATS, "y", 2), df).transform(df)
        two = fit_pipeline(make_pipeline(name, spec, small, FEATS, "y", 2, weight=B.WEIGHT), merged).transform(df)
        assert sorted(map(tuple, one.select("id", "prediction").collect())) == sorted(map(tuple, two.select("id", "prediction").collect())), name


def test_every_classifier_takes_two_classes(spark):
    x, t, _ = points(3, values=3)
    y = ["yes" if v > 2 else "no" for v in t]
    df = frame(spark, x, y).cache()
    small = {"numTrees": 3, "maxDepth": 3, "maxIter": 3, "trees": 3, "rounds": 3, "hidden": 4}
    for name, spec in classification_registry("explo").items():
        params = {**spec.defaults, **{k: v for k, v in small.items() if k in spec.defaults}}
        out = fit_pipeline(make_pipeline(name, spec, params, FEATS, "y", 2, len(y)), df).transform(df)
        assert {r[0] for r in out.select("prediction").distinct().collect()} <= {"yes", "no"}, name


def test_best_first_keeps_the_largest_gains():
    t = trees.Tree()
    a, b = t.split(0, 0, 0, 5.0)
    c, d = t.split(a, 0, 0, 1.0)
    t.split(b, 1, 0, 3.0)
    t.split(c, 1, 0, 9.0)
    t.best_first(3)
    assert [f >= 0 for f in t.feature] == [True, False, True] + [False] * (len(t.feature) - 3)


def test_extra_trees_equal_brute_force(spark):
    x, t, _ = points(4, n=60, values=4)
    df = frame(spark, x, t.tolist())
    edges = trees.bin_edges(df, FEATS)
    assert [e.tolist() for e in edges] == [[0, 1, 2]] * 3
    bins = trees.to_bins(x, edges)
    learnt = trees.fit_extra_trees(B.Held([(x, t[:, None], np.ones(60))]), edges, "regression", 0, {"trees": 4, "max_depth": 3}, seed=9)
    again = trees.fit_extra_trees(B.blocks(df, FEATS, "y"), edges, "regression", 0, {"trees": 4, "max_depth": 3}, seed=9)
    for k, (group, other) in enumerate(zip(learnt["trees"], again["trees"])):
        tree = group[0]
        assert tree["feature"] == other[0]["feature"] and tree["bin"] == other[0]["bin"]  # repeats, whatever the partitions
        rows = {0: np.arange(60)}
        for n, f in enumerate(tree["feature"]):
            own = rows[n]
            hist = np.zeros((3, 4, 3))
            for j in range(3):
                for i in own:
                    hist[j, bins[i, j]] += [1, t[i], t[i] ** 2]
            drawn = trees.drawn_thresholds(hist, edges, 3, (9, k, n))
            gains = {}
            for j, b in drawn:
                m = bins[own, j] <= b
                assert 0 < m.sum() < len(own)
                gains[j, b] = len(own) * t[own].var() - m.sum() * t[own][m].var() - (~m).sum() * t[own][~m].var()
            if f >= 0:
                assert gains[f, tree["bin"][n]] == pytest.approx(max(gains.values()))
                m = bins[own, f] <= tree["bin"][n]
                rows[tree["left"][n]], rows[tree["left"][n] + 1] = own[m], own[~m]
            else:
                assert tree["value"][n][0] == pytest.approx(t[own].mean())


def test_adaboost_weights_equal_brute_force():
    x, t, _ = points(5, n=80, values=5)
    y = np.digitize(t, [0, 4])
    edges = [np.arange(4.0)] * 3
    learnt = trees.fit_adaboost(B.Held([(x, y[:, None].astype(float), np.ones(80))]), edges, "classification", 3, {"rounds": 6})
    w = np.full(80, 1 / 80)
    for r in range(len(learnt["weights"])):
        best = None
        for f in range(3):
            for v in range(4):
                m = x[:, f] <= v
                if 0 < m.sum() < 80:
                    def impurity(s):
                        n = np.bincount(y[s], w[s], 3)
                        return n.sum() - (n**2).sum() / n.sum()
                    gain = impurity(np.ones(80, bool)) - impurity(m) - impurity(~m)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, np.where(m, np.bincount(y[m], w[m], 3).argmax(), np.bincount(y[~m], w[~m], 3).argmax()))
        wrong = best[1] != y
        error = w[wrong].sum() / w.sum()
        assert learnt["errors"][r] == pytest.approx(error)
        alpha = np.log((1 - error) / error) + np.log(2)
        assert learnt["weights"][r] == pytest.approx(alpha)
        w = w * np.exp(alpha * wrong)
        w /= w.sum()


def test_adaboost_r2_weights_equal_brute_force():
    x, t, _ = points(6, n=70, values=4)
    edges = [np.arange(3.0)] * 3
    learnt = trees.fit_adaboost(B.Held([(x, t[:, None], np.ones(70))]), edges, "regression", 0, {"rounds": 5, "max_depth": 2})
    w = np.full(70, 1 / 70)
    bins = trees.to_bins(x, edges)
    for r, (error, weight) in enumerate(zip(learnt["errors"], learnt["weights"])):
        tree = trees._load(learnt["trees"][r][0])
        found = np.array([v[0] for v in tree.value])[tree.leaf_of(bins)]
        for leaf in np.unique(tree.leaf_of(bins)):
            m = tree.leaf_of(bins) == leaf
            assert np.allclose(found[m], (w[m] * t[m]).sum() / w[m].sum())
        miss = np.abs(found - t) / np.abs(found - t).max()
        mean = (w * miss).sum() / w.sum()
        assert error == pytest.approx(mean)
        beta = mean / (1 - mean)
        assert weight == pytest.approx(np.log(1 / beta))
        w = w * beta ** (1 - miss)
        w /= w.sum()


def test_hinge_solver_reaches_the_optimum():
    x, t, _ = points(7)
    y = np.digitize(t, [0, 4]).astype(float)
    v = models._hinge_newton(B.Held([(x, y, np.ones(len(y)))]), 3, 3, 0.7, 50, 1e-8)
    one = np.column_stack([x, np.ones(len(x))])
    for k in range(3):
        s = np.where(y == k, 1.0, -1.0)
        slack = np.maximum(0, 1 - s * (one @ v[k]))
        assert np.abs(v[k] - 2 * 0.7 * one.T @ (s * slack)).max() < 1e-6


def test_gram_of_many_columns(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 300))
    data = spark.createDataFrame([(float(i % 2), *map(float, r)) for i, r in enumerate(x)], "y double, " + ", ".join(f"f{i} double" for i in range(300)))
    coef = models.fit_ridge_classifier(data, [f"f{i}" for i in range(300)], "y", 2.0)
    s = np.where(np.arange(50) % 2 == 1, 1.0, -1.0)
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 2 * np.eye(300), c.T @ (s - s.mean()))
    assert np.allclose(coef["weights"][1], w)


def knn_truth(x, y, q, k):
    out = []
    for row in q:
        d = np.round(np.sqrt(((x - row) ** 2).sum(1)), 9)
        out.append(np.mean([y[i] for i in sorted(range(len(y)), key=lambda i: (d[i], y[i]))[:k]]))
    return out


@pytest.mark.parametrize("values,k", [(3, 5), (1000, 4), (12, 200)])
def test_metric_knn_equals_brute_force(spark, monkeypatch, values, k):
    monkeypatch.setattr(metric_knn, "RING_ROWS", 8)
    x, t, rng = points(9, n=150, values=values)
    q = np.concatenate([x[:20], rng.integers(-2, values + 2, (30, 3))])
    y = np.round(t, 3)
    model = metric_knn.MetricKnn(FEATS, "y", k=k).fit(frame(spark, x, y.tolist()))
    rows = model.transform(frame(spark, q, [0.0] * len(q))).orderBy("id").collect()
    assert np.allclose([r["prediction"] for r in rows], knn_truth(x, y, q, min(k, 150)))
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, float("nan"), 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    assert [r["prediction"] for r in model.transform(odd).collect()] == [None, None]
    empty = metric_knn.MetricKnn(FEATS, "y").fit(odd)
    assert [r["prediction"] for r in empty.transform(odd).collect()] == [None, None]


def test_halving_enters_all_sets_and_in_task_scores_equal_pipelines(spark):
    x, t, _ = points(10, n=400, values=3)
    df = frame(spark, x, ["p" if v > 2 else "q" for v in t]).cache()
    tr, va = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    rows = selection.SearchSet(tr, va, FEATS, "y", "id", 42)
    for name in ["BernoulliNB", "RidgeClassifier", "LinearSVC", "XGBClassifier"]:
        spec = classification_registry()[name]
        params = {**spec.defaults, **({"rounds": 4} if "rounds" in spec.defaults else {})}
        inside = selection._score_all(name, spec, [params], rows, 1.0, "binary-classification", 2, 1)[0]
        model = fit_pipeline(make_pipeline(name, spec, params, FEATS, "y", 2, tr.count()), tr)
        outside = selection.evaluate(model, va, "y", "binary-classification")
        assert inside == pytest.approx(outside), name
    spec = classification_registry()["RidgeClassifier"]
    params, best = selection.random_search("RidgeClassifier", spec, tr, va, FEATS, "y", "binary-classification", 2, 20, rows=rows)
    full, top = selection.random_search("RidgeClassifier", spec, tr, va, FEATS, "y", "binary-classification", 2, 20, rows=rows, halving=False)
    assert best["accuracy"] <= top["accuracy"] and params in [dict(p) for p in selection.draw_params(spec, 20)]
    rows.close()
