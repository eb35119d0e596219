"""Model registry: Spark ML estimators plus closed-form models written as aggregates.

Closed-form models (naive Bayes, ridge by Gram sums, dummies) learn from
one grouped aggregation whose result is small (classes x features), and
predict with one projection that carries the learnt numbers as literals:
no per-row Python, no join. They take plain numeric columns.

MLlib models go through ``make_pipeline``: label indexing, vector
assembly, max-abs scaling for linear models, the estimator, and the
label turned back into its original text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, MaxAbsScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, fit_on, total
from .forest import CellForest
from .lars import PATH_SCHEMA, centred, lars_path, path_rows
from .metric_knn import MetricKnn
from .trees import FITS, TreeEnsemble, class_number, predict_blocks

SCORE_DIGITS = 9


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------- closed form


def linear_argmax(classes: Sequence, intercepts: Sequence[float], weights: Sequence[Sequence[float]], cols: Sequence[str]) -> Column:
    """Class with the highest ``b_c + sum_j x_j w_cj`` (scores rounded to 9
    places; ties go to the first class in sorted order)."""
    best = []
    for i, (cls, b, w) in enumerate(zip(classes, intercepts, weights)):
        s = F.lit(float(b))
        for c, wj in zip(cols, w):
            s = s + _q(c).cast("double") * F.lit(float(wj))
        best.append(F.struct(F.round(s, SCORE_DIGITS).alias("s"), F.lit(-i).alias("i"), F.lit(cls).alias("c")))
    return F.greatest(*best)["c"] if len(best) > 1 else best[0]["c"]


class _ClosedParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "multinomial | bernoulli | ridge | svc | prior | mean | lars | lasso_lars", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "smoothing / ridge strength / C of the hinge loss", TypeConverters.toFloat)
    weightCol = Param(Params._dummy(), "weightCol", "row weights, if any", TypeConverters.toString)

    def _init_defaults(self):
        self._setDefault(inputCols=[], labelCol="label", predictionCol="prediction", kind="multinomial", alpha=1.0, weightCol="")


class ClosedFormModel(Model, _ClosedParams, DefaultParamsReadable, DefaultParamsWritable):
    coef_json = Param(Params._dummy(), "coef_json", "learnt classes, intercepts and weights", TypeConverters.toString)

    def __init__(self, coef_json: str = "{}", **kw):
        super().__init__()
        self._init_defaults()
        self._setDefault(coef_json="{}")
        self._set(coef_json=coef_json, **kw)

    @property
    def coef(self) -> dict:
        return json.loads(self.getOrDefault(self.coef_json))

    def prediction_expr(self) -> Column:
        c = self.coef
        cols = self.getOrDefault(self.inputCols)
        kind = self.getOrDefault(self.kind)
        if kind == "mean":
            return F.lit(float(c["value"]))
        if kind == "prior":
            return F.lit(c["value"])
        if kind in ("lars", "lasso_lars"):
            value = F.lit(float(c["intercept"]))
            for col, w in zip(cols, c["weights"]):
                if w:
                    value = value + F.coalesce(F.nanvl(_q(col).cast("double"), F.lit(0.0)), F.lit(0.0)) * F.lit(float(w))
            return value
        if kind == "bernoulli":
            cols_b = [f"__bin_{i}" for i in range(len(cols))]
            return linear_argmax(c["classes"], c["intercepts"], c["weights"], cols_b)
        return linear_argmax(c["classes"], c["intercepts"], c["weights"], cols)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault(self.inputCols)
        out = self.getOrDefault(self.predictionCol)
        if self.getOrDefault(self.kind) == "bernoulli":
            bins = {f"__bin_{i}": (_q(c) > 0).cast("double") for i, c in enumerate(cols)}
            return df.withColumns(bins).withColumn(out, self.prediction_expr()).drop(*bins)
        return df.withColumn(out, self.prediction_expr())


class ClosedFormClassifier(Estimator, _ClosedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Naive Bayes (multinomial / bernoulli), ridge by Gram sums, or a dummy."""

    def __init__(self, inputCols: Sequence[str] = (), labelCol: str = "label", predictionCol: str = "prediction", kind: str = "multinomial", alpha: float = 1.0, weightCol: str = ""):
        super().__init__()
        self._init_defaults()
        self._set(inputCols=list(inputCols), labelCol=labelCol, predictionCol=predictionCol, kind=kind, alpha=float(alpha), weightCol=weightCol)

    def _fit(self, df: DataFrame) -> ClosedFormModel:
        kind = self.getOrDefault(self.kind)
        cols = self.getOrDefault(self.inputCols)
        label = self.getOrDefault(self.labelCol)
        alpha = self.getOrDefault(self.alpha)
        fit = {"multinomial": fit_multinomial_nb, "bernoulli": fit_bernoulli_nb, "ridge": fit_ridge_classifier, "svc": fit_linear_svc,
               "prior": fit_prior, "mean": fit_mean, "lars": fit_lars, "lasso_lars": fit_lasso_lars}[kind]
        coef = fit(df, cols, label, alpha, self.getOrDefault(self.weightCol) or None)
        return ClosedFormModel(coef_json=json.dumps(coef), inputCols=cols, labelCol=label,
                               predictionCol=self.getOrDefault(self.predictionCol), kind=kind, alpha=alpha)


def _weight(weight: str | None) -> Column:
    return _q(weight) if weight else F.lit(1.0)


def class_sums(df: DataFrame, cols: Sequence[str], label: str, binarize: bool = False, weight: str | None = None) -> list:
    """Per class: row count and per-feature sums (one grouped aggregate; classes x features)."""
    x = [(_q(c) > 0).cast("double") if binarize else _q(c).cast("double") for c in cols]
    w = _weight(weight)
    rows = df.groupBy(_q(label).alias("_y")).agg(F.sum(w).alias("_n"), *[F.sum(v * w).alias(f"s{i}") for i, v in enumerate(x)]).collect()
    return sorted(rows, key=lambda r: r["_y"])


def fit_multinomial_nb(df, cols, label, alpha=1.0, weight=None) -> dict:
    """log prior + x . log((count + alpha) / (total + alpha * p)); features must be >= 0."""
    neg = df.agg(*[F.min(_q(c)).alias(c) for c in cols]).first()
    if any(neg[c] is not None and neg[c] < 0 for c in cols):
        raise ValueError("negative values in input to multinomial naive Bayes")
    rows = class_sums(df, cols, label, weight=weight)
    n = sum(r["_n"] for r in rows)
    p = len(cols)
    classes, b, w = [], [], []
    for r in rows:
        s = [r[f"s{i}"] or 0.0 for i in range(p)]
        tot = sum(s)
        classes.append(r["_y"])
        b.append(math.log(r["_n"] / n))
        w.append([math.log((sj + alpha) / (tot + alpha * p)) for sj in s])
    return {"classes": classes, "intercepts": b, "weights": w}


def fit_bernoulli_nb(df, cols, label, alpha=1.0, weight=None) -> dict:
    """Presence model (x > 0): folded into b_c + sum_j x_j (ln p - ln(1-p))."""
    rows = class_sums(df, cols, label, binarize=True, weight=weight)
    n = sum(r["_n"] for r in rows)
    p = len(cols)
    classes, b, w = [], [], []
    for r in rows:
        pj = [((r[f"s{i}"] or 0.0) + alpha) / (r["_n"] + 2 * alpha) for i in range(p)]
        classes.append(r["_y"])
        bias = math.log(r["_n"] / n)
        for v in pj:
            bias += math.log(1 - v)
        b.append(bias)
        w.append([math.log(v) - math.log(1 - v) for v in pj])
    return {"classes": classes, "intercepts": b, "weights": w}


def _class_blocks(df: DataFrame, cols: Sequence[str], label: str, weight: str | None):
    """(classes, blocks of (X, class numbers, w), number of rows); nulls in features count as 0."""
    classes = sorted(r[0] for r in df.select(_q(label)).where(_q(label).isNotNull()).distinct().collect())  # one row a class
    rows = df.where(_q(label).isNotNull()).withColumn("__y", class_number(_q(label), classes))
    n = rows.count()
    data = blocks(rows, cols, "__y", weight, rows=n)
    return classes, data.map(lambda e: (np.nan_to_num(e[0]), e[1][:, 0], e[2])), n


def _targets(y: np.ndarray, n_classes: int) -> np.ndarray:
    """{-1, +1} columns, one a class (one column for two classes)."""
    at = [1] if n_classes == 2 else range(n_classes)
    return np.stack([np.where(y == k, 1.0, -1.0) for k in at], axis=1)


def _as_coef(classes: list, w: np.ndarray, b: np.ndarray) -> dict:
    """``w``: (outputs, features). One output decides between two classes."""
    if len(classes) == 2:
        w, b = np.concatenate([-w, w]), np.concatenate([-b, b])
    return {"classes": classes, "intercepts": [float(v) for v in b], "weights": [[float(v) for v in x] for x in w]}


def gram(data, n_outputs: int, outputs) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted n, X'1, X'X, Y'1 and X'Y in one pass: each block adds its matrix
    products, partitions are summed in a tree."""

    def of(e):
        x, y, w = e
        xw, t = x * w[:, None], outputs(y)
        return [np.array([w.sum()]), xw.sum(0), xw.T @ x, (t * w[:, None]).sum(0), xw.T @ t]

    n, sx, xx, sy, xy = total(data, of)
    return float(n[0]), sx, xx, sy, xy


def fit_ridge_classifier(df, cols, label, alpha=1.0, weight=None) -> dict:
    """One-vs-all ridge on {-1, +1} targets with intercept, from Gram sums; the
    p x p system is solved on the driver."""
    classes, data, _ = _class_blocks(df, cols, label, weight)
    k = len(classes)
    if k < 2:
        return _as_coef(classes, np.zeros((k, len(cols))), np.zeros(k))
    n, sx, xx, sy, xy = gram(data, k, lambda y: _targets(y, k))
    mx, my = sx / n, sy / n
    w = np.linalg.solve(xx - n * np.outer(mx, mx) + alpha * np.eye(len(cols)), xy - n * np.outer(mx, my)).T
    return _as_coef(classes, w, my - w @ mx)


def fit_linear_svc(df, cols, label, alpha=1.0, weight=None, max_iter: int = 50, tol: float = 1e-8) -> dict:
    """One-vs-all linear support vectors: ``|v|^2 / 2 + C sum max(0, 1 - t f)^2``,
    the intercept (last of v) penalised like a weight, C = ``alpha``.

    Newton steps: one pass adds up loss, gradient and the second-order matrix
    of the rows inside the margin for all classes; steps are halved until the
    loss falls, tried lengths sharing one pass.
    """
    classes, data, n = _class_blocks(df, cols, label, weight)
    k, p = len(classes), len(cols)
    if k < 2:
        return _as_coef(classes, np.zeros((k, p)), np.zeros(k))
    v = fit_on(data, n, lambda d: _hinge_newton(d, k, p, alpha, max_iter, tol))
    return _as_coef(classes, v[:, :-1], v[:, -1])


def _hinge_newton(data, k: int, p: int, alpha: float, max_iter: int, tol: float) -> np.ndarray:
    data = data.map(lambda e: (np.column_stack([e[0], np.ones(len(e[0]))]), _targets(e[1], k), e[2])).persist(StorageLevel.MEMORY_AND_DISK)
    outputs = 1 if k == 2 else k
    v = np.zeros((outputs, p + 1))
    lengths = 0.5 ** np.arange(12)

    def losses(at: np.ndarray) -> np.ndarray:
        """Loss for each of the (tries, outputs, p + 1) weights."""
        sums = total(data, lambda e: np.stack([(e[2][:, None] * np.maximum(0, 1 - e[1] * (e[0] @ one.T)) ** 2).sum(0) for one in at]))
        return alpha * sums + 0.5 * (at**2).sum(2)

    for _ in range(max_iter):

        def of(e, v=v):
            x, t, w = e
            slack = np.maximum(0, 1 - t * (x @ v.T))
            grad = -2 * (x.T @ (t * slack * w[:, None])).T
            second = np.stack([2 * (x * (w * (slack[:, o] > 0))[:, None]).T @ x for o in range(v.shape[0])])
            return [grad, second]

        grad, second = total(data, of)
        grad = alpha * grad + v
        if np.abs(grad).max() < tol * max(1.0, alpha):
            break
        step = np.stack([np.linalg.solve(alpha * second[o] + np.eye(p + 1), grad[o]) for o in range(outputs)])
        tried = np.stack([v] + [v - x * step for x in lengths])
        loss = losses(tried)
        best = loss.argmin(0)
        v = np.stack([tried[best[o], o] for o in range(outputs)])
        if not best.any():
            break
    data.unpersist()
    return v


def _lars(df: DataFrame, cols: Sequence[str], label: str, weight: str | None, **kw) -> tuple[list[dict], dict]:
    """(knots of the path, its last point as a linear model)."""
    y = _q(label).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y))
    data = blocks(rows, cols, label, weight).map(lambda e: (np.nan_to_num(e[0]), e[1], e[2]))
    sums = gram(data, 1, lambda t: t) if not rows.isEmpty() else None
    if sums is None or sums[0] <= 0:
        return [], {"intercept": 0.0, "weights": [0.0] * len(cols)}
    n, sx, xx, sy, xy = sums
    knots = lars_path(*centred(n, sx, xx, sy, xy), n, **kw)
    w = knots[-1]["coef"]
    return knots, {"intercept": float(sy[0] / n - w @ sx / n), "weights": [float(v) for v in w]}


def fit_lars(df, cols, label, alpha=0.0, weight=None) -> dict:
    """End of the least-angle path (at most 500 features enter, as the usual default has it)."""
    return _lars(df, cols, label, weight, max_steps=501 if len(cols) > 500 else None)[1]


def fit_lasso_lars(df, cols, label, alpha=0.1, weight=None) -> dict:
    """Point of the lasso path at ``alpha``: ``|y - Xw|^2 / (2n) + alpha |w|_1``."""
    return _lars(df, cols, label, weight, lasso=True, alpha_min=float(alpha))[1]


def lars_rows(df: DataFrame, cols: Sequence[str], label: str, lasso: bool = False, alpha: float = 0.0, weight: str | None = None) -> DataFrame:
    """The whole path as rows: a row a knot and feature."""
    knots, _ = _lars(df, cols, label, weight, lasso=lasso, alpha_min=alpha)
    return df.sparkSession.createDataFrame(path_rows(knots, list(cols)), PATH_SCHEMA)


def softmax_newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, strength: float, max_iter: int = 100, tol: float = 1e-10):
    """(weights, intercepts, scale) of the logistic model that Spark ML fits:
    mean log loss plus ``strength / 2`` times the squared coefficients of the
    columns divided by their deviation, intercepts free; two classes have one
    coefficient vector. Newton steps with halving; equal columns and the common
    shift of the intercepts are left to the least-norm solution."""
    n, (rows, p) = weight.sum(), x.shape
    mean = weight @ x / n
    scale = np.sqrt(weight @ (x - mean) ** 2 / max(n - 1, 1e-300))
    used = scale > 0
    scale = np.where(used, scale, 1.0)
    z = np.column_stack([np.where(used, (x - mean) / scale, 0.0), np.ones(rows)])
    outputs = 1 if k == 2 else k
    hit = (y[:, None] == (np.array([1]) if k == 2 else np.arange(k))).astype(float)
    ridge = np.append(np.full(p, strength), 0.0)

    def loss(v: np.ndarray) -> float:
        s = z @ v.T
        top = np.maximum(s.max(1), 0.0) if k == 2 else s.max(1)
        total_ = np.exp(s - top[:, None]).sum(1) + (np.exp(-top) if k == 2 else 0.0)
        return float(weight @ (top + np.log(total_) - (hit * s).sum(1)) / n + 0.5 * (ridge * v**2).sum())

    v = np.zeros((outputs, p + 1))
    now = loss(v)
    for _ in range(max_iter):
        s = z @ v.T
        share = 1 / (1 + np.exp(-np.clip(s, -700, 700))) if k == 2 else np.exp(s - s.max(1, keepdims=True))
        if k != 2:
            share /= share.sum(1, keepdims=True)
        grad = ((weight[:, None] * (share - hit)).T @ z) / n + ridge * v
        if np.abs(grad).max() < tol:
            break
        second = np.zeros((outputs, p + 1, outputs, p + 1))
        for a in range(outputs):
            for c in range(outputs):
                part = weight * share[:, a] * ((a == c) - share[:, c]) / n
                second[a, :, c, :] = (z * part[:, None]).T @ z
            second[a, :, a, :] += np.diag(ridge)
        size = outputs * (p + 1)
        step = np.linalg.lstsq(second.reshape(size, size), grad.reshape(size), rcond=1e-13)[0].reshape(v.shape)
        for length in 0.5 ** np.arange(30):
            tried = loss(v - length * step)
            if tried < now:
                break
        else:
            break
        v, now = v - length * step, tried
    w = v[:, :-1] * used
    b = v[:, -1] - w @ (mean / scale)
    if k == 2:
        w, b = np.concatenate([np.zeros_like(w), w]), np.concatenate([[0.0], b])
    return w, b, scale


def fit_prior(df, cols, label, alpha=1.0, weight=None) -> dict:
    """Most frequent class, ties -> smallest."""
    r = df.groupBy(_q(label).alias("y")).agg(F.sum(_weight(weight)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("y").alias("y"))).alias("m")).first()
    return {"value": r["m"]["y"]}


def fit_mean(df, cols, label, alpha=1.0, weight=None) -> dict:
    y, w = _q(label).cast("double"), _weight(weight)
    return {"value": df.agg((F.sum(y * w) / F.sum(F.when(y.isNotNull(), w))).alias("m") if weight else F.avg(y).alias("m")).first()[0]}


# ---------------------------------------------------------------- MLlib


@dataclass
class Spec:
    """One registry entry: how to build the estimator, its defaults and search ranges."""

    build: callable
    task: str  # classification | regression
    linear: bool = False  # max-abs scaled inputs
    closed: bool = False  # closed-form model on plain columns
    defaults: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)  # name -> (low, high, integer?)
    knn: bool = False  # mean of the nearest rows
    unscaled: bool = False  # learns from counts and flags, not from standardised columns
    trees: dict | None = None  # histogram tree ensemble: its kind and fixed numbers
    forest: str | None = None  # bootstrapped regression trees: share of the features that a node draws
    growing: str | None = None  # parameter that may be cut in a search's first rungs (rounds, trees)
    held: str | None = None  # solver of the same objective for rows held in one task


def _ovr(est, n_classes: int):
    return est if n_classes <= 2 else OneVsRest(classifier=est)


def penalty(params: dict, n_rows: int) -> float:
    """Spark's penalty on the mean loss for a strength on the summed loss:
    1 / (C n) for ``C``, alpha / n for ``alpha``."""
    n = max(1, n_rows)
    return 1.0 / (float(params["C"]) * n) if "C" in params else float(params["alpha"]) / n


#: Second-order boosting under the libraries' own default numbers.
XGB = {"kind": "boosting", "l2": 1.0, "min_hessian": 1.0, "min_rows": 0.0, "hessian": 2.0}
LGBM = {"kind": "boosting", "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20.0, "hessian": 1.0, "max_depth": 12, "max_leaves": 31}
HIST = {"kind": "boosting", "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20.0, "hessian": 1.0, "max_depth": 12, "max_leaves": 31}


def classification_registry(mode: str = "stable") -> dict[str, Spec]:
    reg = {
        "LogisticRegression": Spec(lambda p, k: LogisticRegression(maxIter=int(p.get("maxIter", 100)), regParam=p["penalty"], elasticNetParam=0.0),
                                   "classification", linear=True, growing="maxIter", held="logistic", defaults={"C": 1.0, "maxIter": 100}, ranges={"C": (0.01, 10.0, False)}),
        "RidgeClassifier": Spec(None, "classification", closed=True, defaults={"kind": "ridge", "alpha": 1.0}, ranges={"alpha": (0.01, 10.0, False)}),
        "LinearSVC": Spec(None, "classification", closed=True, defaults={"kind": "svc", "alpha": 1.0}, ranges={"alpha": (0.01, 10.0, False)}),
        "MultinomialNB": Spec(None, "classification", closed=True, unscaled=True, defaults={"kind": "multinomial", "alpha": 1.0}, ranges={"alpha": (0.01, 2.0, False)}),
        "BernoulliNB": Spec(None, "classification", closed=True, unscaled=True, defaults={"kind": "bernoulli", "alpha": 1.0}, ranges={"alpha": (0.01, 2.0, False)}),
        "RandomForestClassifier": Spec(lambda p, k: RandomForestClassifier(numTrees=int(p.get("numTrees", 100)), maxDepth=int(p.get("maxDepth", 30)), seed=42),
                                       "classification", growing="numTrees", defaults={"numTrees": 100, "maxDepth": 30}, ranges={"numTrees": (10, 100, True), "maxDepth": (2, 30, True)}),
        "ExtraTreesClassifier": Spec(None, "classification", trees={"kind": "extra_trees"}, growing="trees", defaults={"trees": 100, "max_depth": 30}, ranges={"trees": (10, 100, True), "max_depth": (2, 30, True)}),
        "XGBClassifier": Spec(None, "classification", trees=XGB, growing="rounds", defaults={"rounds": 100, "rate": 0.1, "max_depth": 6}, ranges={"rounds": (50, 200, True), "max_depth": (3, 10, True), "rate": (0.01, 0.3, False), "columns": (0.5, 1.0, False)}),
        "LGBMClassifier": Spec(None, "classification", trees=LGBM, growing="rounds", defaults={"rounds": 100, "rate": 0.1, "max_leaves": 31}, ranges={"rounds": (50, 200, True), "max_leaves": (20, 150, True), "rate": (0.01, 0.3, False), "columns": (0.5, 1.0, False)}),
    }
    if mode == "explo":
        reg.update({
            "MLPClassifier": Spec(None, "classification", linear=True, defaults={"hidden": 100, "maxIter": 200}),
            "BaggingClassifier": Spec(lambda p, k: RandomForestClassifier(numTrees=int(p.get("numTrees", 10)), maxDepth=int(p.get("maxDepth", 30)), featureSubsetStrategy="all", seed=42),
                                      "classification", defaults={"numTrees": 10, "maxDepth": 30}),
            "GBTClassifier": Spec(lambda p, k: _ovr(GBTClassifier(maxIter=int(p.get("maxIter", 100)), stepSize=p.get("stepSize", 0.1), maxDepth=int(p.get("maxDepth", 6)), seed=42), k),
                                  "classification", growing="maxIter", defaults={"maxIter": 100, "stepSize": 0.1, "maxDepth": 6}, ranges={"maxIter": (10, 100, True), "maxDepth": (2, 8, True), "stepSize": (0.01, 0.3, False)}),
            "HistGradientBoostingClassifier": Spec(None, "classification", trees=HIST, growing="rounds", defaults={"rounds": 100, "rate": 0.1}),
            "AdaBoostClassifier": Spec(None, "classification", trees={"kind": "adaboost"}, defaults={"rounds": 50, "rate": 1.0}),
            "ComplementNB": Spec(lambda p, k: NaiveBayes(modelType="complement", smoothing=p.get("alpha", 1.0)), "classification", unscaled=True, defaults={"alpha": 1.0}),
            "DummyClassifier": Spec(None, "classification", closed=True, defaults={"kind": "prior"}),
        })
    return reg


def regression_registry(mode: str = "stable") -> dict[str, Spec]:
    reg = {
        "LinearRegression": Spec(lambda p, k: LinearRegression(solver="normal", standardization=False), "regression", defaults={}),
        "Ridge": Spec(lambda p, k: LinearRegression(solver="normal", regParam=p["penalty"], elasticNetParam=0.0, standardization=False),
                      "regression", defaults={"alpha": 1.0}, ranges={"alpha": (0.01, 10.0, False)}),
        "Lasso": Spec(lambda p, k: LinearRegression(regParam=p.get("regParam", 0.1), elasticNetParam=1.0, standardization=False),
                      "regression", defaults={"regParam": 0.1}, ranges={"regParam": (1e-4, 1.0, False)}),
        "ElasticNet": Spec(lambda p, k: LinearRegression(regParam=p.get("regParam", 0.1), elasticNetParam=float(p.get("l1_ratio", 0.5)), standardization=False),
                           "regression", defaults={"regParam": 0.1, "l1_ratio": 0.5}, ranges={"regParam": (1e-4, 1.0, False), "l1_ratio": (0.05, 0.95, False)}),
        "DecisionTreeRegressor": Spec(lambda p, k: DecisionTreeRegressor(maxDepth=int(p.get("maxDepth", 10)), seed=42),
                                      "regression", defaults={"maxDepth": 10}, ranges={"maxDepth": (2, 20, True)}),
        "RandomForestRegressor": Spec(None, "regression", forest="third", growing="numTrees", defaults={"numTrees": 100, "maxDepth": 30}, ranges={"numTrees": (10, 100, True), "maxDepth": (2, 20, True)}),
        "BaggingRegressor": Spec(None, "regression", forest="all", growing="numTrees", defaults={"numTrees": 10, "maxDepth": 30}, ranges={"numTrees": (10, 100, True)}),
        "ExtraTreesRegressor": Spec(None, "regression", trees={"kind": "extra_trees"}, growing="trees", defaults={"trees": 100, "max_depth": 30}, ranges={"trees": (10, 100, True), "max_depth": (3, 30, True)}),
        "KNeighborsRegressor": Spec(None, "regression", knn=True, defaults={"k": 5}, ranges={"k": (2, 50, True)}),
        "XGBRegressor": Spec(None, "regression", trees=XGB, growing="rounds", defaults={"rounds": 100, "rate": 0.1, "max_depth": 5}, ranges={"rounds": (50, 200, True), "max_depth": (3, 10, True), "rate": (0.01, 0.3, False), "columns": (0.5, 1.0, False)}),
        "LGBMRegressor": Spec(None, "regression", trees=LGBM, growing="rounds", defaults={"rounds": 100, "rate": 0.1, "max_leaves": 31}, ranges={"rounds": (50, 200, True), "max_leaves": (20, 150, True), "rate": (0.01, 0.3, False), "columns": (0.5, 1.0, False)}),
        "GBTRegressor": Spec(lambda p, k: GBTRegressor(maxIter=int(p.get("maxIter", 100)), maxDepth=int(p.get("maxDepth", 5)), seed=42),
                             "regression", defaults={"maxIter": 100, "maxDepth": 5}, ranges={"maxIter": (10, 100, True), "maxDepth": (2, 8, True)}),
    }
    if mode == "explo":
        reg.update({
            "HuberRegressor": Spec(lambda p, k: LinearRegression(loss="huber", epsilon=1.35, regParam=0.0001), "regression", defaults={}),
            "HistGradientBoostingRegressor": Spec(None, "regression", trees=HIST, growing="rounds", defaults={"rounds": 100, "rate": 0.1}),
            "AdaBoostRegressor": Spec(None, "regression", trees={"kind": "adaboost"}, defaults={"rounds": 50, "rate": 1.0}),
            "Lars": Spec(None, "regression", closed=True, defaults={"kind": "lars"}),
            "LassoLars": Spec(None, "regression", closed=True, defaults={"kind": "lasso_lars", "alpha": 0.1}, ranges={"alpha": (1e-4, 1.0, False)}),
            "DummyRegressor": Spec(None, "regression", closed=True, defaults={"kind": "mean"}),
        })
    return reg


def registry(task_type: str, mode: str = "stable") -> dict[str, Spec]:
    return regression_registry(mode) if task_type == "regression" else classification_registry(mode)


def make_pipeline(name: str, spec: Spec, params: dict, features: Sequence[str], target: str, n_classes: int, n_rows: int = 1, weight: str = "") -> Pipeline:
    """Stages from plain columns to a ``prediction`` column in the target's own values.

    ``n_rows``, the number of training rows, turns a strength on the summed
    loss into Spark's on the mean loss (``penalty``). ``weight``: a column of
    row weights (models that take none ignore it).
    """
    features = list(features)
    if spec.trees:
        config = {**spec.trees, "task": "regression" if spec.task == "regression" else "classification", **params}
        return Pipeline(stages=[TreeEnsemble(inputCols=features, labelCol=target, weightCol=weight, config=json.dumps(config))])
    if spec.forest:
        config = {"trees": int(params.get("numTrees", spec.defaults["numTrees"])), "max_depth": int(params.get("maxDepth", spec.defaults["maxDepth"])), "share": spec.forest}
        return Pipeline(stages=[CellForest(inputCols=features, labelCol=target, weightCol=weight, config=json.dumps(config))])
    if spec.knn:
        return Pipeline(stages=[MetricKnn(inputCols=features, labelCol=target, k=int(params.get("k", 5)))])
    if "C" in params or "alpha" in params:
        params = {**params, "penalty": penalty(params, n_rows)}
    if spec.closed:
        kind = params.get("kind", spec.defaults.get("kind"))
        est = ClosedFormClassifier(inputCols=features, labelCol=target, predictionCol="prediction", kind=kind, alpha=params.get("alpha", 1.0), weightCol=weight)
        return Pipeline(stages=[est])
    stages = [VectorAssembler(inputCols=features, outputCol="_raw" if spec.linear else "_features", handleInvalid="keep")]
    if spec.linear:
        stages.append(MaxAbsScaler(inputCol="_raw", outputCol="_features"))
    if spec.task == "regression":
        est = spec.build(params, n_classes)
        est.setFeaturesCol("_features").setLabelCol(target).setPredictionCol("prediction")
        if weight:
            est.setWeightCol(weight)
        return Pipeline(stages=stages + [est])
    indexer = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip")
    if name == "MLPClassifier":
        est = MultilayerPerceptronClassifier(layers=[len(features), int(params.get("hidden", 100)), n_classes],
                                             maxIter=int(params.get("maxIter", 200)), seed=42)
    else:
        est = spec.build(params, n_classes)
    est.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_pred")
    if weight and hasattr(est, "setWeightCol"):
        est.setWeightCol(weight)
    stages = [indexer] + stages + [est]
    return Pipeline(stages=stages + [_label_back()])


def _label_back():
    return IndexToString(inputCol="_pred", outputCol="prediction")


#: Closed-form kinds and tree ensembles can learn from blocks inside one task.
BLOCK_KINDS = ("multinomial", "bernoulli", "ridge", "svc")


#: Most coefficients whose second-order matrix a task solves for the logistic model.
HELD_COEFFICIENTS = 2000


def fits_in_task(spec: Spec, task: str, n_features: int = 0, n_classes: int = 0) -> bool:
    if spec.held == "logistic":
        return n_classes * (n_features + 1) <= HELD_COEFFICIENTS
    return bool(spec.trees) or (spec.closed and spec.defaults.get("kind") in BLOCK_KINDS and task != "regression")


def predict_in_task(spec: Spec, params: dict, train, edges, task: str, n_classes: int, x: np.ndarray) -> np.ndarray:
    """Class numbers or values for ``x`` of the model that learns from ``train``
    (a ``Held`` of (X, Y, w)); the same steps as the fitted pipeline's."""
    if spec.trees:
        config = {**spec.trees, **params}
        learnt = FITS[config["kind"]](train, edges, task, n_classes, config, int(config.get("seed", 42)))
        learnt.update(task=task, n_classes=n_classes, edges=edges)
        return predict_blocks(learnt, x)
    if spec.held == "logistic":
        (fx, fy, fw), = train.elements
        w, b, scale = softmax_newton(fx, fy[:, 0].astype(int), fw, n_classes, penalty(params, max(1, round(fw.sum()))))
        return ((x / scale) @ w.T + b).argmax(1)
    kind, alpha, k = spec.defaults["kind"], float(params["alpha"]), n_classes
    clean = train.map(lambda e: (np.nan_to_num(e[0]), e[1][:, 0], e[2]))
    x = np.nan_to_num(x)
    p = x.shape[1]
    if kind == "ridge":
        n, sx, xx, sy, xy = gram(clean, k, lambda y: _targets(y, k))
        w = np.linalg.solve(xx - n * np.outer(sx / n, sx / n) + alpha * np.eye(p), xy - n * np.outer(sx / n, sy / n)).T
        b = sy / n - w @ (sx / n)
    elif kind == "svc":
        v = _hinge_newton(clean, k, p, alpha, 50, 1e-8)
        w, b = v[:, :-1], v[:, -1]
    else:
        flags = kind == "bernoulli"
        sums = total(clean, lambda e: (e[1][:, None] == np.arange(k)).T @ (np.column_stack([np.ones(len(e[2])), e[0] > 0 if flags else e[0]]) * e[2][:, None]))
        n, s = sums[:, 0], sums[:, 1:]
        b = np.log(n / n.sum())
        if flags:
            share = (s + alpha) / (n[:, None] + 2 * alpha)
            w, b = np.log(share) - np.log(1 - share), b + np.log(1 - share).sum(1)
            x = (x > 0).astype(float)
        else:
            if total(clean, lambda e: e[0].min(initial=0.0), min) < 0:
                raise ValueError("negative values in input to multinomial naive Bayes")
            w = np.log((s + alpha) / (s.sum(1, keepdims=True) + alpha * p))
    score = x @ w.T + b
    if score.shape[1] == 1:
        return (score[:, 0] > 0).astype(int)
    return np.round(score, SCORE_DIGITS).argmax(1)


def fit_pipeline(pipe: Pipeline, df: DataFrame):
    """Fit, wiring IndexToString to the labels learnt by the StringIndexer."""
    stages = pipe.getStages()
    if stages and isinstance(stages[-1], IndexToString):
        head = Pipeline(stages=stages[:-1]).fit(df)
        labels = head.stages[0].labels  # the indexer itself is not needed to predict
        from pyspark.ml import PipelineModel

        back = IndexToString(inputCol="_pred", outputCol="prediction", labels=labels)
        return PipelineModel(stages=list(head.stages[1:]) + [back])
    return pipe.fit(df)
